"""Changes to fields of records, as columns: names, tags, filters, IDs, and typed values from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TEXTS = "array<string>"


def set_qname(name: Column) -> Column:
    """A query name as a record can hold it: null or empty becomes ``*``, an error beyond 254 bytes."""
    given = F.when(F.length(name) > 0, name).otherwise(F.lit("*"))
    return F.when(F.octet_length(given) <= 254, given).otherwise(F.raise_error(F.lit("query name over 254 bytes")))


def _named(tags: Column, name: str) -> Column:
    return F.exists(tags, lambda t: t.startswith(f"{name}:"))


def update_tag(tags: Column, name: str, kind: str, value: Column) -> Column:
    """``tags`` (array of ``XX:T:value``) with this one: where there was one of its name, else at the end; a null value changes nothing."""
    tags = F.coalesce(tags, F.array().cast(NO_TEXTS))
    made = F.concat(F.lit(f"{name}:{kind}:"), value.cast("string"))
    replaced = F.transform(tags, lambda t: F.when(t.startswith(f"{name}:"), made).otherwise(t))
    return F.when(made.isNull(), tags).when(_named(tags, name), replaced).otherwise(F.array_append(tags, made))


def append_tag(tags: Column, name: str, kind: str, value: Column) -> Column:
    """``tags`` with this one at the end; one of the same name, or a null value, is an error or no change."""
    tags = F.coalesce(tags, F.array().cast(NO_TEXTS))
    taken = F.raise_error(F.lit(f"tag {name} is there already")).cast(NO_TEXTS)
    return F.when(value.isNull(), tags).when(_named(tags, name), taken).otherwise(F.array_append(tags, F.concat(F.lit(f"{name}:{kind}:"), value.cast("string"))))


def delete_tag(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: ~t.startswith(f"{name}:"))


def tag_value(tags: Column, name: str) -> Column:
    """Text of a tag's value; null without it."""
    found = F.get(F.filter(tags, lambda t: t.startswith(f"{name}:")), F.lit(0))
    return F.substring(found, F.lit(6), F.length(found))


def pack_bases(seq: Column) -> Column:
    """Bases as binary, four bits each, the first one high; an odd number ends with four zero bits."""
    # Fixed values of the format: digits of the letters.
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^=ACMGRSVTWYHKDBN]", "N"), "=ACMGRSVTWYHKDBN", "0123456789ABCDEF")
    return F.unhex(F.concat(digits, F.when(F.length(seq) % 2 == 1, F.lit("0")).otherwise(F.lit(""))))


def unpack_bases(packed: Column, length: Column) -> Column:
    return F.substring(F.translate(F.hex(packed), "0123456789ABCDEF", "=ACMGRSVTWYHKDBN"), F.lit(1), length)


def has_filter(filters: Column, name: str) -> Column:
    """Whether a record's filters (array; null or empty is none set) hold this one; PASS and ``.`` hold where none is set."""
    none = F.coalesce(F.size(filters), F.lit(0)) <= 0
    return F.when(none, F.lit(name in ("PASS", "."))).otherwise(F.array_contains(filters, "PASS" if name == "." else name))


def add_filter(filters: Column, name: str) -> Column:
    """``filters`` with this one: PASS replaces all others, and others replace PASS."""
    filters = F.coalesce(filters, F.array().cast(NO_TEXTS))
    others = F.array_append(F.filter(filters, lambda f: f != "PASS"), F.lit(name))
    return F.when(F.array_contains(filters, name), filters).otherwise(F.array(F.lit(name)) if name == "PASS" else others)


def remove_filter(filters: Column, name: str, passes: bool = False) -> Column:
    """``filters`` without this one; with ``passes`` the last one that goes leaves PASS."""
    kept = F.filter(F.coalesce(filters, F.array().cast(NO_TEXTS)), lambda f: f != name)
    return F.when((F.size(kept) == 0) & F.coalesce(F.array_contains(filters, name), F.lit(False)), F.array(F.lit("PASS"))).otherwise(kept) if passes else kept


def add_id(ids: Column, name: Column) -> Column:
    """IDs between semicolons with this one, once; null and ``.`` are none."""
    none = ids.isNull() | ids.isin("", ".")
    return F.when(name.isNull(), ids).when(none, name).when(F.array_contains(F.split(ids, ";"), name), ids).otherwise(F.concat_ws(";", ids, name))


def samples(names: list[str], wanted: str) -> list[str]:
    """The samples that a list between commas names, in header order, or with ``^`` before it all others; ``-`` is all and empty none.

    ValueError for a name that isn't there.
    """
    if wanted == "-":
        return list(names)
    without, listed = wanted.startswith("^"), [x for x in wanted.removeprefix("^").split(",") if x]
    missing = [x for x in listed if x not in names]
    if missing:
        raise ValueError(f"no such samples: {missing}")
    return [n for n in names if (n in listed) != without]


def info_values(info: Column, key: str, kind: str = "int") -> Column:
    """Values of an INFO key of a map as an array of ``kind`` (int, double, string), ``.`` null in it; null without the key."""
    value = F.try_element_at(info, F.lit(key))
    return F.transform(F.split(value, ","), lambda x: F.when(x != ".", x.try_cast("bigint" if kind == "int" else kind)))


def info_flag(info: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(info, key), F.lit(False))


def format_values(format: Column, sample: Column, key: str, kind: str = "int") -> Column:
    """A sample's values of a FORMAT key (format and sample: arrays of the parts between colons); null where either leaves it out."""
    place = F.array_position(format, key)
    value = F.when(place > 0, F.get(sample, (place - 1).cast("int")))
    return F.transform(F.split(value, ","), lambda x: F.when(x != ".", x.try_cast("bigint" if kind == "int" else kind)))


def parse_int(text: Column, bits: int = 32, signed: bool = True) -> Column:
    """struct<value, overflow> of a decimal number: beyond the bits, the nearest number that fits; null where it is none."""
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    # Leading zeros go first, so that 38 digits hold whatever isn't beyond 64 bits anyway.
    digits = F.regexp_replace(F.trim(text), r"^([+-]?)0+(?=\d)", "$1")
    fine = digits.rlike(r"^[+-]?\d+$" if signed else r"^\+?\d+$")
    big = F.length(digits) > 25
    number = F.when(big, F.when(digits.startswith("-"), F.lit("-1" + 25 * "0")).otherwise(F.lit("1" + 25 * "0")).cast("decimal(38,0)")).otherwise(digits.try_cast("decimal(38,0)"))
    lower, upper = F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")
    return F.when(fine, F.struct(F.least(F.greatest(number, lower), upper).alias("value"), ((number < lower) | (number > upper)).alias("overflow")))
