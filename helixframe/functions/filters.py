"""The record filter language, compiled to a Column.

Levels from tightest to loosest: values and calls; unary ``+ - ! ~``; ``* / %``;
``+ -``; ``&``; ``^``; ``|``; ``< <= > >=``; ``== != =~ !~``; ``&& ||`` (one level, left to
right).  Comparisons of both kinds group to the right.  A value is a string, a
number, or depends on the row (tags); next to it goes an explicit truth.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cigar as C
from .sequence import FLAGS

TOKEN = re.compile(r'\s*(?:(0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|("(?:[^"\\]|\\.)*")|([A-Za-z_][A-Za-z_0-9.]*)|(\[[A-Za-z][A-Za-z0-9]\])|(&&|\|\||==|!=|=~|!~|<=|>=|[-+*/%&^|<>!~()]))')
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
POSIX = {"[:alpha:]": r"\p{Alpha}", "[:digit:]": r"\d", "[:alnum:]": r"\p{Alnum}", "[:space:]": r"\s", "[:upper:]": r"\p{Upper}", "[:lower:]": r"\p{Lower}", "[:punct:]": r"\p{Punct}"}


def java_pattern(pattern: str) -> str:
    """An extended regular expression for Java: classes, and marks that are plain there, within brackets."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if pattern[at] != "[":
            out.append(pattern[at])
            at += 1
            continue
        own = re.match(r"\[\^?\]?(?:\[:\w+:\]|[^\]])*\]", pattern[at:])
        if not own:
            raise FilterError("bracket without an end")
        inside = own[0][1:-1]
        negated, inside = inside.startswith("^"), inside.removeprefix("^")
        made = re.sub(r"\[:\w+:\]|[\[\]\\&]", lambda m: POSIX.get(m[0], "\\" + m[0]), inside)
        out.append("[" + "^" * negated + made + "]")
        at += len(own[0])
    return "".join(out)


class FilterError(ValueError):
    """The text isn't a filter, or gives an operator a kind of value that it doesn't take."""


@dataclass
class Value:
    """A string (null: absent) or a number; ``text`` and ``number`` are both set only for tags."""

    number: Column | None = None
    text: Column | None = None
    present: Column | None = None
    literal: str | None = None

    def truth(self) -> Column:
        if self.present is not None:
            return self.present
        if self.text is not None:
            return self.text.isNotNull()
        return F.coalesce(self.number != 0, F.lit(False))

    def num(self) -> Column:
        if self.number is None:
            raise FilterError("a number is needed here")
        return self.number


def _bool(c: Column) -> Value:
    c = F.coalesce(c, F.lit(False))
    return Value(number=c.cast("double"), present=c)


def _long(c: Column) -> Column:
    return c.cast("long")


def variables() -> dict[str, Value]:
    """Names over a table with the columns of ``reads``."""
    flag = F.col("flag")
    span = C.endpos(flag, F.col("pos"), F.col("cigar"))
    number = {
        "flag": flag, "mapq": F.col("mapq"), "pos": F.col("pos") + 1, "endpos": span, "tlen": F.col("tlen"), "ncigar": F.size(C.ops(F.col("cigar"))), "mpos": F.col("mpos") + 1, "pnext": F.col("mpos") + 1,
        "qlen": C.qlen(F.col("cigar")), "rlen": C.rlen(F.col("cigar")), "refid": F.col("tid"), "mrefid": F.col("mtid"),
    }
    number |= {f"flag.{name.lower()}": flag.bitwiseAND(F.lit(1 << i)) for i, name in enumerate(FLAGS)}
    text = {name: F.coalesce(F.col(column), F.lit("*")) for name, column in (("cigar", "cigar"), ("rname", "rname"), ("mrname", "mrname"), ("rnext", "mrname"))}
    text |= {"qname": F.col("qname"), "seq": F.coalesce("seq", F.lit("")), "library": F.coalesce("library", F.lit(""))}
    found = {name: Value(number=c.cast("double")) for name, c in number.items()} | {name: Value(text=c) for name, c in text.items()}
    return found | {"qual": Value(text=F.col("qual"))}


def tag(name: str) -> Value:
    """A tag of ``tags map<string, struct<s, d>>``: present even if 0."""
    own = F.col("tags")[name]
    return Value(number=own["d"], text=own["s"], present=own.isNotNull())


class Compiler:
    def __init__(self, names: dict[str, Value], tags: Callable[[str], Value] = tag):
        self.names, self.tags = names, tags

    def compile(self, text: str) -> Value:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise FilterError(f"can't read {text[at:]!r}")
            self.tokens.append((["number", "string", "name", "tag", "op"][m.lastindex - 1], m[m.lastindex], m.end()))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.source, self.at = text, 0
        value = self.boolean()
        if self.tokens[self.at][0] != "end":
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def take(self, *ops: str) -> str | None:
        kind, token, _ = self.tokens[self.at]
        if kind == "op" and token in ops:
            self.at += 1
            return token
        return None

    def boolean(self) -> Value:
        left = self.equal()
        while op := self.take("&&", "||"):
            right = self.equal()
            left = _bool(left.truth() & right.truth() if op == "&&" else left.truth() | right.truth())
        return left

    def equal(self) -> Value:
        left = self.compare()
        op = self.take("==", "!=", "=~", "!~")
        if not op:
            return left
        right = self.equal()
        if op in ("=~", "!~"):
            if left.text is None or right.text is None:
                raise FilterError(f"{op} needs strings")
            pattern = right.literal
            if pattern is not None:
                found = left.text.rlike(java_pattern(pattern))
            else:
                found = F.regexp_like(left.text, right.text)
            return _bool(found if op == "=~" else ~found)
        same = self._same(left, right, lambda a, b: a == b)
        return _bool(same if op == "==" else ~same)

    @staticmethod
    def _same(left: Value, right: Value, test: Callable[[Column, Column], Column]) -> Column:
        """A test of two strings or of two numbers; false where they are of different kinds or absent."""
        out = F.lit(False)
        if left.text is not None and right.text is not None:
            out = out | F.coalesce(test(left.text, right.text), F.lit(False))
        if left.number is not None and right.number is not None:
            out = out | F.coalesce(test(left.number, right.number), F.lit(False))
        return out

    def compare(self) -> Value:
        left = self.binary(0)
        op = self.take("<", "<=", ">", ">=")
        if not op:
            return left
        right = self.compare()
        tests = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return _bool(self._same(left, right, tests[op]))

    LEVELS = [("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%")]

    def binary(self, level: int) -> Value:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            a, b = left.num(), self.binary(level + 1).num()
            left = Value(number={
                "|": lambda: _long(a).bitwiseOR(_long(b)), "^": lambda: _long(a).bitwiseXOR(_long(b)), "&": lambda: _long(a).bitwiseAND(_long(b)),
                "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(_long(a), _long(b)),
            }[op]().cast("double"))
        return left

    def unary(self) -> Value:
        op = self.take("+", "-", "!", "~")
        if op in ("+", "-"):
            value = self.simple().num()
            return Value(number=value if op == "+" else -value)
        if op == "!":
            value = self.unary()
            if value.text is not None:
                return _bool(~value.truth())
            return _bool(F.coalesce(_long(value.num()) == 0, F.lit(True)))
        if op == "~":
            return Value(number=F.bitwise_not(_long(self.unary().num())).cast("double"))
        return self.simple()

    def simple(self) -> Value:
        kind, token, end = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(number=F.lit(float(int(token, 16) if token[:2] in ("0x", "0X") else token)))
        if kind == "string":
            text = re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1])
            return Value(text=F.lit(text), literal=text)
        if kind == "tag":
            return self.tags(token[1:-1])
        if kind == "name" and token in self.names:
            return self.names[token]
        if kind == "name" and token in ("length", "min", "max", "avg") and self.source[end : end + 1] == "(":
            self.at += 1
            value = self.boolean()
            if not self.take(")"):
                raise FilterError("a bracket isn't closed")
            return self.call(token, value)
        if (kind, token) == ("op", "("):
            value = self.boolean()
            if not self.take(")"):
                raise FilterError("a bracket isn't closed")
            return value
        raise FilterError(f"unexpected {token!r}")

    @staticmethod
    def call(name: str, value: Value) -> Value:
        """Length of a string; least, largest and mean byte of one."""
        if value.text is None:
            raise FilterError(f"{name}() needs a string")
        if name == "length":
            return Value(number=F.octet_length(value.text).cast("double"))
        codes = F.transform(F.filter(F.split(F.hex(value.text), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("double"))
        if name == "avg":
            return Value(number=F.when(F.size(codes) > 0, F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / F.size(codes)).otherwise(0.0))
        return Value(number=F.coalesce(F.array_min(codes) if name == "min" else F.array_max(codes), F.lit(float("nan"))))


def compile_filter(text: str, names: dict[str, Value] | None = None) -> Column:
    """Whether a record passes; never null."""
    value = Compiler(variables() if names is None else names).compile(text)
    return F.coalesce(value.truth(), F.lit(False))
