"""Header lines of alignment and variant files: typed records that can be found, added, changed and removed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The tag that names a line of a kind.
NAMED_BY = {"SQ": "SN", "RG": "ID", "PG": "ID"}


class HeaderError(ValueError):
    """A line that isn't a header line, or a name that is taken or missing."""


@dataclass
class Line:
    """``@kind`` and its tags in order; of a comment the text."""

    kind: str
    tags: dict[str, str] = field(default_factory=dict)
    text: str = ""

    def __str__(self) -> str:
        return f"@CO\t{self.text}" if self.kind == "CO" else "\t".join([f"@{self.kind}", *(f"{k}:{v}" for k, v in self.tags.items())])


class SamHeader:
    """Lines in order, with an index by the tag that names them and by alternative names of references."""

    def __init__(self, text: str = ""):
        self.lines: list[Line] = []
        for raw in text.splitlines():
            if raw:
                self.add(self.parse(raw))

    @staticmethod
    def parse(raw: str) -> Line:
        if not re.match(r"@[A-Za-z]{2}(\t|$)", raw):
            raise HeaderError(f"not a header line: {raw[:40]!r}")
        kind = raw[1:3]
        if kind == "CO":
            return Line("CO", text=raw[4:])
        tags: dict[str, str] = {}
        for part in raw.split("\t")[1:]:
            if not re.match(r"[A-Za-z][A-Za-z0-9]:", part):
                raise HeaderError(f"not a tag: {part[:40]!r}")
            tags.setdefault(part[:2], part[3:])
        return Line(kind, tags)

    def __str__(self) -> str:
        return "".join(f"{line}\n" for line in self.lines)

    def of(self, kind: str) -> list[Line]:
        return [line for line in self.lines if line.kind == kind]

    def count(self, kind: str) -> int:
        return len(self.of(kind))

    def find(self, kind: str, name: str | None = None, **tags: str) -> Line | None:
        """First line of a kind with that name (of references an alternative name too) and these tags."""
        by = NAMED_BY.get(kind)
        for line in self.of(kind):
            named = name is None or (by and line.tags.get(by) == name) or (kind == "SQ" and name in line.tags.get("AN", "").split(","))
            if named and all(line.tags.get(k) == v for k, v in tags.items()):
                return line
        return None

    def index(self, kind: str, name: str) -> int:
        """Number of a named line among its kind, -1 if none."""
        line = self.find(kind, name)
        return next((i for i, own in enumerate(self.of(kind)) if own is line), -1)

    def name(self, kind: str, number: int) -> str:
        return self.of(kind)[number].tags[NAMED_BY[kind]]

    def add(self, line: Line | str) -> Line:
        """Append a line; a version line goes first and there is one, names of a kind differ."""
        line = self.parse(line) if isinstance(line, str) else line
        by = NAMED_BY.get(line.kind)
        if by and by not in line.tags:
            raise HeaderError(f"@{line.kind} without {by}")
        if by and self.find(line.kind, line.tags[by]):
            raise HeaderError(f"@{line.kind} {line.tags[by]} is there already")
        if line.kind == "HD":
            if old := self.find("HD"):
                old.tags |= line.tags
                return old
            self.lines.insert(0, line)
        else:
            self.lines.append(line)
        return line

    def update(self, kind: str, name: str | None, **tags: str | None) -> Line:
        """Set tags, or remove those given as None."""
        line = self.find(kind, name)
        if line is None:
            raise HeaderError(f"no @{kind} {name}")
        by = NAMED_BY.get(kind)
        if by in tags and tags[by] != line.tags.get(by) and (tags[by] is None or self.find(kind, tags[by])):
            raise HeaderError(f"@{kind} {tags[by]} can't be a name")
        for tag, value in tags.items():
            if value is None:
                line.tags.pop(tag, None)
            else:
                line.tags[tag] = value
        return line

    def remove(self, kind: str, name: str | None = None) -> bool:
        line = self.find(kind, name)
        self.lines = [own for own in self.lines if own is not line]
        return line is not None

    def remove_except(self, kind: str, kept: set[str]) -> int:
        """Remove lines of a kind whose name isn't in ``kept``; how many went."""
        before = len(self.lines)
        self.lines = [line for line in self.lines if line.kind != kind or line.tags.get(NAMED_BY.get(kind, "")) in kept]
        return before - len(self.lines)

    def unique_id(self, kind: str, wanted: str) -> str:
        """The name wanted, or with the first number after it that is free."""
        found, number = wanted, 0
        while self.find(kind, found):
            number += 1
            found = f"{wanted}.{number}"
        return found

    def chain_ends(self) -> list[str]:
        """Programs that no other one names as its predecessor."""
        before = {line.tags.get("PP") for line in self.of("PG")}
        return [line.tags["ID"] for line in self.of("PG") if line.tags["ID"] not in before]

    def add_program(self, name: str, **tags: str) -> list[str]:
        """A program line at the end of every chain (one if there is none); their ids."""
        made = []
        for end in self.chain_ends() or [None]:
            own = self.unique_id("PG", name)
            self.add(Line("PG", {"ID": own, "PN": name, **({"PP": end} if end else {}), **tags}))
            made.append(own)
        return made

    def set_order(self, order: str, version: str = "1.6") -> None:
        """Declare the sort order; a group order no longer holds."""
        if not self.find("HD"):
            self.add(Line("HD", {"VN": version}))
        self.update("HD", None, SO=order, GO=None)


class VcfHeader:
    """Meta lines of a VCF header: (key, value) or (key, fields), and the sample names."""

    def __init__(self, text: str):
        self.meta: list[tuple[str, str | dict[str, str]]] = []
        self.samples: list[str] = []
        for raw in text.splitlines():
            if raw.startswith("##"):
                key, eq, value = raw[2:].partition("=")
                if not eq:
                    raise HeaderError(f"not a meta line: {raw[:40]!r}")
                self.meta.append((key, self._fields(value) if value.startswith("<") and value.endswith(">") else value))
            elif raw.startswith("#CHROM"):
                self.samples = raw.split("\t")[9:]

    @staticmethod
    def _fields(value: str) -> dict[str, str]:
        return {m[1]: m[2] for m in re.finditer(r'([^=,<>]+)=("(?:[^"\\]|\\.)*"|[^,>]*)', value[1:-1])}

    @property
    def version(self) -> str:
        return str(next((v for k, v in self.meta if k == "fileformat"), ""))

    def find(self, key: str, name: str | None = None) -> str | dict[str, str] | None:
        return next((v for k, v in self.meta if k == key and (name is None or (isinstance(v, dict) and v.get("ID") == name))), None)

    def remove(self, key: str, name: str | None = None) -> bool:
        found = self.find(key, name)
        self.meta = [(k, v) for k, v in self.meta if not (k == key and v is found)]
        return found is not None

    def add(self, key: str, value: str | dict[str, str]) -> bool:
        """Append a line unless one of its key and ID is there."""
        if isinstance(value, dict) and self.find(key, value.get("ID")):
            return False
        self.meta.append((key, value))
        return True

    def __str__(self) -> str:
        lines = [f"##{k}=<{','.join(f'{a}={b}' for a, b in v.items())}>" if isinstance(v, dict) else f"##{k}={v}" for k, v in self.meta]
        fixed = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
        return "\n".join([*lines, "\t".join([fixed, *(["FORMAT", *self.samples] if self.samples else [])])]) + "\n"


def merged(one: SamHeader, other: SamHeader) -> tuple[SamHeader, list[int]]:
    """A header with the references of both, and the number in it of each reference of ``other``."""
    out = SamHeader(str(one))
    for line in other.of("SQ"):
        if not out.find("SQ", line.tags["SN"]):
            out.add(Line("SQ", dict(line.tags)))
    return out, [out.index("SQ", line.tags["SN"]) for line in other.of("SQ")]
