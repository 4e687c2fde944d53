"""Block gzip: members of at most 64 KB that carry their own length, so a file can be cut at any of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: Fixed values of the format: bytes of a block before compression, fixed fields of a member, the empty end block.
BLOCK = 0xFF00
MEMBER = struct.Struct("<4BI2BH")
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class FormatError(ValueError):
    """Bytes that aren't what the format says."""


def member_size(data: bytes, at: int) -> int:
    """Length of the member at ``at``, from its extra field."""
    if len(data) - at < 18:
        raise FormatError("block header is cut off")
    a, b, method, flags, _, _, _, extra = MEMBER.unpack_from(data, at)
    if (a, b, method) != (31, 139, 8) or not flags & 4:
        raise FormatError("not a block gzip member")
    place, stop = at + 12, at + 12 + extra
    while place + 4 <= stop:
        name, size = data[place : place + 2], int.from_bytes(data[place + 2 : place + 4], "little")
        if name == b"BC" and size == 2:
            return int.from_bytes(data[place + 4 : place + 6], "little") + 1
        place += 4 + size
    raise FormatError("member without its length")


def inflate(member: bytes) -> bytes:
    """Content of one member; its length and CRC are checked."""
    start = 12 + int.from_bytes(member[10:12], "little")
    out = zlib.decompress(member[start:-8], -15)
    crc, size = struct.unpack("<II", member[-8:])
    if len(out) != size or zlib.crc32(out) != crc:
        raise FormatError("block checksum or length differs")
    return out


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, member) of a whole file."""
    at = 0
    while at < len(data):
        size = member_size(data, at)
        if at + size > len(data):
            raise FormatError("block is cut off")
        yield at, data[at : at + size]
        at += size


def decompress(data: bytes) -> bytes:
    return b"".join(inflate(m) for _, m in members(data))


class Packer:
    """Content of one file, compressed block by block as it comes."""

    def __init__(self, level: int = 6):
        self.level, self.size, self._rest, self._held, self._made = level, 0, 0, [], []

    def add(self, content: bytes) -> None:
        self._held.append(content)
        self.size += len(content)
        self._rest += len(content)
        if self._rest >= BLOCK:
            content = b"".join(self._held)
            whole = len(content) - len(content) % BLOCK
            self._made += [deflate(content[i : i + BLOCK], self.level) for i in range(0, whole, BLOCK)]
            self._held, self._rest = [content[whole:]], len(content) - whole

    def finish(self) -> bytes:
        rest = b"".join(self._held)
        return b"".join([*self._made, *([deflate(rest, self.level)] if rest else []), EOF])


class Content:
    """Content of a whole file, inflated block by block as it is asked for."""

    def __init__(self, data: bytes):
        self._blocks, self._part, self._at = (inflate(m) for _, m in members(data)), b"", 0

    def take(self, size: int) -> bytes:
        """The next ``size`` bytes, fewer where the file ends."""
        if self._at + size > len(self._part):
            parts = [self._part[self._at :]]
            have = len(parts[0])
            while have < size and (block := next(self._blocks, None)) is not None:
                parts.append(block)
                have += len(block)
            self._part, self._at = b"".join(parts), 0
        self._at += size
        return self._part[self._at - size : self._at]


class Plain(Content):
    """The same of bytes that aren't compressed."""

    def __init__(self, data: bytes):
        self._blocks, self._part, self._at = iter(()), data, 0


def ends_well(data: bytes) -> bool:
    """Whether the empty end block is there."""
    return data.endswith(EOF)


def deflate(content: bytes, level: int = 6) -> bytes:
    """One member of up to BLOCK bytes."""
    for way in (level, 0):
        made = zlib.compressobj(way, zlib.DEFLATED, -15)
        body = made.compress(content) + made.flush()
        size = len(body) + 26
        if size <= 1 << 16:
            break
    return MEMBER.pack(31, 139, 8, 4, 0, 0, 255, 6) + b"BC\x02\x00" + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(content), len(content))


def compress(content: bytes, level: int = 6, end: bool = True) -> bytes:
    return b"".join(deflate(content[i : i + BLOCK], level) for i in range(0, len(content), BLOCK)) + (EOF if end else b"")


def read_at(data: bytes, virtual: int, size: int) -> bytes:
    """``size`` bytes from a virtual offset: the member's place, and within it the place in 16 bits."""
    at, skip, out = virtual >> 16, virtual & 0xFFFF, b""
    while len(out) < size + skip and at < len(data):
        step = member_size(data, at)
        out += inflate(data[at : at + step])
        at += step
    return out[skip : skip + size]
