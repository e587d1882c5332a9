"""ZIP packages of stored members: written in one stream, read by ranges through their directory."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64, DESCRIPTOR = b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: 1980-01-01 00:00, the first date that ZIP can say.
DATE = 33


class ZipWriter:
    """Stored members only. Sizes are 64-bit throughout, so no member or package is too large."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: Iterable[bytes]) -> None:
        """One member; its size and checksum follow its data and stand in the directory."""
        raw, start = name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, DATE, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        begin, crc = self.at, 0
        for chunk in chunks:
            crc = zlib.crc32(chunk, crc)
            self._put(chunk)
        size = self.at - begin
        self._put(DESCRIPTOR + struct.pack("<IQQ", crc, size, size))
        self.entries.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            fixed = (45, 45, 0x0808, 0, 0, DATE, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", *fixed) + raw + extra)
        size, n, end = self.at - start, len(self.entries), self.at
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0))


class ZipReader:
    """The directory of a package, and ranges of its stored members. file: seekable, binary."""

    def __init__(self, file, size: int):
        self.file = file
        self.members: dict[str, tuple[int, int, int]] = {}  # method, size, place of the local header
        tail_at = max(0, size - FULL16 - 22)
        tail = self._read(tail_at, size - tail_at)
        end = tail.rfind(END, 0, max(0, len(tail) - 18))
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(END, 0, end + 3)  # the mark inside a comment
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        n, length, start = struct.unpack_from("<HII", tail, end + 10)
        locator = self._read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == LOCATOR64:
            (at,) = struct.unpack_from("<Q", locator, 8)
            record = self._read(at, 56)
            if record[:4] != END64:
                raise ValueError("ZIP64 end of central directory is not where its locator says")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
        directory, at = self._read(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
            (place,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
            extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
            full, packed, place = self._wide(extra, full, packed, place)
            self.members[name] = (method, packed, place)
            at += 46 + name_n + extra_n + comment_n

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, place: int) -> tuple[int, int, int]:
        """The values that a ZIP64 field holds instead of those that are all ones."""
        at = 0
        while at + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                full = next(values) if full == FULL32 else full
                packed = next(values) if packed == FULL32 else packed
                place = next(values) if place == FULL32 else place
            at += 4 + n
        return full, packed, place

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def span(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begins in the package, and its size."""
        method, size, place = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self._read(place, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        return place + 30 + sum(struct.unpack_from("<HH", head, 26)), size

    def read(self, name: str) -> bytes:
        return self._read(*self.span(name))
