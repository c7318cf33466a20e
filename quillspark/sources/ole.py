"""Compound binary files: storages and streams of the container that older office formats share (public specification MS-CFB)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST_SECTOR = 0xFFFFFFFA  # greater numbers are marks, not sectors
_NO_ENTRY = 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5


class CompoundFile:
    """Streams by path; paths are names joined by slashes."""

    def __init__(self, data: bytes):
        if not data.startswith(SIGNATURE) or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 4 <= mini_shift < shift:
            raise ValueError("sector sizes out of range")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir, _, self.cutoff, first_mini, _, next_difat = struct.unpack_from("<IIIIIII", data, 44)
        fat_sectors = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while next_difat < _LAST_SECTOR and next_difat not in seen:
            seen.add(next_difat)
            *more, next_difat = self._numbers(next_difat)
            fat_sectors += more
        self.fat = [n for s in fat_sectors[:n_fat] if s < _LAST_SECTOR for n in self._numbers(s)]
        self.mini_fat = [n for s in self._chain(first_mini, self.fat) for n in self._numbers(s)]
        entries = b"".join(map(self._sector, self._chain(first_dir, self.fat)))
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        start, length = self._place(self.entries[0])
        self.mini_stream = self._read(start, length, self.fat, self._sector)
        self.paths = dict(self._walk())

    def _sector(self, number: int) -> bytes:
        return self.data[(number + 1) * self.size : (number + 2) * self.size]

    def _mini_sector(self, number: int) -> bytes:
        return self.mini_stream[number * self.mini : (number + 1) * self.mini]

    def _numbers(self, sector: int) -> tuple[int, ...]:
        body = self._sector(sector)
        return struct.unpack(f"<{len(body) // 4}I", body[: len(body) // 4 * 4])

    @staticmethod
    def _chain(start: int, fat: list[int]) -> Iterator[int]:
        for _ in range(len(fat)):
            if start >= len(fat):
                return
            yield start
            start = fat[start]

    def _read(self, start: int, length: int, fat: list[int], sector) -> bytes:
        return b"".join(map(sector, self._chain(start, fat)))[:length]

    def _place(self, entry: bytes) -> tuple[int, int]:
        start, length = struct.unpack_from("<IQ", entry, 116)
        return start, length if self.size > 512 else length & 0xFFFFFFFF

    def _walk(self) -> Iterator[tuple[str, int]]:
        """Path and number of every entry below the root."""
        todo, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], {_NO_ENTRY}
        while todo:
            number, above = todo.pop()
            if number in seen or number >= len(self.entries):
                continue
            seen.add(number)
            entry = self.entries[number]
            length = struct.unpack_from("<H", entry, 64)[0]
            path = above + entry[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            yield path, number
            left, right, child = struct.unpack_from("<III", entry, 68)
            todo += [(left, above), (right, above)]
            if entry[66] == STORAGE:
                todo.append((child, path + "/"))

    def streams(self, below: str = "") -> list[str]:
        """Paths of streams that begin with ``below``, in order."""
        return sorted(p for p, i in self.paths.items() if self.entries[i][66] == STREAM and p.startswith(below))

    def storages(self, below: str = "") -> list[str]:
        """Paths of storages directly in the storage ``below`` (ends in a slash, or is empty)."""
        return sorted(p for p, i in self.paths.items() if self.entries[i][66] == STORAGE and p.startswith(below) and "/" not in p[len(below) :])

    def has(self, path: str) -> bool:
        return path in self.paths

    def read(self, path: str) -> bytes:
        start, length = self._place(self.entries[self.paths[path]])
        if length < self.cutoff:
            return self._read(start, length, self.mini_fat, self._mini_sector)
        return self._read(start, length, self.fat, self._sector)
