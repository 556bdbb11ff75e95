"""MAT files of version 5 (and the NIRS files that are such), from the public format: numbers, text, cells and structures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Data types of elements by number, and classes of arrays that hold numbers.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, PACKED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5


class MatError(ValueError):
    """Not a MAT file of version 5, or a broken one."""


class _Elements:
    """Elements one after the other in a stretch of bytes."""

    def __init__(self, raw: bytes, order: str):
        self.raw, self.order, self.at = raw, order, 0

    def more(self) -> bool:
        return self.at + 8 <= len(self.raw)

    def next(self) -> tuple[int, bytes]:
        kind, size = struct.unpack_from(self.order + "II", self.raw, self.at)
        if kind >> 16:  # small element: size and type share four bytes, the data follow at once
            kind, size, start, end = kind & 0xFFFF, kind >> 16, self.at + 4, self.at + 8
        else:
            start = self.at + 8
            end = start + size + (0 if kind == PACKED else -size % 8)
        if start + size > len(self.raw):
            raise MatError("an element is cut off")
        self.at = end
        return kind, self.raw[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        if kind not in TYPES:
            raise MatError(f"unexpected element type {kind}")
        return np.frombuffer(data, self.order + TYPES[kind])


def _matrix(data: bytes, order: str):
    """(name, value) of a matrix element; structures become dicts (lists of dicts if they have several elements), cells lists."""
    if not data:
        return "", np.zeros((0, 0))
    e = _Elements(data, order)
    kind = int(e.numbers()[0]) & 0xFF
    shape = tuple(int(n) for n in e.numbers())
    name = bytes(e.numbers().astype(np.uint8)).decode("latin-1")
    count = int(np.prod(shape))
    if kind == CELL:
        return name, [_matrix(e.next()[1], order)[1] for _ in range(count)]
    if kind == STRUCT:
        width = int(e.numbers()[0])
        listed = bytes(e.numbers().astype(np.uint8))
        fields = [listed[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(listed), width)]
        rows = [{f: _matrix(e.next()[1], order)[1] for f in fields} for _ in range(count)]
        return name, rows[0] if count == 1 else rows
    if kind == CHAR:
        codes = e.numbers().reshape(shape, order="F") if count else np.zeros((0, 0), int)
        return name, "\n".join("".join(map(chr, row)) for row in np.atleast_2d(codes))
    if kind == SPARSE or kind not in range(6, 16):
        return name, None
    return name, e.numbers().reshape(shape, order="F")


def read(raw: bytes) -> dict:
    """Variables by name. What is neither number, text, cell nor structure is null."""
    if len(raw) < 136 or raw[126:128] not in (b"IM", b"MI"):
        raise MatError("no MAT file of version 5")
    order = "<" if raw[126:128] == b"IM" else ">"
    out, e = {}, _Elements(raw[128:], order)
    while e.more():
        kind, data = e.next()
        if kind == PACKED:
            kind, data = _Elements(zlib.decompress(data), order).next()
        if kind == MATRIX:
            name, value = _matrix(data, order)
            out[name] = value
    return out
