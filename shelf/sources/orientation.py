"""How a photo must be turned to stand upright: the orientation noted in the header of its file."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from shelf.functions import paths as P
from shelf.sources.walk import file_bytes, reachable

# The tag of the orientation, markers of JPEG segments without a length, and the marker that starts the image.
ORIENTATION_TAG = 0x0112
BARE_MARKERS = (0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8)
START_OF_SCAN = 0xDA
#: The largest stretch of a file that is read at once; headers are walked, not read whole.
PIECE = 1 << 16

Reader = Callable[[int, int], bytes]


def _of_directory(read: Reader, base: int) -> int:
    """Orientation in the first directory of a TIFF structure that starts at ``base``; 1 where none is noted."""
    head = read(base, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        return 1
    at = base + struct.unpack(order + "I", head[4:])[0]
    count = read(at, 2)
    if len(count) < 2:
        return 1
    n = struct.unpack(order + "H", count)[0]
    table = read(at + 2, 12 * n)
    for k in range(len(table) // 12):
        tag, kind, times = struct.unpack(order + "HHI", table[12 * k : 12 * k + 8])
        if tag == ORIENTATION_TAG and times >= 1 and kind in (3, 4):
            value = struct.unpack(order + ("H" if kind == 3 else "I"), table[12 * k + 8 : 12 * k + (10 if kind == 3 else 12)])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def orientation_of(read: Reader) -> int | None:
    """1 to 8 as noted in a JPEG, TIFF, PNG or WebP file, 1 where nothing is noted, None where the bytes are of no such file.
    ``read`` gives the bytes from an offset, fewer at the end."""
    head = read(0, 12)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return _of_directory(read, 0)
    if head[:2] == b"\xff\xd8":
        at = 2
        while True:
            mark = read(at, 4)
            if len(mark) < 4 or mark[0] != 0xFF:
                return 1
            if mark[1] == 0xFF:
                at += 1
            elif mark[1] in BARE_MARKERS:
                at += 2
            elif mark[1] == START_OF_SCAN:
                return 1
            else:
                if mark[1] == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
                    return _of_directory(read, at + 10)
                at += 2 + struct.unpack(">H", mark[2:])[0]
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return _of_chunks(read, 8, ">", name_first=False, name=b"eXIf", trailer=4)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _of_chunks(read, 12, "<", name_first=True, name=b"EXIF", trailer=0)
    return 1 if head[:6] in (b"GIF87a", b"GIF89a") or head[:2] == b"BM" else None


def _of_chunks(read: Reader, at: int, order: str, name_first: bool, name: bytes, trailer: int) -> int:
    while True:
        head = read(at, 8)
        if len(head) < 8:
            return 1
        size = struct.unpack(order + "I", head[4:] if name_first else head[:4])[0]
        if (head[:4] if name_first else head[4:]) == name:
            base = at + 8
            return _of_directory(read, base + 6 if read(base, 6) == b"Exif\0\0" else base)
        at += 8 + size + trailer + (size % 2 if name_first else 0)


def _from_bytes(raw: bytes | None) -> int | None:
    return None if raw is None else orientation_of(lambda at, n: raw[at : at + n])


class _File:
    """Stretches of a file, read as the header walk asks for them; neighbouring stretches come from one read."""

    def __init__(self, path: str):
        self.path, self.at, self.piece = path, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.piece):
            self.at, self.piece = at, file_bytes(self.path, at, max(n, PIECE))
        return self.piece[at - self.at : at - self.at + n]


def _from_file(path: str | None) -> int | None:
    if path is None or not reachable(path):
        return None
    try:
        return orientation_of(_File(path))
    except OSError:
        return None


def content_orientation(content: Column | str) -> Column:
    """Orientation noted in the bytes of files, null where they are of no image file."""

    @F.pandas_udf("int")
    def look(raw: pd.Series) -> pd.Series:
        return raw.map(_from_bytes).astype("Int32")

    return look(P.as_column(content))


def file_orientation(path: Column | str) -> Column:
    """Orientation noted in the files at ``path``, of which only the headers are read; null where that is not possible.
    Only paths go to Python, the other columns of the row stay where they are."""

    @F.pandas_udf("int")
    def look(paths: pd.Series) -> pd.Series:
        return paths.map(_from_file).astype("Int32")

    return look(P.as_column(path))


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """An image [height, width, ...] turned and mirrored as ``orientation`` says."""
    if orientation >= 5:
        a = a.swapaxes(0, 1)
    flip_rows = orientation in (3, 4, 7, 8)
    flip_columns = orientation in (2, 3, 6, 7)
    return a[:: -1 if flip_rows else 1, :: -1 if flip_columns else 1]


def upright_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """(width, height) of the photo as it stands upright."""
    lying = F.coalesce(orientation, F.lit(1)) >= 5
    return F.when(lying, height).otherwise(width), F.when(lying, width).otherwise(height)
