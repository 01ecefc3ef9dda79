"""What the headers of pictures say: size and orientation; and the size a preview gets."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6)
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)
    for kind, at, size in _segments(data):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and size >= 7:
            height, width = struct.unpack_from(">HH", data, at + 1)
            return width, height
    return None


def _segments(data: bytes):
    """(marker, start of content, its size) of a JPEG up to its scan."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            return
        yield data[at + 1], at + 4, size - 2
        at += 2 + size


def orientation(data: bytes) -> int:
    """EXIF orientation 1 to 8 of a JPEG; 1 where nothing is said."""
    for kind, at, size in _segments(data):
        tiff = data[at + 6 : at + size]
        if kind != 0xE1 or data[at : at + 6] != b"Exif\0\0" or len(tiff) < 10:
            continue
        order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        if order is None:
            return 1
        first = struct.unpack_from(order + "I", tiff, 4)[0]
        if first + 2 > len(tiff):
            return 1
        for n in range(struct.unpack_from(order + "H", tiff, first)[0]):
            entry = first + 2 + 12 * n
            if entry + 10 <= len(tiff) and struct.unpack_from(order + "H", tiff, entry)[0] == 0x0112:
                value = struct.unpack_from(order + "H", tiff, entry + 8)[0]
                return value if 1 <= value <= 8 else 1
    return 1


def fitted(width: Column, height: Column, box: int) -> Column:
    """(width, height) scaled to a square box, never enlarged, at least one point."""
    scale = F.least(F.lit(float(box)) / F.greatest(width, height), F.lit(1.0))
    side = lambda c: F.greatest(F.floor(c * scale), F.lit(1)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


#: What turns a picture of each EXIF orientation upright: degrees clockwise, then whether it is mirrored left to right.
UPRIGHT = {1: (0, False), 2: (0, True), 3: (180, False), 4: (180, True), 5: (90, True), 6: (90, False), 7: (270, True), 8: (270, False)}


def upright_size(width: int, height: int, orientation_: int) -> tuple[int, int]:
    """Size of a picture once it stands upright."""
    return (height, width) if UPRIGHT.get(orientation_, (0, False))[0] in (90, 270) else (width, height)


def thumbnail_sizes(sizes: list[int]) -> list[int]:
    """Sizes of progressive thumbnails, each once, the smallest first."""
    return sorted({s for s in sizes if s > 0})
