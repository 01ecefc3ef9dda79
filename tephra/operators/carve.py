"""Files found in raw images by their signatures."""

from __future__ import annotations

import mmap
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signatures import PARSERS, SIGNATURES, Signature, find_footer, resolved_extension, sniffed
from ..runtime import written

_CARVED = "offset long, size long, signature_name string, extension string, file_type string, boundary_method string"
#: Bytes that a block needs past its end, so that the farthest header of a file starting in it is seen.
OVERLAP = max(s.offset + len(s.header) for s in SIGNATURES)


@dataclass(frozen=True)
class CarveOptions:
    """Where files may start, the least size, the types looked for (all if none are named), and whether the content decides the extension."""

    aligned: bool = True
    min_size: int = 512
    types: tuple[str, ...] = ()
    sniff: bool = False

    def signatures(self) -> list[Signature]:
        return [s for s in SIGNATURES if not self.types or s.file_type in self.types]


class Span:
    """Part of a mapped file, or of bytes, that parsers read like bytes; what they don't touch isn't read."""

    def __init__(self, data, start: int, size: int):
        self.data, self.start, self.size = data, start, max(0, min(size, len(data) - start))

    def __len__(self) -> int:
        return self.size

    def __buffer__(self, flags: int) -> memoryview:
        return memoryview(self.data)[self.start : self.start + self.size]

    def __getitem__(self, key: slice) -> bytes:
        first, last, _ = key.indices(self.size)
        return bytes(self.data[self.start + first : self.start + max(first, last)])

    def find(self, part: bytes, first: int = 0) -> int:
        return self._inside(self.data.find(part, self.start + first, self.start + self.size))

    def rfind(self, part: bytes, first: int = 0, last: int | None = None) -> int:
        return self._inside(self.data.rfind(part, self.start + first, self.start + (self.size if last is None else min(last, self.size))))

    def _inside(self, at: int) -> int:
        return at - self.start if at >= 0 else -1


def header_hits(data: bytes, base: int, owned: int, options: CarveOptions, signatures: Sequence[Signature]) -> list[tuple[int, int]]:
    """(offset in the image, signature number) of files that start in the first ``owned`` bytes of a block at ``base``.

    At a place the first signature whose header is there wins, headers at offset 0 before others. A signature
    whose first byte is at no place is passed over; for the rest all places are compared at once, byte by byte.
    """
    a = np.frombuffer(data, np.uint8)
    step = 512 if options.aligned else 1
    begin, end = -base % step, min(owned, len(a))
    places = np.arange(begin, end, step)
    won = np.full(len(places), -1)
    present: dict[int, frozenset] = {}
    for late in (False, True):
        for i, s in enumerate(signatures):
            if (s.offset > 0) != late:
                continue
            if s.offset not in present:
                present[s.offset] = frozenset(data[begin + s.offset : end + s.offset : step])
            if s.header[0] not in present[s.offset]:
                continue
            open_ = np.flatnonzero(won < 0)
            at = places[open_] + s.offset
            open_, at = open_[at + len(s.header) <= len(a)], at[at + len(s.header) <= len(a)]
            for j, byte in enumerate(s.header):
                same = a[at + j] == byte
                open_, at = open_[same], at[same]
                if not len(at):
                    break
            won[open_] = i
    hit = won >= 0
    return list(zip((places[hit] + base).tolist(), won[hit].tolist()))


def resolved_size(data: Callable[[int], Span], whole: int, s: Signature, offset: int, following: int | None, least: int) -> tuple[int | None, str]:
    """Size and how it was found: by the format itself, a footer before the next header, or the next header.

    ``data(n)`` gives up to ``n`` bytes from the file's start, of which only those looked at are read; ``whole``
    is the size of the image.
    """
    room = min(s.max_mb << 20, whole - offset)
    if s.parser and (size := PARSERS[s.parser](data(room))) is not None and size >= least and offset + size <= whole:
        return size, "InternalSize"
    if s.footer:
        at = find_footer(data(min(room, following - offset) if following is not None else room), s.footer, least)
        if at is not None:
            return at + len(s.footer), "FooterScan"
    if following is not None and (size := min(following - offset, s.max_mb << 20)) >= least:
        return size, "NextHeader"
    return None, "MaxSizeCap"


def _extension(s: Signature, head: bytes, options: CarveOptions) -> str:
    return (sniffed(head) if options.sniff else None) or resolved_extension(s, head)


def carve_bytes(image: bytes, options: CarveOptions = CarveOptions()) -> list[tuple]:
    """All files in an image that fits in memory: (offset, size, signature, extension, type, boundary)."""
    signatures = options.signatures()
    hits = header_hits(image, 0, len(image), options, signatures)
    out = []
    for (offset, i), following in zip(hits, [*(h[0] for h in hits[1:]), None]):
        s = signatures[i]
        size, method = resolved_size(lambda n, o=offset: Span(image, o, n), len(image), s, offset, following, options.min_size)
        if size is not None and size >= options.min_size and offset + size <= len(image):
            out.append((offset, size, s.name, _extension(s, image[offset : offset + 300], options), s.file_type, method))
    return out


def _batch(keys: pa.Array, index: list[int], rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(index, pa.int32())), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=names)


def hits(blocks: DataFrame, key: str, content: Column, base: Column, owned: Column, options: CarveOptions = CarveOptions()) -> DataFrame:
    """``key``, offset, signature, following: header hits of blocks of images, and the next hit's offset in the image.

    A block's content goes OVERLAP bytes past the bytes it owns; each hit belongs to the block its file starts
    in. The next hit is known within a block; only the last hit of a block looks at the first ones of later
    blocks, a window over one row per block. Images are scanned when this function is called.
    """
    signatures = options.signatures()
    rows = blocks.select(F.col(key).alias("key"), content.alias("content"), base.cast("long").alias("base"), owned.cast("long").alias("owned"))
    kind = dict(rows.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], []
            for i, (c, b, n) in enumerate(zip(batch.column("content"), batch.column("base").to_pylist(), batch.column("owned").to_pylist())):
                data = c.as_py()
                if not data:
                    continue
                found = header_hits(data, b, n, options, signatures)
                for (at, s), after in zip(found, [*(f[0] for f in found[1:]), None]):
                    index.append(i)
                    out.append((b, at, signatures[s].name, after))
            yield _batch(batch.column("key"), index, out, ["key", "base", "offset", "signature", "following"], [pa.int64(), pa.int64(), pa.string(), pa.int64()])

    # Images are read once: what is found, which is little beside them, is written and read twice.
    found, _ = written(rows.mapInArrow(scan, f"key {kind}, base long, offset long, signature string, following long"), "hits")
    firsts = found.groupBy("key", "base").agg(F.min("offset").alias("first"))
    ahead = firsts.withColumn("next_first", F.min("first").over(Window.partitionBy("key").orderBy("base").rowsBetween(1, Window.unboundedFollowing))).select("key", "base", "next_first")
    return found.join(ahead, ["key", "base"]).select(F.col("key").alias(key), "offset", "signature", F.coalesce("following", "next_first").alias("following"))


def carve_column(images: DataFrame, key: str, content: Column, options: CarveOptions = CarveOptions()) -> DataFrame:
    """``key`` and the files found in images that are values of a column: offset, size, signature_name, extension, file_type, boundary_method. A map without shuffle."""
    rows = images.select(F.col(key).alias("key"), content.alias("content"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], []
            for i, c in enumerate(batch.column("content")):
                found = carve_bytes(c.as_py() or b"", options)
                index += [i] * len(found)
                out += found
            yield _batch(batch.column("key"), index, out, ["key", "offset", "size", "signature_name", "extension", "file_type", "boundary_method"], [pa.int64(), pa.int64(), *[pa.string()] * 4])

    return rows.mapInArrow(run, f"key {kind}, {_CARVED}").withColumnRenamed("key", key)


def carve_files(found: DataFrame, path: str, options: CarveOptions = CarveOptions()) -> DataFrame:
    """Sizes of ``hits`` in image files that the executors can open; images are mapped, so only what parsers look at is read."""
    by_name = {s.name: s for s in options.signatures()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], []
            for i, (p, offset, name, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "signature", "following")))):
                s, whole = by_name[name], os.path.getsize(p)
                with open(p, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
                    size, method = resolved_size(lambda n, m=mapped, o=offset: Span(m, o, n), whole, s, offset, after, options.min_size)
                    if size is not None and size >= options.min_size and offset + size <= whole:
                        index.append(i)
                        out.append((offset, size, name, _extension(s, Span(mapped, offset, 300)[:], options), s.file_type, method))
            yield _batch(batch.column("path"), index, out, ["path", "offset", "size", "signature_name", "extension", "file_type", "boundary_method"], [pa.int64(), pa.int64(), *[pa.string()] * 4])

    return found.select(F.col(path).alias("path"), "offset", "signature", "following").mapInArrow(run, f"path string, {_CARVED}").withColumnRenamed("path", path)


def carved_name(number: Column, offset: Column, extension: Column) -> Column:
    """The name a carved file is written under."""
    return F.format_string("%08d_%012x.%s", number, offset, extension)


def carve_summary(carved: DataFrame) -> DataFrame:
    """Files and bytes per extension and boundary method."""
    return carved.groupBy("extension", "boundary_method").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def file_entries(carved: DataFrame, folder: str) -> DataFrame:
    """Carved files (name, offset, size, file_type, extension; hash if known) as entries of an index: created now, modified unknown, no bad sectors."""
    digest = F.col("hash") if "hash" in carved.columns else F.lit(None).cast("string")
    return carved.select(
        F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), "size", F.col("file_type").alias("kind"), F.col("extension").alias("ext"),
        F.lit(None).cast("timestamp").alias("modified"), F.current_timestamp().alias("created"), digest.alias("hash"), F.lit(False).alias("has_bad_sectors"),
    )
