"""Chunkers by kind of medium: fixed size in the JVM; text, Markdown and code by their structure, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters.

    A chunk shorter than the overlap is followed by one that begins a single character later; without
    ``crawl`` by one that begins where it ends, which spares many nearly equal chunks of short paragraphs.
    """

    size: int = 1024
    overlap: int = 128
    least: int = 64
    most: int = 8192
    sentences: bool = True
    blocks: bool = True
    crawl: bool = True


#: Where a text chunk may end, with how far past the target each kind is looked for.
_PARAGRAPHS = ("\n\n", "\r\n\r\n")
_SENTENCES = (". ", ".\n", "! ", "!\n", "? ", "?\n", ".\r\n", "!\r\n", "?\r\n")
_BLOCKS = ("\n}\n", "\n}\r\n", "\n\n", "\nend\n", "\nend\r\n")
_SCHEMA = "index int, total int, content string, start_pos long, end_pos long, media_type string, metadata map<string,string>"

Piece = tuple[int, int, str, dict[str, str]]


def fixed(docs: DataFrame, key: str, text: str, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Chunks of ``size`` characters, each but the first led by the ``overlap`` before it where there are as many: ``key``, index, total, start_pos, content. All in the JVM."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    rows = docs.where(F.length(text) > 0).select(key, text, n.alias("total"), F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    lead = F.when((F.col("index") > 0) & (F.col("index") * size >= overlap), overlap).otherwise(0)
    return rows.select(key, "index", "total", (F.col("index") * size - lead).alias("start_pos"), F.substring(text, F.col("index") * size - lead + 1, lead + size).alias("content"))


def _nearest(text: str, start: int, target: int, marks: tuple[str, ...], reach: int, past: int, keep_last: bool) -> int:
    """The end nearest to ``target`` among the first occurrences of the marks; ``target`` if there is none."""
    best = (float("inf"), target)
    for mark in marks:
        at = text.find(mark, start, min(len(text), target + reach))
        if at >= 0:
            end = at + len(mark) - (not keep_last)
            if end <= target + past and abs(end - target) < best[0]:
                best = (abs(end - target), end)
    return best[1]


def text_end(text: str, start: int, target: int) -> int:
    """End of the first paragraph if it isn't far past the target, else of the sentence nearest to it."""
    for mark in _PARAGRAPHS:
        at = text.find(mark, start, min(len(text), target + 500))
        if 0 <= at <= target + 200:
            return at + len(mark)
    return _nearest(text, start, target, _SENTENCES, 200, 1 << 40, False)


def code_end(text: str, start: int, target: int) -> int:
    """End of the block nearest to the target."""
    return _nearest(text, start, target, _BLOCKS, 500, 300, True)


def walk(text: str, config: ChunkConfig, end_of: Callable[[str, int, int], int] | None) -> Iterator[tuple[int, int]]:
    """Spans one after the other, each beginning ``overlap`` before the last end; small ones are left out but for the first and last."""
    start, size, first = 0, len(text), True
    while start < size:
        target = min(start + config.size, size)
        end = end_of(text, start, target) if end_of and target < size else target
        end = min(end, start + config.most, size)
        if end - start >= config.least or first or end == size:
            yield start, end
            first = False
        start = size if end >= size else end if not config.crawl and end - start <= config.overlap else max(end - config.overlap, start + 1)


def text_pieces(text: str, source: str, config: ChunkConfig) -> list[Piece]:
    return [(a, b, "text", {}) for a, b in walk(text, config, text_end if config.sentences else None)]


def code_pieces(text: str, source: str, config: ChunkConfig) -> list[Piece]:
    ext = source.rsplit(".", 1)[-1].lower() if "." in source else ""
    language = next((k for k, v in names.LANGUAGES.items() if ext in v.split()), "unknown")
    return [(a, b, "code", {"language": language}) for a, b in walk(text, config, code_end if config.blocks else None)]


def markdown_pieces(text: str, source: str, config: ChunkConfig) -> list[Piece]:
    """Chunks that begin at headings outside fences once the last is large enough, or end at the size; each with the heading it falls under."""
    out: list[Piece] = []
    start = end = 0
    heading, fenced = None, False

    def close() -> None:
        out.append((start, end, "markdown", {"heading": heading} if heading else {}))

    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        marks = len(bare) - len(bare.lstrip("#"))
        if not fenced and 1 <= marks <= 6 and bare[marks : marks + 1] == " ":
            if end - start >= config.least:
                close()
                start = end
            heading = bare
        end += len(line)
        if end - start >= config.size and not (config.blocks and fenced):
            close()
            start = max(end - config.overlap, start)
    if end > start and end - start >= config.least:
        close()
    return out


def pdf_pieces(text: str, source: str, config: ChunkConfig) -> list[Piece]:
    """Extracted text as text; nothing extracted gives one describing piece."""
    return [(a, b, "pdf", m) for a, b, _, m in text_pieces(text, source, config)] if text.strip() else [(0, 0, "pdf", {"scanned": "true"})]


#: Strategies by media type; more can be registered.
STRATEGIES: dict[str, Callable[[str, str, ChunkConfig], list[Piece]]] = {"text": text_pieces, "markdown": markdown_pieces, "code": code_pieces, "pdf": pdf_pieces, "binary": lambda *_: []}


def register(media: str, strategy: Callable[[str, str, ChunkConfig], list[Piece]]) -> None:
    """Use ``strategy`` for a media type."""
    STRATEGIES[media] = strategy


def by_media(docs: DataFrame, key: str, text: str, source: Column, media: Column, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of each document by the strategy of its media type, unknown ones as text: ``key`` and index, total, content, start_pos, end_pos, media_type, metadata.

    A map without shuffle. An image gives one describing piece; a text the strategy fails on gives one with the error.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), source.cast("string").alias("source"), media.alias("media"))
    kind = dict(rows.dtypes)["key"]
    strategies = dict(STRATEGIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (text_, source_, media_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "source", "media")))):
                body, name = text_ or "", source_ or ""
                if media_ == "image":
                    out.append((i, 0, 1, f"[Image: {name.rsplit('/', 1)[-1]} ({len(body.encode())} bytes)]", 0, len(body), "image", [("format", name.rsplit(".", 1)[-1])]))
                    continue
                try:
                    found = strategies.get(media_, text_pieces)(body, name, config) if body or media_ == "pdf" else []
                except Exception as e:
                    found = [(0, 0, media_ or "text", {"extraction_error": str(e)})]
                for n, (a, b, m, meta) in enumerate(found):
                    out.append((i, n, len(found), body[a:b] or f"[{m}: {name.rsplit('/', 1)[-1]} ({len(body.encode())} bytes)]", a, b, m, list(meta.items())))
            cols = list(zip(*out)) or [[]] * 8
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
            arrays = [batch.column("key").take(pa.array(cols[0], pa.int32())), *(pa.array(list(c), k) for c, k in zip(cols[1:], kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "index", "total", "content", "start_pos", "end_pos", "media_type", "metadata"])

    return rows.mapInArrow(run, f"key {kind}, {_SCHEMA}").withColumnRenamed("key", key)
