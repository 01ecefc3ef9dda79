"""Raw images in blocks that overlap, and files block by block with the state of each."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.carve import OVERLAP


class _Block(InputPartition):
    def __init__(self, path: str, base: int, owned: int):
        self.path, self.base, self.owned = path, base, owned


class ImageReader(DataSourceReader):
    """One task per block of an image."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.block = int(options.get("block_bytes", 64 << 20)) // 512 * 512 or 512

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            size = os.path.getsize(p)
            if not size:
                raise ValueError(f"{p} is empty")
            out += [_Block(p, at, min(self.block, size - at)) for at in range(0, size, self.block)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.base)
            yield partition.path, partition.base, partition.owned, f.read(partition.owned + OVERLAP)


class ImageSource(DataSource):
    """``spark.read.format("tephra_image").load("a.dd,b.dd")``; option block_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tephra_image"

    def schema(self) -> str:
        return "image string, base long, owned long, content binary"

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))


def image_blocks(spark: SparkSession, paths: list[str], block_bytes: int = 64 << 20) -> DataFrame:
    """Blocks of raw images: image, base, owned, content; content goes on past what the block owns, for headers that lie across."""
    spark.dataSource.register(ImageSource)
    return spark.read.format("tephra_image").option("block_bytes", block_bytes).load(",".join(paths))


#: Errors that another attempt may mend.
_TRANSIENT = (InterruptedError, BlockingIOError, TimeoutError)


def read_blocks(files: DataFrame, path: str, block_bytes: int = 4096, attempts: int = 3, delay_ms: int = 100) -> DataFrame:
    """Each file read block by block: path, block, offset, bytes, bad, error. Passing errors are tried again after delays that grow fourfold; a file without blocks gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block", "offset", "bytes", "bad", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for p in batch.column("path").to_pylist():
                size = os.path.getsize(p)
                for n, at in enumerate(range(0, size, block_bytes)):
                    want, error = min(block_bytes, size - at), None
                    for attempt in range(attempts):
                        try:
                            with open(p, "rb") as f:
                                f.seek(at)
                                f.read(want)
                            error = None
                            break
                        except _TRANSIENT as e:
                            error = str(e)
                            time.sleep(delay_ms * 4**attempt / 1000)
                        except OSError as e:
                            error = str(e)
                            break
                    out.append((p, n, at, want, error is not None, error))
                    if len(out) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    return files.selectExpr(f"`{path}` AS path").mapInArrow(run, "path string, block long, offset long, bytes long, bad boolean, error string")
