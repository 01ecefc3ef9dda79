"""Writing files out: export with digests, carved files, zero-filled copies, removal of duplicates, reports."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import html_escaped, size_text
from ..operators.proof import destination

_RESULT = "source_path string, dest_path string, size long, hash string, verified boolean, error string"


def _checked(dest: str, sources: list[str]) -> None:
    """A destination below a source would be written into what is being read."""
    d = os.path.realpath(dest)
    for s in sources:
        if d == os.path.realpath(s) or d.startswith(os.path.realpath(s) + os.sep):
            raise ValueError(f"{dest} lies in the source {s}")


def _copied(source: str, dest: str, verify: bool) -> tuple[int, str, bool]:
    """Copy by way of a temporary name, so that a repeated task does no harm."""
    digest, size = hashlib.sha256(), 0
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    temporary = f"{dest}.part-{os.getpid()}"
    with open(source, "rb") as a, open(temporary, "wb") as b:
        while block := a.read(1 << 16):
            digest.update(block)
            b.write(block)
            size += len(block)
    if verify:
        again = hashlib.sha256()
        with open(temporary, "rb") as f:
            while block := f.read(1 << 16):
                again.update(block)
        if again.digest() != digest.digest():
            os.remove(temporary)
            raise OSError("the copy differs from its source")
    os.replace(temporary, dest)
    return size, digest.hexdigest(), verify


def export(files: DataFrame, dest: str, sources: list[str], flatten: bool = False, verify: bool = True, dry_run: bool = False, tasks: int = 8, stop_on_error: bool = False) -> DataFrame:
    """Copy the files of a column ``path`` and give one row each: source_path, dest_path, size, hash, verified, error.

    At most ``tasks`` copies run at a time. Errors are rows, or end the job with ``stop_on_error``. A dry run
    gives sizes and empty hashes. Write the result (a manifest) before reading it twice: each use copies again.
    """
    _checked(dest, sources)
    plan = files.select("path", destination(F.col("path"), dest, flatten).alias("dest_path")).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, d in zip(batch.column("path").to_pylist(), batch.column("dest_path").to_pylist()):
                try:
                    out.append((s, d, *((os.path.getsize(s), "", False) if dry_run else _copied(s, d, verify)), None))
                except OSError as e:
                    if stop_on_error:
                        raise
                    out.append((s, d, None, None, False, str(e)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["source_path", "dest_path", "size", "hash", "verified", "error"])

    return plan.mapInArrow(run, _RESULT)


def file_states(entries: DataFrame, path: str) -> DataFrame:
    """What is there now at each path: size and digest of the files that exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("dest_path").to_pylist():
                if p is not None and os.path.isfile(p):
                    with open(p, "rb") as f:
                        out.append((p, os.path.getsize(p), hashlib.file_digest(f, "sha256").hexdigest()))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["dest_path", "size", "hash"])

    return entries.select(F.col(path).alias("dest_path")).distinct().mapInArrow(run, "dest_path string, size long, hash string")


def extract_carved(carved: DataFrame, folder: str, sources: list[str]) -> DataFrame:
    """Write each carved file (image, offset, size, name) out of its image: name, size, hash."""
    _checked(folder, sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for image, offset, size, name in zip(*(batch.column(c).to_pylist() for c in ("image", "offset", "size", "name"))):
                target, digest = os.path.join(folder, name), hashlib.sha256()
                with open(image, "rb") as a, open(f"{target}.part-{os.getpid()}", "wb") as b:
                    a.seek(offset)
                    left = size
                    while left and (block := a.read(min(left, 1 << 20))):
                        digest.update(block)
                        b.write(block)
                        left -= len(block)
                os.replace(f"{target}.part-{os.getpid()}", target)
                out.append((name, size - left, digest.hexdigest()))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["name", "size", "hash"])

    return carved.select("image", "offset", "size", "name").mapInArrow(run, "name string, size long, hash string")


def export_zero_filled(source: str, dest: str, bad_blocks: set[int], block_bytes: int = 4096) -> tuple[int, int]:
    """Copy a file with its unreadable blocks as zeros: bytes copied, bytes zeroed. One file, streamed in one task."""
    copied = zeroed = 0
    size = os.path.getsize(source)
    with open(source, "rb") as a, open(f"{dest}.part", "wb") as b:
        for n, at in enumerate(range(0, size, block_bytes)):
            want = min(block_bytes, size - at)
            if n in bad_blocks:
                b.write(bytes(want))
                zeroed += want
            else:
                a.seek(at)
                b.write(a.read(want))
                copied += want
    os.replace(f"{dest}.part", dest)
    return copied, zeroed


def purge(plan: DataFrame, delete: bool = False) -> DataFrame:
    """Remove the files of a plan (path, size) if ``delete`` says so, else only tell: path, size, deleted, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for p in batch.column("path").to_pylist():
                error = None
                if delete:
                    try:
                        os.remove(p)
                    except FileNotFoundError:
                        pass  # a repeated task has removed it before
                    except OSError as e:
                        error = str(e)
                done.append(delete and error is None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(done), pa.array(errors, pa.string())], names=["path", "size", "deleted", "error"])

    return plan.select("path", F.col("size").cast("long").alias("size")).mapInArrow(run, "path string, size long, deleted boolean, error string")


def html_parts(title: str, kinds: DataFrame, errors: DataFrame, facts: dict[str, str]) -> Iterator[str]:
    """A report page piece by piece: facts, files and bytes per kind (a small table), and all errors with their count, streamed in order."""
    escape = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    rows = kinds.select(html_escaped(F.col("kind")).alias("kind"), "files", size_text(F.col("bytes")).alias("bytes")).orderBy(F.desc("files"), "kind").collect()
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"
    yield "<dl>" + "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in facts.items()) + "</dl>"
    yield "<table><tr><th>Type</th><th>Files</th><th>Size</th></tr>" + "".join(f"<tr><td>{r['kind']}</td><td>{r['files']}</td><td>{r['bytes']}</td></tr>" for r in rows) + "</table>"
    count = errors.count()
    if count:
        yield f"<h2>Errors ({count})</h2><ul>"
        for r in errors.select(html_escaped(F.col("error")).alias("error")).orderBy("error").toLocalIterator():
            yield f"<li>{r[0]}</li>"
        yield "</ul>"
    yield "</body></html>\n"


def html_report(title: str, kinds: DataFrame, errors: DataFrame, facts: dict[str, str]) -> str:
    """The page of ``html_parts`` as one text."""
    return "".join(html_parts(title, kinds, errors, facts))
