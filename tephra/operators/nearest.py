"""Exact nearest neighbours of a stated set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass over all rows carries.
BLOCK = 2048


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of a matrix; those of another size, or with NULLs, are zero."""
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        values = np.where(flat.is_valid().to_numpy(zero_copy_only=False), values, np.nan)
    out = np.zeros((len(vectors), width))
    fits = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    starts = (np.cumsum(sizes) - sizes)[fits]
    out[fits] = values[starts[:, None] + np.arange(width)]
    out[np.isnan(out).any(axis=1)] = 0
    return out


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``query, key, similarity, rank``: the ``k`` rows of greatest cosine for every query, ties to the smaller key.

    The queries go out in blocks of one vector size; each task keeps the best ``k`` of its rows per query, so what is ranked
    at last is ``k`` rows a task and query, however many rows there are. A query isn't its own neighbour.
    Vectors that are empty, of another size, or without length have similarity 0.
    """
    kind = dict(rows.dtypes)[key]
    by_size: dict[int, list[list]] = {}
    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        same = by_size.setdefault(len(r[1]), [[]])
        if len(same[-1]) == BLOCK:
            same.append([])
        same[-1].append((r[0], list(r[1])))
    blocks = [b for same in by_size.values() for b in same] or [[]]

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

    def search(block: list):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not block:
                return
            width = len(block[0][1])
            q = unit(np.array([v for _, v in block], np.float64))
            ids = np.array([i for i, _ in block])
            best: dict[int, list] = {i: [] for i in range(len(block))}
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.array(batch.column("key").to_pylist())
                s = q @ unit(_matrix(batch.column("vector"), width)).T
                s[ids[:, None] == keys[None, :]] = -np.inf
                near = np.round(s, 9)  # sums in another order mustn't decide between equals
                take = min(k, s.shape[1])
                for i in range(len(block)):
                    edge = np.partition(near[i], -take)[-take]
                    found = np.flatnonzero(near[i] >= edge)
                    best[i] = sorted(best[i] + [(-near[i, j], keys[j], s[i, j]) for j in found if s[i, j] > -np.inf])[:k]
            out = [(ids[i].item(), b[1].item() if hasattr(b[1], "item") else b[1], float(b[2])) for i, bs in best.items() for b in bs]
            cols = list(zip(*out)) or [[], [], []]
            t = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], t), pa.array(cols[1], t), pa.array(cols[2], pa.float64())], names=["query", "key", "similarity"])

        return go

    candidates = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    out = None
    for block in blocks:
        part = candidates.mapInArrow(search(block), f"query {kind}, key {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
