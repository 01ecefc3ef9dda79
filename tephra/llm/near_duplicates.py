"""Near-duplicate records by weighted MinHash signatures of hashed darts, and exact verification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import forget, written
from .components import components

_U = np.uint64
#: Cumulated probabilities of 0, 1, 2, ... darts in a cell, one being the mean, as 32-bit thresholds.
_POISSON = np.minimum(np.cumsum([math.exp(-1.0) / math.factorial(n) for n in range(20)]), 1.0) * 2.0**32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, 0 to n[1] - 1 and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row of 64-bit columns is first, and for every row the number of its equal."""
    row = columns[0]
    for c in columns[1:]:
        row = _mix(row) + c
    _, first, which = np.unique(_mix(row), return_index=True, return_inverse=True)
    return first, which


@dataclass(frozen=True)
class Darts:
    """Parameters of the signatures: ``bands`` of ``rows`` coordinates each; another ``seed`` throws other darts."""

    bands: int = 16
    rows: int = 4
    seed: int = 0

    @property
    def k(self) -> int:
        return self.bands * self.rows

    def thrown(self, elements: np.ndarray, weights: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The darts below each element's weight and below the rank ``reach``: element index, coordinate, rank.

        The plane of weight and rank is cut into regions, [2^v - 1, 2^(v+1) - 1) by [2^p - 1, 2^(p+1) - 1), and
        each into 2^p strips of weight by 2^v strips of rank: cells of area 1, each with one dart on average,
        placed by hashes of the element and the cell. Only cells that begin below weight and reach are looked at.
        """
        owners, places, ranks = [], [], []
        v = 0
        while len(high := np.flatnonzero(weights > 2.0**v - 1)):
            p = 0
            while len(at := high[reach[high] > 2.0**p - 1]):
                wide, tall = 2.0 ** (v - p), 2.0 ** (p - v)
                nw = np.minimum(np.ceil((weights[at] - (2.0**v - 1)) / wide), 2.0**p).astype(np.int64)
                nr = np.minimum(np.ceil((reach[at] - (2.0**p - 1)) / tall), 2.0**v).astype(np.int64)
                cell = _counted(nw * nr)
                owner = np.repeat(at, nw * nr)
                strip = np.repeat(nw, nw * nr)
                w, r = cell % strip, cell // strip
                salt = _mix(np.array([(self.seed << 16) + (v << 8) + p + 1], _U))
                seed = _mix(_mix(elements[owner] ^ salt) + (w.astype(_U) << _U(32)) + r.astype(_U))
                n = np.searchsorted(_POISSON, (seed >> _U(32)).astype(np.float64), "right")
                nth = _counted(n)
                cells = np.repeat(np.arange(len(owner)), n)
                h = _mix(seed[cells] + (nth.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
                place = _mix(h ^ _U(0xA5A5A5A5A5A5A5A5))
                weight = 2.0**v - 1 + wide * (w[cells] + (place & _U(0xFFFFFFFF)) / 2.0**32)
                rank = 2.0**p - 1 + tall * (r[cells] + (h >> _U(12)) / 2.0**52)
                inside = (weight < weights[owner[cells]]) & (rank < reach[owner[cells]])
                owners.append(owner[cells][inside])
                places.append(((place >> _U(32)) % _U(self.k)).astype(np.int64)[inside])
                ranks.append(rank[inside])
                p += 1
            v += 1
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate(places)[order], np.concatenate(ranks)[order]

    def signatures(self, elements: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Per record (row r has elements starts[r] to starts[r + 1]) the earliest dart of each coordinate, by rank.

        Darts are thrown as far as a record of its whole weight should need for all coordinates, and twice as far
        again for those that still lack one, so the number of darts follows the coordinates, not the weight or the
        universe. Coordinates agree with the probability of the weighted Jaccard similarity. Records without an
        element of weight above 0 keep the largest value everywhere.
        """
        n, k = len(starts) - 1, self.k
        out = np.full((n, k), np.inf)
        if weights is None:
            weights = np.ones(len(elements))
        weights = np.where(weights > 0, weights, 0.0)
        total = np.diff(np.concatenate([[0.0], np.cumsum(weights)])[starts])
        sizes = np.diff(starts)
        open_ = np.flatnonzero(total > 0)
        need = (k * math.log(max(k, 2)) + k) / total[open_]
        # Reaches are the ends of regions of rank, or powers of two below the first.
        reach = np.where(need > 0.75, 2.0 ** np.round(np.log2(need + 1)) - 1, 2.0 ** np.round(np.log2(need)))
        while len(open_):
            for lo in range(0, len(open_), 4096):
                some, far = open_[lo : lo + 4096], reach[lo : lo + 4096]
                per = sizes[some]
                take = np.repeat(starts[some], per) + _counted(per)
                record, far = np.repeat(some, per), np.repeat(far, per)
                first, which = _same(elements[take], weights[take].view(_U), far.view(_U))
                owner, coordinate, rank = self.thrown(elements[take][first], weights[take][first], far[first])
                many = np.bincount(owner, minlength=len(first))
                begin = np.cumsum(many) - many
                for at in range(0, len(which), 200_000):
                    w, r = which[at : at + 200_000], record[at : at + 200_000]
                    m = many[w]
                    dart = np.repeat(begin[w], m) + _counted(m)
                    np.minimum.at(out.reshape(-1), np.repeat(r, m) * k + coordinate[dart], rank[dart])
            lacking = np.isinf(out[open_]).any(axis=1)
            open_, reach = open_[lacking], reach[lacking]
            reach = np.where(reach >= 1, 2 * reach + 1, 2 * reach)
            out[open_] = np.inf
        return np.where(np.isinf(out), np.iinfo(np.uint64).max, out.view(_U))

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit hash per record and band."""
        grouped = signature.reshape(len(signature), self.bands, self.rows)
        h = np.zeros(grouped.shape[:2], _U) + _mix(np.arange(1, self.bands + 1, dtype=_U))
        for i in range(self.rows):
            h = _mix(h ^ grouped[:, :, i])
        return h

    @property
    def bits(self) -> int:
        return min(self.k, 64)

    def sketches(self, signature: np.ndarray) -> np.ndarray:
        """One bit of each of the first ``bits`` coordinates, in one number per record."""
        bit = _mix(signature[:, : self.bits]) & _U(1)
        return (bit << np.arange(self.bits, dtype=_U)).sum(axis=1, dtype=_U).view(np.int64)

    def alike(self, least: float) -> int:
        """Bits in which sketches of a candidate pair at similarity ``least`` agree but for once in 9,000 times."""
        free, p = self.bits - self.rows, (1 + least) / 2
        return math.floor(self.rows + free * p - 3.7 * math.sqrt(free * p * (1 - p)))


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different substrings of ``width`` code points of each lower-cased text, as sorted hashes, where each text's begin, and how often each occurs."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    ends = np.cumsum([len(t) for t in low])
    codes = np.zeros(len(chars), _U)
    for i in range(width):
        shifted = np.zeros(len(chars), _U)
        shifted[: len(chars) - i] = chars[i:]
        codes = (codes << _U(21)) | shifted if width <= 3 else _mix(codes ^ (shifted + _U(i + 1)))
    owner = np.repeat(np.arange(len(low)), np.diff(ends, prepend=0))
    whole = np.arange(len(chars)) + width <= ends[owner] if len(chars) else np.zeros(0, bool)
    owner, codes = owner[whole], codes[whole]
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(codes))).astype(np.float64)
    return codes[first], np.searchsorted(owner[first], np.arange(len(low) + 1)), times


#: Rows of one band hash, and pairs of near size among them, that meet directly; more are told apart by further bands.
CROWD, CROWD_PAIRS = 65_536, 4_000_000
#: How often that is done. Records that still meet share 4 * rows coordinates, so they are near as a rule and are verified.
LEVELS = 3
#: Logarithmic unit of the size that rides along with a band hash.
_STEP = 0.005


def _pairs_of_runs(kq: np.ndarray, ids: np.ndarray, sketch: np.ndarray, far: int, differ: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids whose keys are equal, sizes at most ``far`` steps and sketches at most ``differ`` bits apart; ``kq`` is sorted."""
    n = np.searchsorted(kq, kq + far, "right") - np.arange(len(kq)) - 1
    ends = np.cumsum(n)
    lo = 0
    while lo < len(kq):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000, "right")), lo + 1)
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        if len(i):
            j = i + 1 + _counted(n[lo:hi])
            near = np.bitwise_count((sketch[i] ^ sketch[j]).view(_U)) <= differ
            x, y = ids[i[near]], ids[j[near]]
            yield np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        lo = hi


def _meeting(far: int, differ: int, last_level: bool):
    """Sorted (kq, id, sketch) of one partition to candidate pairs; the rows of a crowded key come out as (id, NULL, key).

    At the last level no key counts as crowded once it is complete; its pairs come out in slices.
    """
    crowd, most = (1 << 62, 1 << 62) if last_level else (CROWD, CROWD_PAIRS)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key"]
        kq, ids, sketch, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), -1

        def apart(key: int, some: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(np.full(len(some), key))], names=names)

        def met(upto: int) -> Iterator[pa.RecordBatch]:
            """What meets in the first rows, all keys of which are complete."""
            key = kq[:upto] >> 16
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [upto]])
            near = np.searchsorted(kq[:upto], kq[:upto] + far, "right") - np.arange(upto) - 1
            calm = np.ones(upto, bool)
            for r in np.flatnonzero((np.diff(cut) > crowd) | (np.add.reduceat(near, cut[:-1]) > most)).tolist():
                calm[cut[r] : cut[r + 1]] = False
                yield apart(int(key[cut[r]]), ids[cut[r] : cut[r + 1]])
            for a, b in _pairs_of_runs(kq[:upto][calm], ids[:upto][calm], sketch[:upto][calm], far, differ):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=names)

        for batch in batches:
            kq, ids, sketch = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((kq, "kq"), (ids, "id"), (sketch, "sketch")))
            if not len(kq):
                continue
            if crowded >= 0:
                more = int(np.searchsorted(kq, (crowded + 1) << 16))
                if more:
                    yield apart(int(crowded), ids[:more])
                kq, ids, sketch = kq[more:], ids[more:], sketch[more:]
                if not len(kq):
                    continue
                crowded = -1
            last = kq[-1] >> 16
            upto = int(np.searchsorted(kq, last << 16))
            if upto:
                yield from met(upto)
                kq, ids, sketch = kq[upto:], ids[upto:], sketch[upto:]
            if len(kq) > crowd:
                yield apart(int(last), ids)
                crowded, kq, ids, sketch = last, kq[:0], ids[:0], sketch[:0]
        if len(kq):
            yield from met(len(kq))

    return go


def _banded(rows: DataFrame, darts: Darts, width: int, weighted: bool) -> DataFrame:
    """``kq, id, sketch``: for every band the hash of band and what ``key`` the record came by, above 16 bits of its size."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, starts, times = shingles(batch.column("text").to_pylist(), width)
            signature = darts.signatures(codes, starts, times if weighted else None)
            hashes = darts.band_hashes(signature)
            q = np.floor(np.log(batch.column("size").to_numpy().astype(np.float64)) / _STEP).astype(np.int64)
            key = _mix(hashes ^ _mix(batch.column("key").to_numpy().astype(_U))[:, None]) >> _U(17)
            kq = (key.astype(np.int64) << 16) | q[:, None]
            given = (np.repeat(x, darts.bands) for x in (batch.column("id").to_numpy(), darts.sketches(signature)))
            yield pa.RecordBatch.from_arrays([pa.array(kq.reshape(-1)), *map(pa.array, given)], names=["kq", "id", "sketch"])

    return rows.mapInArrow(sign, "kq long, id long, sketch long")


def near_classes(
    records: DataFrame,
    key: str,
    text: str,
    size: str | None = None,
    least: float = 0.75,
    size_ratio: tuple[int, int] = (9, 10),
    width: int = 3,
    darts: Darts = Darts(),
    weighted: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b, similarity`` between the representatives of classes, a < b, each once, and ``id, class`` of the members.

    A class is all records of equal text (in lower case) and size; its smallest key stands for it, and only classes
    of more than one record have rows among the members, their representative with them. Similarity is the Jaccard
    similarity of the texts' sets of ``width``-character substrings, or, ``weighted``, of their bags, where each
    substring weighs as often as it occurs; sizes must be within ``size_ratio``.

    Representatives are signed by DartMinHash, and rows of hash of band and size, key, and a sketch of a bit per
    coordinate, 24 bytes without texts, are shuffled by hash, sorted by hash and size, and swept a batch at a time;
    records of one hash, near size and like sketches are candidates. The same plan serves every amount of data. A hash that over CROWD representatives share, or that
    over CROWD_PAIRS pairs would come from, is told apart by the bands of further darts, up to LEVELS times, rather
    than paired. Candidates get their texts by two joins and are verified exactly. With the defaults a pair at
    similarity 0.75 is missed once in 430 times, one at 0.8 once in 4,000, one at 0.9 once in 10^7; more bands
    lower that and are shuffled in proportion.

    The candidates are made when this function is called, and written to the shared folder; verifying is lazy.
    """
    reach = math.log(size_ratio[1] / size_ratio[0]) + 1e-3
    far = math.ceil(reach / _STEP) + 1
    sized = records[size].cast("long") if size else F.lit(1).cast("long")
    rows = records.select(records[key].cast("long").alias("id"), F.lower(records[text]).alias("text"), sized.alias("size"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("text") >= width) & (F.col("size") > 0))
    one = rows.groupBy("id").agg(F.max(F.struct("text", "size")).alias("r")).select("id", "r.text", "r.size")
    prints = one.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "size")
    copied, copied_at = written(prints.groupBy("h1", "h2", "size").agg(F.min("id").alias("class"), F.max("id").alias("last")).where("class < last").drop("last"), "classes")
    members, _ = written(prints.join(copied, ["h1", "h2", "size"]).select("id", "class"), "members")
    forget(records.sparkSession, copied_at)
    kept = one.join(members.where("id <> class"), "id", "left_anti")

    found, level, left = None, 0, kept.withColumn("key", F.lit(0).cast("long"))
    while left is not None:
        banded = _banded(left.select("id", "text", "size", "key"), replace(darts, seed=darts.seed + level), width, weighted)
        swept = banded.repartition(F.shiftright("kq", 16)).sortWithinPartitions("kq").mapInArrow(_meeting(far, darts.bits - darts.alike(least), level == LEVELS), "a long, b long, key long")
        seen = Observation()
        out, _ = written(swept.observe(seen, F.count("key").alias("crowded")), "candidates")
        pairs = out.where("key IS NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        left = kept.join(out.where("key IS NOT NULL").select(F.col("a").alias("id"), "key").distinct(), "id") if seen.get["crowded"] else None
        level += 1

    side = lambda c: kept.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"), F.col("size").alias(f"size_{c}"))
    # Partitioned by one end, pairs become distinct and meet its text without another shuffle.
    met = found.repartition("a").distinct().join(side("a"), "a").join(side("b"), "b")
    small, large = (f("size_a", "size_b").cast("decimal(20,0)") for f in (F.least, F.greatest))
    met = met.where(small * size_ratio[1] >= large * size_ratio[0])

    def parts(text: str):
        every = (text[i : i + width] for i in range(len(text) - width + 1))
        return Counter(every) if weighted else set(every)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            similarity, held, before = np.zeros(len(left)), None, None
            for n, (x, y) in enumerate(zip(left, right)):
                if y != before:
                    before, held = y, parts(y)
                s = parts(x)
                common = (s & held).total() if weighted else len(s & held)
                total = len(x) + len(y) - 2 * (width - 1) if weighted else len(s) + len(held)
                similarity[n] = common / (total - common)
            near = np.flatnonzero(similarity >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(near), batch.column("b").take(near), pa.array(similarity[near])], names=["a", "b", "similarity"])

    links = met.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long, similarity double")
    return links, members


def near_pairs(records: DataFrame, key: str, text: str, size: str | None = None, least: float = 0.75, size_ratio: tuple[int, int] = (9, 10), width: int = 3, darts: Darts = Darts(), weighted: bool = False) -> DataFrame:
    """``key_a, key_b, similarity`` for records whose sizes and texts are near: key_a < key_b, each pair once.

    The links of ``near_classes`` with every class replaced by its members, and the pairs within each class. This
    lists n * (n - 1) / 2 pairs for n copies of a record, which is what a list of all pairs is; ``near_classes`` or
    ``near_groups`` don't.

    Defined results: NULL keys, texts or sizes and sizes below 1 don't count; nor do texts shorter than
    ``width``; repeated rows are one record (of different rows of one key the greatest by text and size); without
    ``size`` every record may pair; keys are whole numbers. Other columns are never read, whatever they are called.
    """
    links, members = near_classes(records, key, text, size, least, size_ratio, width, darts, weighted)
    kind = dict(records.dtypes)[key]
    of = lambda c: members.select(F.col("class").alias(c), F.col("id").alias(f"id_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"), "similarity")
    within = members.alias("m").join(members.alias("n"), (F.col("m.class") == F.col("n.class")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("x"), F.col("n.id").alias("y"), F.lit(1.0).alias("similarity"))
    return between.unionByName(within).select(F.least("x", "y").cast(kind).alias("key_a"), F.greatest("x", "y").cast(kind).alias("key_b"), "similarity")


def near_groups(records: DataFrame, key: str, text: str, **more) -> DataFrame:
    """``key``, links, group_id: every record with a near one, how many it has, and the smallest key of its group.

    Made from the links of representatives and the members of classes: pairs of copies are counted, never listed.
    Arguments and defined results are those of ``near_pairs``. The work is done when this function is called.
    """
    links, members = near_classes(records, key, text, **more)
    links, at = written(links.select("a", "b"), "links")
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("e")).select("e.*")
    others = ends.join(sizes.select(F.col("class").alias("other"), "n"), "other", "left").groupBy("class").agg(F.sum(F.coalesce("n", F.lit(1))).alias("outside"))
    counted = others.join(sizes, "class", "full_outer").select("class", (F.coalesce("outside", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))
    alone = sizes.select(F.col("class").alias("node"), F.col("class").alias("component"))
    grouped = components(links, "a", "b").unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
    whole = counted.join(grouped, F.col("class") == F.col("node")).join(members, "class", "left")
    kind = dict(records.dtypes)[key]
    return whole.select(F.coalesce("id", "class").cast(kind).alias(key), "links", F.col("component").alias("group_id"))
