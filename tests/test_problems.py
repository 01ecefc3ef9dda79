"""Differences, interval coverage and incremental selection against brute force and edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tephra.operators import diff, incremental, intervals

KEYS, FIELDS = ["m", "path"], ["size", "hash", "note"]
SCHEMA = "m long, path string, size long, hash string, note string, seen long, k0 string, version string, side int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def differ(spark, left, right):
    a, b = (spark.createDataFrame([(*r, "x", "y", 1) for r in side], SCHEMA) for side in (left, right))
    rules = {"path": diff.slashes, "hash": diff.bare_hash, "note": diff.blank_as_null}
    return rows(diff.differences(a, b, KEYS, FIELDS, rules, right_version="seen").select("m", "path", "field"))


def test_differences_by_field_and_side(spark):
    left = [(1, "a/b", 5, "AB ", None, 1), (1, "a/b", 5, "AB ", None, 1), (1, "c", 1, "x", "n", 1), (2, "d", 1, None, "", 1), (None, None, 1, "q", None, 1)]
    right = [(1, "a\\b", 5, "ab", "  ", 7), (1, "a\\b", 6, "ab", None, 3), (2, "d", 2, "z", None, None), (3, "e", 1, "x", None, 1), (None, None, 1, "q", None, 1)]
    assert differ(spark, left, right) == [(1, "c", "missing_in_right"), (2, "d", "hash"), (2, "d", "size"), (3, "e", "missing_in_left")]


def test_differences_of_empty_sides_and_ties(spark):
    one = [(1, "a", 5, "h", None, 4)]
    assert differ(spark, [], []) == []
    assert differ(spark, one, []) == [(1, "a", "missing_in_right")]
    assert differ(spark, [], one) == [(1, "a", "missing_in_left")]
    # Of equal versions the greatest by fields counts, whatever the order of the rows.
    tie = [(1, "a", 5, "h", None, 4), (1, "a", 9, "h", None, 4)]
    assert differ(spark, one, tie) == differ(spark, one, tie[::-1]) == [(1, "a", "size")]


def test_residues_equal_except_all(spark):
    r = random.Random(5)
    make = lambda: [(r.randint(0, 3), r.choice("ab"), r.randint(0, 1), r.choice(["h", None]), None, r.randint(0, 9)) for _ in range(30)]
    left, right = make(), make()

    def side(data, versioned):
        best = {}
        for x in data:
            rank = (((x[5],) if versioned else ()) + (x[2], x[3] is not None, x[3] or ""), x)
            if (x[0], x[1]) not in best or rank[0] > best[x[0], x[1]][0]:
                best[x[0], x[1]] = rank
        return {k: v[1][2:5] for k, v in best.items()}

    a, b = side(left, False), side(right, True)
    want = [(*k, "missing_in_right") for k in a.keys() - b.keys()] + [(*k, "missing_in_left") for k in b.keys() - a.keys()]
    want += [(*k, f) for k in a.keys() & b.keys() for f, x, y in zip(FIELDS, a[k], b[k]) if x != y]
    assert differ(spark, left, right) == sorted(want, key=repr)


def covered(spark, data):
    df = spark.createDataFrame([(*x, 1, "s", 2) for x in data], "e string, o long, n long, pid int, entity string, lo long")
    return rows(intervals.coverage(df, "e", "o", "n"))


def brute(data):
    out = []
    for e in sorted({x[0] for x in data if x[0] is not None}):
        merged = []
        for lo, hi in sorted((o, o + n) for d, o, n in data if d == e and o is not None and n is not None and n > 0):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out += [(e, "covered", a, b) for a, b in merged] + [(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_coverage_equals_sorted_sweep(spark, seed):
    r = random.Random(seed)
    data = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, *range(400)]), r.choice([None, 0, -3, 1, 2, 5, 64, 150 if seed else 3])) for _ in range(400)]
    assert covered(spark, data) == brute(data)


def test_coverage_edge_cases(spark):
    assert covered(spark, []) == []
    assert covered(spark, [("a", None, 1), ("a", 5, 0), (None, 1, 1)]) == []
    big = (1 << 62) + 5
    assert covered(spark, [("a", big, 3), ("a", big + 3, 1), ("a", -8, 4), ("a", -8, 4)]) == [("a", "covered", -8, -4), ("a", "covered", big, big + 4), ("a", "gap", -4, big)]
    assert covered(spark, [("a", 1 << 62, (1 << 63) - 1)]) == [("a", "covered", 1 << 62, (1 << 63) - 1)]


def test_sibling_blocks_merge_upward():
    import numpy as np

    start, level = intervals.merge_siblings(np.arange(8, dtype=np.int64), np.zeros(8, np.int64))
    assert start.tolist() == [0] and level.tolist() == [3]
    start, level = intervals.merge_siblings(np.array([1, 2, 3, 4], np.int64), np.zeros(4, np.int64))
    assert list(zip(start.tolist(), level.tolist())) == [(1, 0), (2, 1), (4, 0)]


T = dt.datetime(2031, 1, 1)
RUNS = "run_id long, status string, resumed_from long, id long, counts string"


def test_runs_that_count(spark):
    chain = [(i, "crashed", i - 1 if i else None) for i in range(20)] + [(20, "completed", 19)]
    other = [(30, "failed", None), (31, "running", 30), (40, "failed", 41), (41, "failed", 40), (50, "completed", 50), (60, None, None), (None, "completed", 60)]
    df = spark.createDataFrame([(*x, 1, "c") for x in chain + other + chain[:3]], RUNS)
    assert [r[0] for r in sorted(incremental.counting_runs(df).collect())] == [*range(21), 50]
    assert incremental.counting_runs(df.limit(0)).count() == 0


ENTRY = "path string, size long, modified timestamp, hash string, marked timestamp, key int, content_hash int, my_key int, row int"


def changes(spark, now, before, store=None):
    cur = spark.createDataFrame([(*x, T, 1, 2, 3, 4) for x in now], ENTRY)
    old = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in before], ENTRY)
    state = incremental.state_of(old, "path", ["size", "modified"], {"hash": diff.bare_hash(old["hash"])}, latest=["marked"])
    got = incremental.new_or_changed(cur, state, "path", ["size", "modified"], {"hash": diff.bare_hash(cur["hash"])})
    assert got.columns == cur.columns
    return sorted((r["path"] or "", r["size"] or 0) for r in got.collect())


def test_new_and_changed_rows(spark):
    day = dt.timedelta(days=1)
    before = [("a", 1, T, "H ", T), ("a", 2, T, "H", T - day), ("b", 1, None, None, T), ("c", 1, T, "x", T), ("d", None, T, "x", T), ("f", 1, T, "x", None), ("f", 2, T, "x", T), (None, 1, T, "x", T)]
    now = [("a", 1, T, "h"), ("a", 1, T, "h"), ("b", 1, None, "z"), ("c", 1, T, "y"), ("d", None, T, " X"), ("e", 1, T, "x"), ("e", 1, T, "x"), ("f", 2, T + dt.timedelta(microseconds=1), "x"), (None, 1, T, "x")]
    assert changes(spark, now, before) == [("", 1), ("c", 1), ("e", 1), ("f", 2)]
    assert changes(spark, [], before) == []
    assert len(changes(spark, now, [])) == 7


def test_state_versions_swap_whole(spark, tmp_path):
    store = incremental.StateStore(spark, f"file://{tmp_path}/state")
    assert store.current() == 0 and store.read() is None
    frame = lambda n: spark.range(n).select(F.col("id").alias("key"))
    assert store.commit(frame(3), 0) == 1
    spark.range(9).write.parquet(f"{tmp_path}/state/data/0000000002-died/state")  # a run that died before its claim
    assert store.read().count() == 3
    # Two writers follow version 1: one wins, the other is told, and nothing of it stays.
    other = incremental.StateStore(spark, f"file://{tmp_path}/state")
    assert store.commit(frame(5), 1) == 2 and store.read().count() == 5
    with pytest.raises(incremental.StateConflict):
        other.commit(frame(7), 1)
    assert store.read().count() == 5 and store.read(version=1).count() == 3
    assert store.commit({"state": frame(6), "more": frame(1)}, 2) == 3 and store.read("more").count() == 1
    with pytest.raises(incremental.StateConflict):
        other.commit(frame(7), 0)  # its number has expired, but the state has moved on
    assert store.current() == 3 and sorted(int(p.name[:10]) for p in (tmp_path / "state" / "data").iterdir()) == [2, 3]
    with pytest.raises(Exception):
        incremental.StateStore(spark, "s3a://bucket/state")


def test_runs_follow_each_other(spark, tmp_path, monkeypatch):
    store = incremental.StateStore(spark, f"file://{tmp_path}/state")
    frame = lambda *data: spark.createDataFrame([(*x, T, 1, 2, 3, 4) for x in data], ENTRY)
    run = lambda df: sorted((r["path"], r["size"]) for r in incremental.run_once(df, store, "path", ["size", "modified"], {"hash": diff.bare_hash}).collect())
    one, two, three = ("a", 1, T, "h"), ("b", 1, None, None), ("c", 5, T, "x")
    assert run(frame(one, two, two)) == [("a", 1), ("b", 1)]
    changed = frame(one[:3] + (" H ",), ("b", 2, None, None), three)
    # A run that is killed after its rows are written, before the claim, leaves all to do for the next.
    with monkeypatch.context() as m:
        m.setattr(store, "_claim", lambda *x: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            run(changed)
    assert store.current() == 1
    assert run(changed) == [("b", 2), ("c", 5)]
    assert run(changed) == [] and store.read().count() == 3
    assert run(changed.limit(0)) == [] and store.read().count() == 3


def test_kept_state_is_read_and_moved_on(spark, tmp_path):
    from tephra.plans import problems

    files = [(i, f"p{i}", i, T, "h") for i in range(6)]
    folder = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/{n}.parquet")
    folder("files", files, "file_id long, path string, size long, modified timestamp, hash string")
    runs, marks = "run_id long, status string, resumed_from long", "run_id long, path string, size long, modified timestamp, hash string, marked_at timestamp"
    folder("index_runs", [(1, "completed", None), (2, "crashed", None)], runs)
    folder("checkpoint_entries", [(1, "p0", 0, T, "H", T), (1, "p1", 9, T, "h", T), (2, "p2", 2, T, "h", T)], marks)
    found = lambda: sorted(r[0] for r in problems.p7_found(spark, str(tmp_path)).collect())
    commits = []
    whole = incremental.StateStore.commit
    incremental.StateStore.commit = lambda self, *a, **k: commits.append(a[1]) or whole(self, *a, **k)
    try:
        assert found() == [1, 2, 3, 4, 5] == found() and commits == [0]  # the second time the kept state is read
        folder("index_runs", [(3, "completed", 2)], runs)
        folder("checkpoint_entries", [(3, "p3", 3, T, None, T), (1, "p1", 1, T, "h", T + dt.timedelta(1))], marks)
        assert found() == [4, 5] and commits == [0, 1]
    finally:
        incremental.StateStore.commit = whole
