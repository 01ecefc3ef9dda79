"""Repairs that are tried again, sessions, checkpoints, totals and reports."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tephra.functions import pictures, texts
from tephra.operators import dedup, search, sectors, state, totals
from tephra.sources import sessions, stores

T = dt.datetime(2031, 1, 1)
FAILURE = "agent string, source string, error string, retries_left int, result string"


def tried(agent, source, repair):
    """Mends what names its own repair, fails others with a new error."""
    return None if repair in source else "permission denied" if "late" in source else "timed out again"


def decisions(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: -r["retries_left"]):
        out.setdefault(r["source"], []).append((r["result"], r["retries_left"]))
    return out


def test_failures_are_tried_again(spark):
    rows = [("Scan", "a-timeout", "Timed out", 3, "x"), ("Embed", "b", "connection refused", None, "x"), ("Scan", "c", "No such file", 3, "x"), ("Scan", "d", "io error", 0, "x"), ("Scan", "late", "cuda", 2, "x"), ("Scan", None, None, 1, "x")]
    df = spark.createDataFrame([r for r in rows if r[1]], FAILURE)
    got = decisions(state.heal(df, tried, pause=lambda s: None))
    assert got["a-timeout"] == [("Healed", 2)] and got["c"] == [("Skipped", 3)] and got["d"] == [("Failed", 0)]
    assert [x for x, _ in got["b"]] == ["Retrying"] * 3 + ["Failed"] or sorted(got["b"]) == [("Failed", 0), ("Retrying", 0), ("Retrying", 1), ("Retrying", 2)]
    assert got["late"] == [("Retrying", 1), ("Skipped", 1)]
    assert state.heal(df.limit(0), tried).count() == 0
    assert state.heal(spark.createDataFrame([(None, None, None, None, None)], FAILURE), lambda *a: None, pause=lambda s: None).first()["result"] == "Healed"


def test_pending_repairs_are_resumed(spark):
    log = spark.createDataFrame(
        [(T, "Scan", "x-network", "refused", 2, "Retrying", 1), (T, "Scan", "done", "refused", 2, "Retrying", 1), (T + dt.timedelta(1), "Scan", "done", "refused", 1, "Healed", 1), (T, "Scan", "out", "refused", 0, "Retrying", 1)],
        stores.HEAL_LOG,
    )
    assert decisions(state.resume_pending(log, tried, pause=lambda s: None)) == {"x-network": [("Healed", 1)]}


def test_sessions_are_kept_listed_and_deleted(spark, tmp_path):
    store = sessions.SessionStore(spark, f"file://{tmp_path}/sessions")
    assert store.load("a") is None and store.sessions().count() == 0 and store.resumable("s") is None
    files = spark.createDataFrame([("p", "done"), ("q", None)], "path string, state string")
    head = {"session": "a", "source": "s", "status": "Running", "created_at": T, "updated_at": T}
    store.save(head, files)
    store.save(head | {"updated_at": T + dt.timedelta(1)}, files.limit(1))
    for n in range(3):
        store.save({"session": f"c{n}", "source": "s", "status": "Completed", "created_at": T, "updated_at": T + dt.timedelta(n + 2)}, files)
    row, kept = store.load("a")
    assert row["updated_at"] == T + dt.timedelta(1) and kept.count() == 1
    assert [r["session"] for r in store.sessions().collect()] == ["c2", "c1", "c0", "a"]
    assert store.resumable("s")["session"] == "a" and store.resumable("t") is None
    assert store.keep_newest(1) == 2 and [r["session"] for r in store.sessions().collect()] == ["c2", "a"]
    with pytest.raises(ValueError):
        store.load("../a")


def test_auto_save_by_number_and_time(spark, tmp_path):
    auto = sessions.AutoSave(every_items=3, every_seconds=30, last=0.0)
    assert [auto.due(now=n) for n in (1, 2, 3, 4, 34, 35)] == [False, False, True, False, True, False]
    path = f"{tmp_path}/check"
    check = stores.Checkpoint(spark, path, "hash", every=2, seconds=1e9)
    for name in "abc":
        check.mark(name)
    assert stores.load_checkpoint(spark, path, "hash").count() == 2
    check.save()
    assert stores.load_checkpoint(spark, path, "hash").count() == 3
    assert stores.clear(spark, path) and not stores.clear(spark, path)
    assert stores.load_checkpoint(spark, path, "hash").count() == 0


def test_bad_sectors_are_added_replaced_and_reported(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "file string, block long") if rows else spark.createDataFrame([], "file string, block long")
    known, files = frame(("a", 1), ("a", 2), ("b", 7)), spark.createDataFrame([("a",)], "file string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sectors.with_bad(known, frame(("a", 1), ("c", 3)))) == [("a", 1), ("a", 2), ("b", 7), ("c", 3)]
    assert rows(sectors.replace_bad(known, frame(("a", 5), ("b", 9)), files, "file")) == [("a", 5), ("b", 7)]
    assert rows(sectors.replace_bad(known, frame(), files, "file")) == [("b", 7)]
    maps = sectors.sector_maps(spark.createDataFrame([("f", 0, 4096, True), ("f", 1, 4096, None)], "file string, block int, size long, bad boolean"), "file", "block", "size", "bad")
    report = sectors.bad_report(maps)
    sectors.write_report(report, f"{tmp_path}/json")
    sectors.write_report(report, f"{tmp_path}/text", as_json=False)
    part = lambda d: open(next(f"{tmp_path}/{d}/{n}" for n in os.listdir(f"{tmp_path}/{d}") if n.startswith("part"))).read()
    assert json.loads(part("json"))["total_bad_bytes"] == 4096 and "Bad blocks: 1" in part("text")


def test_totals_and_windows_of_nothing_and_little(spark):
    files = spark.createDataFrame([(f"/p{i:02}", i or None) for i in range(30)], "path string, size long")
    assert tuple(totals.scan_totals(files).first()) == (30, sum(range(30)), 1)
    assert tuple(totals.scan_totals(files.limit(0)).first()) == (0, 0, 0)
    assert [r["n"] for r in search.around(files.select("path"), "path", "/p10", 4).orderBy("n").collect()] == [8, 9, 10, 11]
    assert search.around(files.limit(0).select("path"), "path", "x", 4).count() == 0
    assert [tuple(r) for r in totals.pipeline_summary(a=files, b=files.limit(0)).orderBy("number").collect()] == [(1, "a", 30), (2, "b", 0)]
    assert search.first_by_path(files, 2).count() == 2
    exact = spark.createDataFrame([("h", 5, 2, 5, "m")], "hash string, size long, files long, wasted_bytes long, master string")
    fuzzy = spark.createDataFrame([("n", 0, 2, 90, 50, "m")], "norm string, cluster int, files long, similarity int, wasted_bytes long, master string")
    assert [tuple(r) for r in dedup.all_groups(exact, fuzzy).collect()] == [("fuzzy", "n#0", 90, 2, 50, "m"), ("exact", "h", 100, 2, 5, "m")]


def test_scalars_of_odd_values(spark):
    one = spark.createDataFrame([(None, 0, 5)], "none long, zero long, five long")
    c = F.col
    got = one.select(
        texts.block_count(c("none")).alias("a"), texts.block_count(c("zero")).alias("b"), texts.throughput(c("five"), c("zero")).alias("c"),
        texts.remaining_seconds(c("zero"), c("five"), c("five")).alias("d"), texts.size_similarity(c("five"), c("zero")).alias("e"),
    ).first()
    assert tuple(got) == (None, 0, 0, None, 0)
    assert pictures.thumbnail_sizes([256, 64, 0, 64]) == [64, 256]


def test_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert stores.read_texts(spark, f"{tmp_path}/a.txt").first()["text"] == "one\ntwo"


def test_a_deep_tree_is_many_tasks(spark, tmp_path):
    from tephra.sources import directory

    for i in range(4):
        for j in range(5):
            (tmp_path / "one" / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / "one" / f"d{i}" / f"e{j}" / "f.txt").write_text("x")
    (tmp_path / "one" / "top.txt").write_text("x")
    reader = directory.DirectoryReader({"path": str(tmp_path), "tasks": "8"})
    parts = reader.partitions()
    assert len(parts) == 1 + 1 + 4 + 20
    whole = sorted(r[0] for p in parts for r in reader.read(p))
    assert whole == sorted({*whole}) and len(whole) == 21
    for tasks in ("1", "2", "1000"):
        other = directory.DirectoryReader({"path": str(tmp_path), "tasks": tasks})
        assert sorted(r[0] for p in other.partitions() for r in other.read(p)) == whole
    scanned = directory.scan(spark, str(tmp_path)).withColumn("read_error", F.when(F.col("path").endswith("top.txt"), "io error"))
    assert [(r["agent"], r["retries_left"]) for r in directory.failures(scanned).collect()] == [("Scan", 3)]


def test_streams_tell_their_progress(spark, tmp_path):
    import time

    from tephra.streaming import progress

    told, ended = [], []
    listener = progress.listen(spark, lambda *x: told.append(x), lambda *x: ended.append(x))
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        rows.writeStream.format("memory").queryName("told").trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while not ended and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told and told[-1][0] == "told" and told[-1][2] == 5 and ended == [("told", None)]


def test_vectors_of_arrow_lists_become_a_matrix():
    import pyarrow as pa

    from tephra.operators.nearest import _matrix

    got = _matrix(pa.array([[1.0, 2.0], None, [3.0], [], [4.0, None], [5.0, 6.0]]).slice(0), 2)
    assert got.tolist() == [[1, 2], [0, 0], [0, 0], [0, 0], [0, 0], [5, 6]]
    assert _matrix(pa.array([[9.0], [1.0, 2.0], [3.0, 4.0]]).slice(1), 2).tolist() == [[1, 2], [3, 4]]
