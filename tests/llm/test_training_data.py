"""Operators for training data against brute force, round trips and edge cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import contamination, near_duplicates, packing, sentences, splitting, survivors
from tephra.llm.components import components
from tephra.llm.queries import VOCABULARY

T = dt.datetime(2031, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Surviving records

COPY = "grp long, rec long, rank int, seen timestamp, a string, b string, g string, r int, vote string"


def elected(spark, data):
    df = spark.createDataFrame([(*x, "q", 1, "v") for x in data], COPY)
    known = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    fields = [
        survivors.Candidate("a", df["a"], df["a"].isNotNull(), survivors.standing(df["rank"], df["seen"])),
        survivors.Candidate("b", df["b"], df["b"].isNotNull(), survivors.shared_vote(df["rank"], df["seen"], F.lit(T).cast("timestamp")), F.lower(df["b"])),
        survivors.Candidate("whole", df["a"], F.lit(True), survivors.standing(df["rank"], df["seen"], known)),
    ]
    return survivors.survivors(df, "grp", "rec", fields)


def test_survivor_takes_each_field_from_the_best_copy(spark):
    us = dt.timedelta(microseconds=1)
    data = [
        (1, 10, 2, T, "x", "P"),
        (1, 11, 1, T, None, "q"),
        (1, 12, 2, T + us, "y", "p"),
        (1, 13, 2, T + us, "y", None),
        (1, 13, 2, T + us, "y", None),
        (2, 20, 5, None, "only", None),
        (None, 30, 1, T, "x", "x"),
        (3, None, 1, T, "x", "x"),
    ]
    got = {r["grp"]: r for r in elected(spark, data).collect()}
    assert set(got) == {1, 2} and got[1]["copies"] == 4 and got[2]["copies"] == 1
    assert got[1]["a"]["record"] == 12 and got[1]["a"]["value"] == "y"  # later by a microsecond, then the smaller id
    # Two copies of trust a third each outweigh one of a half; of the two the smaller record stands for both.
    assert got[1]["b"]["value"] == "P" and got[1]["b"]["record"] == 10
    assert got[1]["whole"]["record"] == 12
    assert got[2]["b"] is None or got[2]["b"]["value"] is None
    assert elected(spark, []).count() == 0


def test_votes_alone_order_copies_by_completeness_rank_and_time(spark):
    r = random.Random(11)
    ranks = [None, 0, 1, 2, 119, 300, 301, 5000, (1 << 31) - 1]
    times = [None, dt.datetime(1, 1, 2), dt.datetime(1970, 1, 1), dt.datetime(1979, 5, 5), T, T + dt.timedelta(microseconds=1), dt.datetime(9999, 1, 1)]
    data = [(r.randint(1, 60), i, r.choice(ranks), r.choice(times), r.choice([None, "x"]), r.choice([None, "y"])) for i in range(600)]
    got = {x["grp"]: x for x in elected(spark, data).collect()}
    least = dt.datetime(1, 1, 1)

    def best(copies, known):
        return min(copies, key=lambda c: (-known(c), c[2] if c[2] is not None else 1 << 32, least - (c[3] or least), c[1]))[1]

    for g, x in got.items():
        copies = [c for c in data if c[0] == g]
        assert x["whole"]["record"] == best(copies, lambda c: (c[4] is not None) + (c[5] is not None))
        with_a = [c for c in copies if c[4]]
        assert (x["a"]["record"] if x["a"] else None) == (best(with_a, lambda c: 0) if with_a else None)


def test_survivor_votes_add_up_by_normalised_value(spark):
    data = [(1, 1, 1, T, None, "lone"), *((1, i, 2, T, None, "Many" if i % 2 else "MANY") for i in range(2, 6))]
    b = elected(spark, data).first()["b"]
    assert b["value"] == "MANY" and b["record"] == 2


# Linked groups


def brute_groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


def grouped(spark, pairs):
    return sorted(rows(components(spark.createDataFrame([(*p, 1, "x") for p in pairs], "l long, r long, node int, root string"), "l", "r")))


def test_components_of_chains_stars_and_noise(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    r.shuffle(chain)
    star = [(500, i) for i in range(300, 330)] + [(i, 501) for i in range(310, 312)]
    noise = [(r.randint(1, 90), r.randint(1, 90)) for _ in range(50)] + [(None, 1), (2, None), (7, 7), (9999, 9999)]
    pairs = chain + star + noise + noise
    assert grouped(spark, pairs) == brute_groups(pairs)
    assert grouped(spark, []) == [] and grouped(spark, [(5, 5), (None, None)]) == []


def test_components_with_hot_nodes(spark, monkeypatch):
    import tephra.llm.components as module

    monkeypatch.setattr(module, "HOT_LINKS", 3)
    monkeypatch.setattr(module, "HOT_NODES", 40)
    pairs = [(50, i) for i in range(60, 90)] + [(i, 49) for i in (60, 70)] + [(1, 50), (200, 201)]
    assert grouped(spark, pairs) == brute_groups(pairs)


def test_components_of_long_chains_keep_a_small_plan(spark):
    r = random.Random(7)
    names = list(range(3000))
    r.shuffle(names)
    up = [(i, i + 1) for i in range(10_000, 13_000)]  # every label lies behind the one before it
    pairs = list(zip(names, names[1:])) + up + [(i, 20_000 + i % 7) for i in range(30_000, 30_200)]
    df = spark.createDataFrame(pairs, "l long, r long")
    got = components(df, "l", "r")
    assert sorted(map(tuple, got.collect())) == brute_groups(pairs)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2


# Splitting


def check_pieces(text, limit, overlap, least=0):
    got = splitting.pieces(text, limit, overlap, least)
    size = lambda t: len(t.encode())
    assert "".join(text[f:e] for _, f, e, _ in got) == text
    assert all(size(text[s:e]) <= max(limit, 4) for s, f, e, _ in got)
    assert all(0 <= s <= f <= e for s, f, e, _ in got)
    return [text[s:e] for s, f, e, _ in got], [level for *_, level in got]


def test_pieces_prefer_large_boundaries():
    text = "# One\n\nFirst words here. Second words.\n\nOther part of it.\n\n# Two\n\nLast words here."
    got, levels = check_pieces(text, 45, 0)
    assert [p.split()[0] for p in got] == ["#", "Other"] or [p.split()[0] for p in got] == ["#", "Other", "Last"] and levels[0] == 1
    got, _ = check_pieces("aaa bbb ccc ddd eee fff", 12, 4)
    assert got[:2] == ["aaa bbb ccc ", "ccc ddd eee "]


@pytest.mark.parametrize("seed", range(20))
def test_pieces_cover_and_are_forced_only_where_needed(seed):
    r = random.Random(seed)
    text = "".join(r.choice([" ", "\n", "\n\n", ". ", "。", "x" * r.randint(1, 40), "é漢" * r.randint(1, 9), "\U0001f600"]) for _ in range(60))
    for limit, overlap in ((16, 4), (40, 10), (40, 0), (64, 60)):
        _, levels = check_pieces(text, limit, overlap, r.choice([0, 8]))
        import re

        longest = max(len(p.encode()) for p in re.split(r"[ \t\n\r。！？]", text))
        if len(text.encode()) > limit:
            assert (4 in levels) == (longest > limit)


def test_split_texts_edge_cases(spark):
    data = [(1, None, 10, 2), (2, "", 10, 2), (3, "short", 10, 2), (4, "y" * 3000, None, None), (5, "漢字" * 40, 10, 20), (5, "漢字" * 40, 10, 20), (None, "a b " * 9, 8, 2), (6, "abc def", 0, 1)]
    df = spark.createDataFrame([(*x, 1, "k") for x in data], "id long, text string, n long, o long, piece int, key string")
    got = splitting.split_texts(df, "id", "text", df["n"], df["o"]).collect()
    assert {r["id"] for r in got} == {4, 5, None}
    assert all(r["n_bytes"] <= 1024 for r in got) and {r["cut"] for r in got if r["id"] == 4} == {"character", "end"}
    assert "".join(r["content"][r["fresh_pos"] - r["start_pos"] :] for r in sorted((r for r in got if r["id"] == 4), key=lambda r: r["piece"])) == "y" * 3000
    assert splitting.split_texts(df.limit(0), "id", "text", df["n"], df["o"]).count() == 0


# Near duplicates

FILE = "id long, path string, size long, band int, home string, text string"


def near(spark, data, **more):
    df = spark.createDataFrame([(*x, 1, "h", "t") for x in data], FILE)
    got = [tuple(r) for r in near_duplicates.near_pairs(df, "id", "path", "size", **more).select("key_a", "key_b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute_near(data, least=0.75):
    one = {i: ({p.lower()[k : k + 3] for k in range(len(p) - 2)}, s) for i, p, s in data if i is not None and p is not None and s is not None and s > 0 and len(p) > 2}
    return {(a, b) for a, (x, s) in one.items() for b, (y, t) in one.items() if a < b and min(s, t) * 10 >= max(s, t) * 9 and len(x & y) / len(x | y) >= least}


def some_files(seed=3):
    r = random.Random(seed)
    data = []
    for i in range(0, 300, 3):
        base = "/mnt/" + "".join(r.choice("abcdefgh") for _ in range(30))
        for j in range(3):
            at = r.randrange(5, 30)
            data.append((i + j, base[:at] + r.choice(["", "x", "É", "-1"]) + base[at:], r.choice([900, 950, 1000, 1000, 1000, 5])))
    return data + data[:20] + [(900, None, 10), (901, "/a", 10), (902, "/abcabcabc", None), (903, "/abcabcabc", 0), (None, "/abcabcabc", 5), (904, "/ABCABCABC", 7), (905, "/abcabcabc", 7), (906, "", 3)]


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    data = some_files()
    want = brute_near(data)
    assert len(want) > 50
    assert near(spark, data) == want
    assert near(spark, []) == set()
    # Crowded band hashes are told apart by further bands.
    monkeypatch.setattr(near_duplicates, "CROWD_PAIRS", 1)
    assert near(spark, data) == want
    monkeypatch.setattr(near_duplicates, "CROWD", 2)
    assert near(spark, data) == want


def test_weighted_near_pairs_equal_brute_force(spark):
    from collections import Counter

    r = random.Random(8)
    data = [(i, "ab" * r.randint(5, 40) + r.choice(["", "xyz", "abab"]) + "q" * r.randint(3, 20), r.choice([100, 104])) for i in range(80)]
    bag = lambda p: Counter(p[k : k + 3] for k in range(len(p) - 2))
    alike = lambda p, q: (bag(p) & bag(q)).total() / (bag(p) | bag(q)).total() >= 0.75
    want = {(i, j) for i, p, s in data for j, q, z in data if i < j and min(s, z) * 10 >= max(s, z) * 9 and alike(p, q)}
    got = near(spark, data, weighted=True, darts=near_duplicates.Darts(bands=30))
    assert got <= want and len(got) >= 0.99 * len(want) and want != brute_near(data)


def brute_links(data):
    pairs = brute_near(data)
    count, groups = {}, dict(brute_groups(pairs))
    for p in pairs:
        for x in p:
            count[x] = count.get(x, 0) + 1
    return sorted((x, n, groups[x]) for x, n in count.items())


def test_near_groups_count_links_without_listing_copies(spark):
    data = some_files(5) + [(1000 + i, "/Copies/Of One/File.txt", 77) for i in range(40)] + [(1100, "/copies/of one/file.txt", 78), (1101, "/copies/of one/files.txt", 80)]
    df = spark.createDataFrame([(*x, 1, "h", "t") for x in data], FILE)
    assert rows(near_duplicates.near_groups(df, "id", "path", size="size")) == sorted(brute_links(data), key=repr)
    assert near(spark, data) == brute_near(data)
    many = spark.range(50_000).select("id", F.lit("/a/folder/of/equal/paths.txt").alias("path"), F.lit(9).alias("size"))
    got = near_duplicates.near_groups(many, "id", "path", size="size").groupBy("links", "group_id").count().collect()
    assert [tuple(r) for r in got] == [(49_999, 0, 50_000)]


@pytest.mark.parametrize("batch,crowd", [(1, 3), (3, 3), (7, 3), (50, 1000), (2, 1)])
def test_sweep_takes_keys_across_batches(monkeypatch, batch, crowd):
    import pyarrow as pa

    monkeypatch.setattr(near_duplicates, "CROWD", crowd)
    r = random.Random(batch)
    data = sorted((k << 16 | r.randint(0, 9), r.randint(0, 40)) for k in range(30) for _ in range(r.choice([1, 1, 2, 3, 8])))
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in data[i : i + batch]]), *[pa.array([y for _, y in data[i : i + batch]])] * 2], names=["kq", "id", "sketch"]) for i in range(0, len(data), batch)]
    out = [tuple(x.values()) for b in near_duplicates._meeting(4, 2, False)(iter(batches)) for x in b.to_pylist()]
    apart = sorted((k, a) for a, _, k in out if k is not None)
    by_key = {}
    for kq, i in data:
        by_key.setdefault(kq >> 16, []).append((kq, i))
    assert apart == sorted((k, i) for k, v in by_key.items() if len(v) > crowd for _, i in v)
    want = sorted((min(i, j), max(i, j)) for v in by_key.values() if len(v) <= crowd for n, (x, i) in enumerate(v) for y, j in v[n + 1 :] if i != j and y - x <= 4 and (i ^ j).bit_count() <= 2)
    assert sorted((a, b) for a, b, k in out if k is None) == want


@pytest.mark.parametrize("scale", [3.0, 1e-3, 1e5])
def test_dart_signatures_estimate_weighted_similarity(scale):
    darts = near_duplicates.Darts(bands=128, rows=8)
    r = np.random.default_rng(4)
    ids = r.integers(0, 1 << 60, 40).astype(np.uint64)
    x, y = r.uniform(0, scale, 40), r.uniform(0, scale, 40)
    x[:5], y[3:8] = 0, 0
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    got = darts.signatures(np.concatenate([ids, ids]), np.array([0, 40, 80]), np.concatenate([x, y]))
    assert abs((got[0] == got[1]).mean() - want) < 0.06
    alone = darts.signatures(ids[:1], np.array([0, 0, 1]), np.array([1e-9 * scale]))
    assert (alone[0] == np.iinfo(np.uint64).max).all() and (alone[1] != np.iinfo(np.uint64).max).all()


# Packing


def test_differencing_balances():
    sizes = np.array([8, 7, 6, 5, 4])
    part = packing.differencing(sizes, 2)
    assert set(part.tolist()) == {0, 1} and abs(int(sizes[part == 0].sum()) * 2 - 30) <= 4
    assert len(set(packing.differencing(sizes, 5).tolist())) == 5 and set(packing.differencing(sizes[:1], 3).tolist()) == {0}


def first_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    return len(rooms)


@pytest.mark.parametrize("low,high", [(50, 1500), (1, 300), (400, 800), (1, 2048), (600, 700), (10, 20)])
def test_windows_are_about_as_few_as_first_fit_decreasing_needs(low, high):
    r = random.Random(low)
    sizes = [r.randint(low, high) for _ in range(1000)]
    assert len(packing.windows(sizes, 2048)) <= 1.02 * first_fit_decreasing(sizes, 2048) + 1


@pytest.mark.parametrize("seed", range(8))
def test_windows_hold_everything_and_are_never_too_full(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, r.randint(1, 100), r.randint(60, 100)]) for _ in range(r.randint(0, 120))]
    got = packing.windows(sizes, 100)
    assert sorted(i for p in got for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 100 for p in got)
    assert len(got) <= max(1, 1.25 * math.ceil(sum(sizes) / 100) + sum(2 * s > 100 for s in sizes) + 1)


def test_pack_texts(spark):
    long = "Déjà 漢字 words. " * 400
    data = [(1, "s", long, 64), (2, "s", "", 64), (3, None, "a b c", None), (4, "s", None, 64), (None, "s", "x", 64), *((i, "s", "some words here", 64) for i in range(10, 40)), (10, "s", "some words here", 64), (99, "t", "q" * 5000, 32)]
    df = spark.createDataFrame([(*x, 1, "k") for x in data], "id long, src string, text string, cap long, window int, key string")
    got = packing.pack(df, "id", "text", "src", df["cap"], VOCABULARY, block_items=16).collect()
    parts = sorted((r["start_pos"], r["end_pos"]) for r in got if r["id"] == 1)
    assert "".join(long[a:b] for a, b in parts) == long
    assert {r["id"] for r in got} == {1, 2, 3, 99, *range(10, 40)} and sum(r["id"] == 10 for r in got) == 2
    load = {}
    for r in got:
        k = (r["src"], r["block"], r["window"], r["capacity"])
        load[k] = load.get(k, 0) + r["tokens"]
    assert all(v <= k[3] for k, v in load.items())
    assert packing.pack(df.limit(0), "id", "text", "src", df["cap"], VOCABULARY).count() == 0


# Leaks


def brute_leak(doc, item, run, errors):
    d, i = contamination.letters_and_digits(doc), contamination.letters_and_digits(item)
    return any(contamination.myers_distance(i[k : k + run], d, errors) <= errors for k in range(len(i) - run + 1))


def test_myers_distance_equals_dynamic_programming():
    r = random.Random(2)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            prev, row = row, [i]
            for j, d in enumerate(t, 1):
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != d)))
        assert contamination.myers_distance(p, t, 99) == min(row)


@pytest.mark.parametrize("run,errors", [(16, 0), (16, 1), (20, 2)])
def test_leaks_equal_brute_force(run, errors):
    r = random.Random(run + errors)
    q = contamination.piece_length(run, errors)
    for _ in range(150):
        item = "".join(r.choice("abcdef") for _ in range(30))
        part = list(item[r.randint(0, 10) :][: run + 2])
        for _ in range(r.randint(0, errors + 1)):
            part[r.randrange(len(part))] = r.choice(["", "z", "ab"])
        doc = "xyxy" * 3 + "".join(part) + "wvwv"
        items = {("i", 0): item}
        assert bool(contamination.leaks_in(doc, contamination._automaton(items, q), items, q, run, errors)) == brute_leak(doc, item, run, errors)


def test_leaked_edge_cases(spark, monkeypatch):
    passage = "The quick brown fox jumps over the lazy dog near 12 rivers"
    docs = [(1, "intro " + passage.upper().replace(" ", "-") + " end"), (1, "again " + passage), (2, passage[:30]), (3, None), (4, ""), (None, passage), (5, "٣" * 50), (6, "z " * 100_000 + passage)]
    items = [(7, passage), (7, passage), (8, None), (9, "short"), (None, passage), (7, "another passage that appears nowhere at all in these documents"), (10, "٣" * 45)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc long, text string, item int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item long, text string, doc int")
    want = [(1, 7), (5, 10), (6, 7)]
    assert rows(contamination.leaked(d, i, "doc", "item")) == want
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 10)
    assert rows(contamination.leaked(d, i, "doc", "item")) == want
    assert rows(contamination.leaked(d.limit(0), i, "doc", "item")) == rows(contamination.leaked(d, i.limit(0), "doc", "item")) == []


# Sentences

CASES = [
    ("Dr. Who left at 5 p.m. It rained. See fig. 3, p. 9.", ["Dr. Who left at 5 p.m.", "It rained.", "See fig. 3, p. 9."]),
    ('He asked "Is it so? Yes!" and left. “Stop. Now,” she said, “and stay.” It cost 3.50 units.', ['He asked "Is it so? Yes!" and left.', "“Stop. Now,” she said, “and stay.”", "It cost 3.50 units."]),
    ("Am 5. März kam z. B. Fr. Dr. Ott. Nein. Vgl. Abs. 3.", ["Am 5. März kam z. B. Fr. Dr. Ott.", "Nein.", "Vgl. Abs. 3."]),
    ("« Est-il là ? » demande M. Roy. Non, c.-à-d. jamais ! Oui.", ["« Est-il là ? » demande M. Roy.", "Non, c.-à-d. jamais !", "Oui."]),
    ("¿Qué? «¡No!», dijo la Dra. Sol. El Sr. Gil vio aprox. 3.", ["¿Qué?", "«¡No!», dijo la Dra. Sol.", "El Sr. Gil vio aprox. 3."]),
    ("请停止！“读取失败。先别动它！”记录员写道。不。", ["请停止！", "“读取失败。先别动它！”记录员写道。", "不。"]),
    ("係は「だめ。触るな！」と書いた。終わった…と残る。", ["係は「だめ。触るな！」と書いた。", "終わった…と残る。"]),
    ("“फ़ाइल खो गई। रुकिए।” Ann ने लिखा। डॉ. Bo आए।", ["“फ़ाइल खो गई। रुकिए।” Ann ने लिखा।", "डॉ. Bo आए।"]),
    ("قال د. Bo إنه اختفى. هل لم يستجب؟ لا.", ["قال د. Bo إنه اختفى.", "هل لم يستجب؟", "لا."]),
    ("ห้ามแตะดิสก์ ไฟล์หายไปแล้ว", ["ห้ามแตะดิสก์", "ไฟล์หายไปแล้ว"]),
    ("# A. B\n- c. d\n2031-01-02T03:04:05Z x. y\n```\na. b\n```\none\r\ntwo.\r\n\r\nthree", ["# A. B", "- c. d", "2031-01-02T03:04:05Z x. y", "```", "a. b", "```", "one\r\ntwo.", "three"]),
    ("The tool names it ไฟล์ in the log file today. It is fine. Ask Dr. Wu.", ["The tool names it ไฟล์ in the log file today.", "It is fine.", "Ask Dr. Wu."]),
    ("ถาม Dr. Wu แล้วห้ามแตะดิสก์", ["ถาม", "Dr. Wu", "แล้วห้ามแตะดิสก์"]),
    ("See the file art. Then go on. See art. 5 of it. The disk sda1 failed. sdb2 is fine.", ["See the file art.", "Then go on.", "See art. 5 of it.", "The disk sda1 failed.", "sdb2 is fine."]),
    ("Файл стёрт, см. рис. 3. Диск цел, т. е. всё хорошо! Готово?", ["Файл стёрт, см. рис. 3.", "Диск цел, т. е. всё хорошо!", "Готово?"]),
    ("Πού είναι; Βλ. σελ. 3. Τέλος.", ["Πού είναι;", "Βλ. σελ. 3.", "Τέλος."]),
    ("파일이 없다. 디스크는 3.5 GB이다! 왜? 끝.", ["파일이 없다.", "디스크는 3.5 GB이다!", "왜?", "끝."]),
    ("It ended.Then it began. (See it. Now.) Done...", ["It ended.", "Then it began.", "(See it. Now.)", "Done..."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_sentence_time_is_linear():
    import time

    for text in ("Some words here. " * 120_000, "(word’s. " * 200_000, "ไฟล์หาย " * 200_000):
        began = time.thread_time()
        assert sentences.sentence_spans(text)
        assert time.thread_time() - began < 30


def test_sentence_units_lose_nothing_but_blanks():
    r = random.Random(6)
    for _ in range(200):
        text = "".join(r.choice(["a", "B. ", "! ", "“", "”", "(", ")", "\n", "\n\n", "。", "…", "9.5 ", "# ", "```", "ไทย ", "« ", " »"]) for _ in range(40))
        spans = sentences.sentence_spans(text)
        assert spans == sorted(spans) and all(a < b <= c for (a, b), (c, _) in zip(spans, [*spans[1:], (len(text), 0)]))
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_sentences_edge_cases(spark):
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "One. Two."), (4, "One. Two."), (None, "x"), (5, "w" * 200_000)]
    df = spark.createDataFrame([(*x, 1, "k") for x in data], "id long, text string, start_pos int, key string")
    assert rows(sentences.sentences(df, "id", "text")) == sorted([(4, 0, 4), (4, 5, 9)] * 2 + [(None, 0, 1), (5, 0, 200_000)], key=repr)
    assert sentences.sentences(df.limit(0), "id", "text").count() == 0
