"""Carving, chunking, keyword and vector search, logs and streams."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tephra.functions import signatures as sig
from tephra.functions import vectors
from tephra.operators import carve, chunking, nearest, state, text_search
from tephra.plans import text_queries
from tephra.sources import images, sinks
from tephra.streaming import incremental

T = dt.datetime(2031, 1, 1)
BYTE = carve.CarveOptions(aligned=False, min_size=100)


def image(size, **parts):
    data = bytearray(size)
    for at, value in parts.items():
        at = int(at[1:])
        data[at : at + len(value)] = value
    return bytes(data)


JPEG, END = b"\xff\xd8\xff\xe0", b"\xff\xd9"


def test_carve_boundaries():
    assert carve.carve_bytes(image(4096, _0=JPEG, _2000=END), BYTE) == [(0, 2002, "JPEG", "jpg", "Image", "FooterScan")]
    assert carve.carve_bytes(image(8192, _0=b"BM" + struct.pack("<I", 1024)), BYTE) == [(0, 1024, "BMP", "bmp", "Image", "InternalSize")]
    two = carve.carve_bytes(image(8192, _0=JPEG, _4096=JPEG, _6000=END), BYTE)
    assert [(r[0], r[1], r[5]) for r in two] == [(0, 4096, "NextHeader"), (4096, 1906, "FooterScan")]
    mixed = image(8192, _0=JPEG, _2000=END, _4096=b"%PDF-1", _5000=b"%%EOF")
    assert [r[2] for r in carve.carve_bytes(mixed, carve.CarveOptions(False, 100, ("Image",)))] == ["JPEG"]
    assert [r[2] for r in carve.carve_bytes(mixed, BYTE)] == ["JPEG", "PDF"]
    assert carve.carve_bytes(JPEG + bytes(6) + END, BYTE) == [] and carve.carve_bytes(bytes(65536)) == [] and carve.carve_bytes(b"") == []


def test_header_hits_by_alignment_and_offset():
    hits = lambda data, **o: carve.header_hits(data, 0, len(data), carve.CarveOptions(**o), sig.SIGNATURES)
    name = lambda h: sig.SIGNATURES[h[1]].name
    assert [h[0] for h in hits(image(2048, _512=JPEG))] == [512] and hits(image(2048, _100=JPEG)) == []
    assert [h[0] for h in hits(image(2048, _100=JPEG), aligned=False)] == [100]
    assert name(hits(image(1024, _0=b"\0\0\0\x1cftypisom"))[0]) == "HEIF/HEIC"
    assert name(hits(image(1024, _257=b"ustar"))[0]) == "TAR"
    assert name(hits(image(1024, _0=b"RIFF"))[0]) == "WebP"


@pytest.mark.parametrize("seed", range(4))
def test_hits_equal_a_plain_search(seed):
    r = random.Random(seed)
    data = bytearray(6000)
    for _ in range(25):
        s = r.choice(sig.SIGNATURES)
        at = r.randrange(0, 5900)
        data[at : at + len(s.header)] = s.header
    data = bytes(data[:6000])
    for step, aligned in ((1, False), (512, True)):
        want = []
        for p in range(0, 6000, step):
            found = [i for late in (False, True) for i, s in enumerate(sig.SIGNATURES) if (s.offset > 0) == late and data[p + s.offset : p + s.offset + len(s.header)] == s.header]
            if found:
                want.append((p, found[0]))
        assert carve.header_hits(data, 0, 6000, carve.CarveOptions(aligned=aligned), sig.SIGNATURES) == want


def test_parsers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 13, b"IHDR") + bytes(17) + struct.pack(">I4s", 0, b"IEND") + bytes(4)
    assert sig.png_size(png + b"rest") == len(png) and sig.png_size(png[:20]) is None
    assert sig.bmp_size(b"BM" + struct.pack("<I", 2048)) == 2048 and sig.bmp_size(b"BM" + struct.pack("<I", 3)) is None
    assert sig.riff_size(b"RIFF" + struct.pack("<I", 500)) == 508 and sig.riff_size(b"RIFF") is None
    assert sig.zip_size(b"PK\x03\x04abc" + b"PK\x05\x06" + bytes(16) + struct.pack("<H", 2) + b"hi") == 31
    assert sig.mp4_size(struct.pack(">I4s", 16, b"ftyp") + bytes(8) + struct.pack(">I4s", 8, b"mdat")) == 24 and sig.mp4_size(b"\0\0\0\4xxxx") is None
    assert [sig.find_footer(b"abcabc", b"bc", n) for n in (0, 2, 5)] == [1, 4, None] and sig.find_footer(b"abc", b"", 0) is None
    ftyp = next(s for s in sig.SIGNATURES if s.name == "MP4")
    assert [sig.resolved_extension(ftyp, b"\0\0\0\x18ftyp" + b) for b in (b"isom", b"M4A ", b"qt  ", b"3gp5")] == ["mp4", "m4a", "mov", "3gp"]
    assert len(sig.SIGNATURES) == 70


def test_pictures_and_sniffing(spark):
    from tephra.functions import pictures

    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + bytes(10) + b"\xff\xda"
    assert pictures.orientation(jpeg) == 6 and pictures.dimensions(jpeg) == (40, 30)
    assert pictures.orientation(b"\xff\xd8\xff") == 1 and pictures.dimensions(b"none") is None
    assert pictures.dimensions(b"GIF89a" + struct.pack("<HH", 7, 8)) == (7, 8)
    assert pictures.dimensions(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 5, 6)) == (5, 6)
    assert [tuple(r[0]) for r in spark.range(1).select(pictures.fitted(F.lit(400), F.lit(100), 200)).collect()] == [(200, 50)]
    assert [sig.sniffed(b) for b in (jpeg, b"\0\0\0\x18ftypM4A ", b"GG")] == ["jpg", "m4a", None]
    options = carve.CarveOptions(False, 100, ("Image",), sniff=True)
    assert carve.carve_bytes(image(4096, _0=JPEG, _2000=END), options)[0][3] == "jpg"


def test_image_files_carved_in_blocks(spark, tmp_path):
    data = image(20_000, _512=JPEG, _3000=END, _5120=b"%PDF-1", _9000=b"%%EOF", _10240=JPEG, _12000=END)
    p, out = str(tmp_path / "a.dd"), str(tmp_path / "out")
    (tmp_path / "a.dd").write_bytes(data)
    options = carve.CarveOptions(min_size=100)
    blocks = images.image_blocks(spark, [p], 1024)
    found = carve.hits(blocks, "image", F.col("content"), F.col("base"), F.col("owned"), options)
    carved = carve.carve_files(found, "image", options)
    got = sorted(tuple(r)[1:] for r in carved.collect())
    assert got == carve.carve_bytes(data, options) and len(got) == 3
    named = carved.withColumn("name", carve.carved_name(F.lit(0), F.col("offset"), F.col("extension")))
    sinks.extract_carved(named, out, [str(tmp_path / "other")]).collect()
    assert (tmp_path / "out" / "00000000_000000000200.jpg").read_bytes() == data[512:3002]
    with pytest.raises(Exception):
        (tmp_path / "e.dd").write_bytes(b"")
        images.image_blocks(spark, [str(tmp_path / "e.dd")]).count()
    states = images.read_blocks(spark.createDataFrame([(p,)], "path string"), "path").collect()
    assert [r["bytes"] for r in states] == [4096] * 4 + [3616] and not any(r["bad"] for r in states)


# Chunks


def test_text_chunks_end_at_sentences_and_overlap():
    text = "First sentence is here. Second sentence is here too. Third one follows after that. Fourth one ends it all."
    got = chunking.text_pieces(text, "a.txt", chunking.ChunkConfig(50, 20, 10))
    assert len(got) > 1 and got[0][0] == 0 and got[-1][1] == len(text)
    a, b = got[0][:2]
    assert text[:b].endswith(".") and text[b - 20 : b] in text[got[1][0] : got[1][1]]
    assert chunking.text_pieces("", "a.txt", chunking.ChunkConfig()) == []


def test_markdown_code_and_pdf_chunks():
    md = "# One\n\nSome words under one.\n\n## Two\n\nSome more words under two.\n```\n# not a heading\n```\n"
    got = chunking.markdown_pieces(md, "a.md", chunking.ChunkConfig(200, 10, 10))
    assert [(m["heading"], md[a : a + 5]) for a, _, _, m in got] == [("# One", "# One"), ("## Two", "## Tw")]
    assert chunking.code_pieces("fn a() {\n}\n\nfn b() {\n}\n", "x.rs", chunking.ChunkConfig(12, 0, 1))[0][3] == {"language": "rust"}
    assert chunking.pdf_pieces(" ", "x.pdf", chunking.ChunkConfig()) == [(0, 0, "pdf", {"scanned": "true"})]


def test_chunks_by_media(spark):
    docs = [(1, "# A\n" + "word " * 400, "markdown"), (2, "plain. " * 400, "text"), (3, "", "text"), (4, None, "pdf"), (5, "x", "binary"), (6, "img", "image"), (7, "odd one", None)]
    df = spark.createDataFrame([(*d, 9) for d in docs], "id long, text string, media string, index int")
    got = chunking.by_media(df, "id", "text", F.lit("f.txt"), df["media"]).collect()
    assert {r["id"] for r in got} == {1, 2, 4, 6, 7}
    assert all(r["total"] == sum(x["id"] == r["id"] for x in got) for r in got)
    chunking.register("text", lambda t, s, c: 1 / 0)
    try:
        bad = chunking.by_media(df, "id", "text", F.lit("f.txt"), df["media"]).where("id = 2").first()
        assert "division" in bad["metadata"]["extraction_error"]
    finally:
        chunking.register("text", chunking.text_pieces)


def test_registered_chunks_go_on_within_the_overlap(spark, tmp_path):
    text = "a" * 298 + "\n\n" + "b" * 98 + "\n\n" + "c" * 2000
    spark.createDataFrame([(1, text, "text"), (2, text, "pdf")], "doc_id long, text string, media_type string").write.parquet(str(tmp_path / "documents.parquet"))
    start, spans = 0, []
    while start < 2400:  # the rule of the survey's C2
        end = 2400 if start + 1024 >= 2400 else next((e for e in (300, 400) if e > start + 1), start + 1024)
        if end - start >= 64 or not spans or end == 2400:
            spans.append((start, end))
        start = 2400 if end == 2400 else max(end - 128, start + 1)
    got = text_queries.chunk_by_media(spark, str(tmp_path)).orderBy("doc_id", "index").collect()
    assert [(r["doc_id"], r["start_pos"], r["end_pos"]) for r in got] == [(d, *s) for d in (1, 2) for s in spans]
    assert (173, 300) in spans and all(r["content"] == text[r["start_pos"] : r["end_pos"]] for r in got)


def test_fixed_chunks_cover(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id long, text string")
    got = [(r["start_pos"], r["content"]) for r in chunking.fixed(df, "id", "text", 4, 2).orderBy("index").collect()]
    assert got == [(0, "abcd"), (2, "cdefgh"), (6, "ghij")]


# Search


def test_jaro():
    assert text_search.jaro("hello", "hallo") > 0.8 and text_search.jaro("hello", "world") < 0.5
    assert abs(text_search.jaro("martha", "marhta") - 0.944444) < 1e-5 and text_search.jaro("", "a") == 0 and text_search.jaro("ab", "ab") == 1
    assert text_search.query_terms("Hello, World! a é") == ["hello", "world", "é"]


def plain_jaro(a, b):
    reach, used, ours = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == c and not used[j]:
                used[j] = True
                ours.append(c)
                break
    if not ours:
        return 0.0
    m, theirs = len(ours), [c for c, u in zip(b, used) if u]
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(ours, theirs)) / 2) / m) / 3


def test_registered_fuzzy_queries_take_all_near_terms(spark, tmp_path):
    docs = ["recovered partitions", "partition record", "parties manifest", "portion cover mandate", "station manifold", "particle recover zebra", "unrelated words", "partition partition manifests"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    terms = [w for d in docs for w in d.split()]
    near = {(w, t): plain_jaro(w, t) for w in ("partition", "manifest") for t in set(terms)}
    near = {k: s for k, s in near.items() if 0.7 <= s < 1}
    got = {(r["word"], r["term"]): r["similarity"] for r in text_queries.jaro_vocabulary(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(near) and any(s < 0.8 for s in near.values())
    raw = {}
    for i, d in enumerate(docs):
        for t in d.split():
            for w in ("recovred", "partiton"):
                if (s := plain_jaro(w, t)) >= 0.7:
                    raw[i] = raw.get(i, 0) + (1 if w == t else s / 2) * (math.log(len(docs) / terms.count(t)) + 1)
    scores = {r["doc_id"]: r["keyword_score"] for r in text_queries.keyword_scores_fuzzy(spark, str(tmp_path)).collect()}
    assert scores == pytest.approx({i: r / max(raw.values()) for i, r in raw.items()})
    only = [i for i, d in enumerate(docs) if i in raw and all(plain_jaro(w, t) < 0.9 for w in ("recovred", "partiton") for t in d.split())]
    assert only


def test_hybrid_search_ranks_the_right_document(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "a slow green turtle walks"), (3, None)], "id long, text string")
    vec, q = vectors.hash_embedding(F.col("text"), 16), vectors.hash_embedding(F.lit("quick fox"), 16)
    got = text_search.hybrid(docs, "id", "text", "quick fox", vec, q, 1.0, 0.0).collect()
    assert [r["id"] for r in got] == [1] and got[0]["matched_terms"] == "quick,fox" and abs(got[0]["keyword_score"] - 1) < 1e-9
    fuzzy = text_search.keyword_scores(docs, "id", "text", "quik turtel", fuzzy=True).collect()
    assert {r["id"] for r in fuzzy} == {1, 2}


def test_keyword_scores_by_hand(spark):
    docs = [(1, "aa bb aa"), (2, "bb cc"), (3, "dd")]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {r["id"]: r["keyword_score"] for r in text_search.keyword_scores(df, "id", "text", "aa aa bb").collect()}
    w = lambda cf: math.log(3 / cf) + 1
    raw = {1: 2 * 2 * w(2) + w(2), 2: w(2)}
    assert got == pytest.approx({k: v / raw[1] for k, v in raw.items()})
    # Words more frequent than e times the documents weigh below zero; then scores aren't scaled.
    many = spark.createDataFrame([(1, "aa " * 20), (2, "aa")], "id long, text string")
    assert all(r["keyword_score"] < 0 for r in text_search.keyword_scores(many, "id", "text", "aa").collect())


def test_vectors_and_neighbours(spark):
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(40)] + [(100, [0.0, 0.0]), (101, [1.0]), (102, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r) for r in nearest.nearest(df, df.where("id in (5, 30)"), "id", "v", 3).select("query", "rank", "key").collect())
    assert got == [(5, 1, 4), (5, 2, 6), (5, 3, 3), (30, 1, 29), (30, 2, 31), (30, 3, 28)]
    one = df.where("id = 0").select(vectors.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(1.0))), vectors.norm(vectors.unit(F.col("v"))), vectors.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))), vectors.cosine(F.col("v"), F.array(F.lit(1.0)))).first()
    assert list(one) == pytest.approx([math.sqrt(0.5), 1.0, 0.0, 0.0])
    made = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string")
    assert [len(r["vector"]) for r in text_search.embedded(made, "id", "t", 40).collect()] == [40] * 3
    assert text_search.cache_statistics(made, "t").first().asDict() == {"requests": 3, "misses": 2, "hits": 1}


def test_neighbours_of_vectors_of_mixed_sizes(spark):
    rows = [(0, []), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.9, 0.1]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    got = {r["query"]: (r["key"], round(r["similarity"], 3)) for r in nearest.nearest(df, df.where("id in (0, 1, 3)").orderBy("id"), "id", "v", 1).collect()}
    assert got == {0: (1, 0.0), 1: (2, 0.994), 3: (4, 0.994)}


def test_regex_search(spark):
    df = spark.createDataFrame([(1, "Error: at line 42"), (2, "none"), (3, None)], "id long, t string")
    assert [(r["id"], r["score"]) for r in text_search.regex_search(df, "id", "t", r"line \d+").collect()] == [(1, 0.5)]


# Logs and streams


def test_logs(spark):
    e = [("s", T + dt.timedelta(seconds=i), k) for i, k in enumerate(["FileCompleted", "FileFailed", "FileCompleted", "Completed"])] + [("r", T, "FileFailed")]
    df = spark.createDataFrame(e, "session string, at timestamp, kind string")
    got = {r["session"]: (r["files_done"], r["files_failed"], r["status"]) for r in state.session_states(df, "session", "at", "kind").collect()}
    assert got == {"s": (2, 1, "Completed"), "r": (0, 1, "Running")}
    fails = spark.createDataFrame([(1, "timeout"), (2, "no such file")], "id long, error string")
    assert sorted((r["id"], r["attempt"], r["delay_ms"]) for r in state.retry_schedule(fails, "id", "error").collect()) == [(1, 0, 100), (1, 1, 200), (1, 2, 400)]
    runs = spark.createDataFrame([("a", 1, T, "failed"), ("a", 2, T, None), ("a", 3, T, "completed"), ("b", 4, T, "completed")], "src string, run long, at timestamp, status string")
    assert [tuple(r) for r in state.resumable(runs, "src", "run", "at", "status").collect()] == [("a", 2)]
    assert [r["run"] for r in state.beyond_newest(runs, "src", "run", "at", 1).orderBy("run").collect()] == [1, 2]


def test_carved_entries_retries_and_index_statistics(spark):
    carved = spark.createDataFrame([(512, 100, "jpg", "Image")], "offset long, size long, extension string, file_type string")
    named = carved.withColumn("name", carve.carved_name(F.lit(0), F.col("offset"), F.col("extension")))
    r = carve.file_entries(named, "/out/").first()
    assert (r["path"], r["size"], r["kind"], r["ext"], r["modified"], r["hash"], r["has_bad_sectors"]) == ("/out/00000000_000000000200.jpg", 100, "Image", "jpg", None, None, False) and r["created"]
    log = spark.createDataFrame([("a", "Retrying", 2), ("b", "Retrying", 0), ("c", "Failed", 1), ("d", "Success", 1), ("e", None, None)], "source string, result string, retries_left int")
    assert [x["source"] for x in state.pending_retries(log).collect()] == ["a"] and [x["source"] for x in state.failed_entries(log).collect()] == ["c"]
    docs = spark.createDataFrame([(1, "aa bb aa", [1.0]), (2, "bb cc", []), (3, None, None)], "id long, text string, v array<double>")
    assert text_search.index_statistics(docs, "id", "text", F.col("v")).first().asDict() == {"documents": 3, "terms": 3, "embeddings": 1}


def test_incremental_stream_equals_batch_and_survives_restart(spark, tmp_path):
    schema = "path string, size long, modified timestamp"
    src, at = str(tmp_path / "in"), lambda n: str(tmp_path / n)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        incremental.incremental_index(incremental.arriving(spark, src, schema, 1), at("out"), at("state"), at("ck")).awaitTermination()
        return sorted((r["path"], r["size"]) for r in spark.read.parquet(at("out")).collect())

    arrive([("/a", 1, T), ("/b", 1, T)])
    assert run() == [("/a", 1), ("/b", 1)]
    arrive([("/a", 1, T), ("/b", 2, T), ("/c", None, None)])
    assert sorted(run(), key=repr) == sorted([("/a", 1), ("/b", 1), ("/b", 2), ("/c", None)], key=repr)
    assert len(run()) == 4
    q = incremental.live_counts(incremental.arriving(spark, src, schema), "counted")
    q.awaitTermination()
    assert spark.table("counted").first()["files"] == 5


def test_session_stream(spark, tmp_path):
    schema = "session string, at timestamp, kind string"
    spark.createDataFrame([("s", T, "FileCompleted"), ("s", T + dt.timedelta(seconds=1), "Completed"), ("r", T, "FileFailed")], schema).write.parquet(str(tmp_path / "e"))
    q = incremental.session_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("update").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("sessions").collect()) == [("r", 0, 1, False), ("s", 1, 0, True)]


def test_spans_read_like_bytes():
    data = b"0123456789abcabc"
    s = carve.Span(data, 4, 9)
    assert len(s) == 9 and s[:] == data[4:13] and s[2:4] == b"67" and s[5:2] == b"" and s.find(b"abc") == 6 and s.find(b"abc", 7) == -1
    assert s.rfind(b"4") == 0 and s.rfind(b"abc", 0, 8) == -1 and struct.unpack_from("B", s, 1)[0] == ord("5") and len(carve.Span(data, 14, 100)) == 2
