"""Sources, searches, duplicates and sinks on small trees of real files."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tephra.functions import digests, names, texts
from tephra.operators import dedup, proof, search, sectors
from tephra.plans import index_queries
from tephra.sources import directory, sinks, stores

T = dt.datetime(2031, 1, 1)


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column).first()[0]


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "photos/vacation.jpg": "j",
        "photos/family.png": "pp",
        "documents/report.pdf": "report",
        "documents/notes.txt": "notes",
        "code/main.rs": "fn main() {}",
        ".hidden/secret.txt": "s",
        "code/.profile": "x",
        "empty.log": "",
    }.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(tmp_path / "src")


def scanned(spark, tree, **options):
    found = directory.scan(spark, tree, **options)
    return {r["path"][len(tree) + 1 :]: r for r in found.collect()}


def test_scan_keeps_empty_and_skips_hidden(spark, tree):
    got = scanned(spark, tree)
    assert set(got) == {"photos/vacation.jpg", "photos/family.png", "documents/report.pdf", "documents/notes.txt", "code/main.rs", "empty.log"}
    assert got["empty.log"]["size"] == 0 and got["documents/notes.txt"]["size"] == 5 and got["code/main.rs"]["read_error"] is None
    assert len(scanned(spark, tree, hidden=True)) == 8
    assert set(scanned(spark, tree, extensions=".JPG,rs")) == {"photos/vacation.jpg", "code/main.rs"}
    assert set(scanned(spark, tree, max_depth=1)) == {"empty.log"}


def test_searches(spark, tree):
    files = search.entries(directory.scan(spark, tree))
    n = lambda df: df.count()
    assert n(search.by_type(files, "photos")) == 2 and n(search.by_type(files, "code")) == 1 and n(search.by_type(files, "nosuchtype")) == 0
    assert n(search.glob(files, "*.jpg")) == 1 and n(search.glob(files, "*.{jpg,png}")) == 2 and n(search.glob(files, "[!f]*.p?[fg]")) == 1
    assert n(search.regex(files, r"\.(jpg|png)$")) == 2
    assert n(search.exact(files, "NOTES")) == 1
    assert n(search.subsequence(files, "vctn")) == 1
    assert n(search.search(files, "*", "glob", min_size=2, max_size=6)) == 3
    stats = {r["kind"]: r["files"] for r in search.statistics(files.withColumn("has_bad_sectors", F.lit(False))).collect()}
    assert stats["ALL"] == 6 and stats["Image"] == 2 and stats["Document"] == 2


def test_scenarios(spark):
    files = search.entries(spark.createDataFrame([("/r/a.jpg",), ("/r/.b/c.jpg",), ("/r/d.txt",), ("/r/" + "x/" * 12 + "e.txt",)], "path string"))
    kept = {n: search.scenario(files, F.lit("/r"), n).count() for n in search.SCENARIOS}
    assert kept == {"deleted_files": 4, "corrupted_drive": 4, "lost_photos": 1, "backup_drive": 2, "scan_everything": 4}


def test_date_filters_pass_unknown_times(spark):
    rows = [("/a.txt", 5, T), ("/b.txt", 5, None), ("/c.txt", 5, dt.datetime(2030, 1, 1))]
    files = search.entries(spark.createDataFrame(rows, "path string, size long, modified timestamp"))
    got = [r["path"] for r in search.search(files, "", "exact", after="2030-12-31", before="2031-01-01").collect()]
    assert got == ["/a.txt", "/b.txt"]


@pytest.mark.parametrize("path,ext", [("/a/b.TXT", "txt"), ("/a/.bashrc", ""), ("/a.b/c", ""), ("x.tar.gz", "gz"), ("C:\\d\\e.Rs", "rs"), ("..a", "a"), ("end.", "")])
def test_extension(spark, path, ext):
    assert one(spark, names.extension(F.col("p")), p=path) == ext


@pytest.mark.parametrize("path,norm", [("/x/report_copy.txt", "report.txt"), ("/x/report (1).txt", "report.txt"), ("/x/Doc_v2_final.PDF", "doc.pdf"), ("/x/photo_20240115_143022.jpg", "photo.jpg"), ("/x/_copy.txt", "_copy.txt"), ("/x/cafe\u0301.md", "caf\u00e9.md"), ("/x/a - 2.md", "a.md")])
def test_normalised_name(spark, path, norm):
    assert one(spark, names.normalised_name(F.col("p")), p=path) == norm


def test_temp_names(spark):
    temp = ["a~", "a.bak", "a.TMP", "a.swp", "a.orig", "a_old.txt", "a (1).txt", "~$doc.docx", "x - Copy.txt"]
    for name in temp:
        assert one(spark, names.is_temp_name(F.col("p")), p="/d/" + name), name
    assert not one(spark, names.is_temp_name(F.col("p")), p="/d_old/report.pdf")


def test_texts(spark):
    assert [one(spark, texts.duration_text(F.col("s")), s=s) for s in (0.25, 30.0, 90.0, 3700.0)] == ["250ms", "30.0s", "1m 30s", "1h 1m 40s"]
    assert [one(spark, texts.parsed_size(F.col("s")), s=s) for s in ("10", "2 KB", "3mb", "1GB", "1.5MB", "x")] == [10, 2048, 3 << 20, 1 << 30, None, None]
    assert [one(spark, texts.age_text(F.col("s")), s=s) for s in (5, 130, 7300, 200000)] == ["just now", "2 min ago", "2 hours ago", "2 days ago"]
    assert one(spark, texts.size_text(F.col("s")), s=1536) == "1.50 KiB"
    assert one(spark, texts.tokens(F.col("s")), s="Hello, World! This is a test. é") == ["hello", "world", "this", "is", "test", "é"]
    assert [one(spark, texts.heading_level(F.col("s")), s=s) for s in ("# a", "  ### b", "#c", "####### d")] == [1, 3, None, None]
    assert one(spark, texts.html_escaped(F.col("s")), s="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert not one(spark, texts.is_recoverable(F.col("s")), s="Permission denied (13)") and one(spark, texts.is_recoverable(F.col("s")), s="timeout")
    assert one(spark, texts.repair_for(F.col("s")), s="CUDA out of memory") == "gpu"
    assert [one(spark, texts.retry_delay_ms(F.col("n")), n=n) for n in (0, 1, 10)] == [100, 200, 5000]
    assert one(spark, texts.percent(F.col("a"), F.col("b")), a=0, b=0) == 100.0
    text = "x" * 200 + " fox " + "y" * 200
    assert one(spark, texts.snippet(F.col("s"), ["FOX"]), s=text) == "..." + text[126:276] + "..."
    meta = one(spark, texts.content_with_prefix(F.lit("a.md"), F.lit("markdown"), F.lit(0), F.lit(2), F.lit(0), F.lit(9), F.create_map(F.lit("h"), F.lit("# A")), F.lit("body")))
    assert meta == "File: a.md | Type: markdown | Chunk: 1/2 | Bytes: 0-9 | h: # A\n---\nbody"


def test_digests(spark):
    assert digests.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    body = bytes(range(256)) * 40
    whole = spark.createDataFrame([(bytearray(body),), (bytearray(b"ab"),)], "c binary")
    got = [tuple(r) for r in whole.select(digests.partial_hash(F.col("c"), 1000), digests.content_hash(F.col("c"), "blake3")).collect()]
    assert got[0][0] == hashlib.sha256(len(body).to_bytes(8, "little") + body[:1000] + body[-1000:]).hexdigest()
    assert got[1][0] == hashlib.sha256(b"ab").hexdigest() and got[0][1] == digests.blake3(body)


FILES = "path string, size long, hash string, modified timestamp"


def test_exact_duplicates_and_what_is_kept(spark):
    h = dt.timedelta(hours=5)
    rows = [("/d/report.pdf", 14, "A", T - h), ("/d/report_backup.pdf", 14, " a", T), ("/u.txt", 4, "b", T), ("/z0", 0, "c", T), ("/z1", 0, "c", T), ("/n0", 9, None, None), ("/n1", 9, None, None)]
    files = spark.createDataFrame(rows, FILES)
    kept = {k: [r["master"] for r in dedup.exact_groups(files, k).collect()] for k in dedup.KEEP}
    assert kept == {"newest": ["/d/report_backup.pdf"], "largest": ["/d/report.pdf"], "oldest": ["/d/report.pdf"], "cleanest": ["/d/report.pdf"]}
    groups = dedup.exact_groups(files)
    assert dedup.report(files, groups).first().asDict() == {"scanned_files": 7, "duplicate_groups": 1, "total_duplicates": 1, "wasted_bytes": 14, "unique_files": 6}
    assert [r["path"] for r in dedup.purge_plan(files, groups).collect()] == ["/d/report.pdf"]
    assert dedup.exact_groups(files.limit(0)).count() == 0


def test_fuzzy_duplicates(spark):
    rows = [("/report.txt", 1000), ("/report_copy.txt", 1000), ("/report (1).txt", 1020), ("/report_v3.txt", 5000), ("/other.txt", 1000), ("/big_old.txt", 900), ("/big.txt", 300)]
    files = spark.createDataFrame([(*r, None, None) for r in rows], FILES)
    got = dedup.fuzzy_groups(files).collect()
    assert [(r["norm"], r["files"], r["similarity"], r["wasted_bytes"]) for r in got] == [("report.txt", 3, 98, 2020)]
    exclude = files.where("path = '/report.txt'")
    assert dedup.fuzzy_groups(files, exclude=exclude).first()["files"] == 2
    assert dedup.fuzzy_groups(files.limit(0)).count() == 0


def test_export_verify_and_tampering(spark, tree, tmp_path):
    dest = str(tmp_path / "dest")
    with pytest.raises(ValueError):
        sinks.export(directory.scan(spark, tree), tree + "/in", [tree])
    dry = sinks.export(directory.scan(spark, tree), dest, [tree], dry_run=True).collect()
    assert len(dry) == 6 and not os.path.exists(dest)
    done = sinks.export(directory.scan(spark, tree), dest, [tree]).withColumn("exported_at", F.current_timestamp()).withColumn("bad_sector_notes", F.lit(None).cast("string"))
    stores.save_manifest(done, str(tmp_path / "m"), tree, dest)
    assert stores.root_hash_valid(spark, str(tmp_path / "m"))
    entries = stores.load_manifest(spark, str(tmp_path / "m"))

    def states():
        got = proof.verified(entries, sinks.file_states(entries, "dest_path"), ["dest_path"], "size", "hash").collect()
        return sorted(r["status"] for r in got)

    assert states() == ["Ok"] * 6
    paths = [r["dest_path"] for r in entries.orderBy("dest_path").collect()]
    os.remove(paths[0])
    open(paths[1], "a").write("longer")
    with open(paths[2], "r+b") as f:
        f.write(bytes([f.read(1)[0] ^ 1]) if not f.seek(0) else b"")
    assert {"Missing", "SizeChanged"} <= set(states())
    counts = proof.verify_counts(proof.verified(entries, sinks.file_states(entries, "dest_path"), ["dest_path"], "size", "hash").withColumn("m", F.lit(1)), "m").first()
    assert counts["missing"] == 1 and not counts["clean"] and counts["total"] == 6


def test_root_hash_is_independent_of_order(spark):
    rows = [(1, f"/p{i}", f"h{i}") for i in range(30)] + [(2, "/a", None)]
    a = spark.createDataFrame(rows, "m int, p string, h string")
    b = spark.createDataFrame(rows[::-1], "m int, p string, h string").repartition(3)
    want = {1: hashlib.sha256("".join(r[2] for r in sorted(rows[:30], key=lambda r: r[1])).encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    for df in (a, b):
        assert {r[0]: r[1] for r in proof.root_hashes(df, "m", "p", "h").collect()} == want
    assert proof.root_hashes(a.limit(0), "m", "p", "h").count() == 0


def test_purge_needs_to_be_told(spark, tree):
    plan = directory.scan(spark, tree).where(F.col("path").endswith(".txt"))
    assert [r["deleted"] for r in sinks.purge(plan).collect()] == [False] and os.path.exists(tree + "/documents/notes.txt")
    assert [r["deleted"] for r in sinks.purge(plan, delete=True).collect()] == [True] and not os.path.exists(tree + "/documents/notes.txt")


def test_sectors(spark, tmp_path):
    blocks = spark.createDataFrame([("f", i, 4096, i in (2, 7)) for i in range(10)] + [("g", 0, 10, None)], "file string, block int, bytes int, bad boolean")
    maps = {r["file"]: r for r in sectors.sector_maps(blocks, "file", "block", "bytes", "bad").collect()}
    assert maps["f"]["bad_blocks"] == 2 and maps["f"]["readable"] == 80.0 and maps["g"]["readable"] == 100.0
    cells = {(r["file"], r["cell"]): r["bad"] for r in sectors.heatmap(blocks, "file", "block", "bad", 5).collect()}
    assert cells == {("f", 0): False, ("f", 1): True, ("f", 2): False, ("f", 3): True, ("f", 4): False, ("g", 0): False}
    assert sectors.bad_report(sectors.sector_maps(blocks, "file", "block", "bytes", "bad")).first().asDict() == {"files_scanned": 2, "files_with_bad_sectors": 1, "total_bad_blocks": 2, "total_bad_bytes": 8192}
    content = spark.createDataFrame([("f", 0, bytearray(b"\xaa" * 4)), ("f", 1, bytearray(b"\xaa" * 4))], "file string, block int, c binary")
    got = {r["block"]: bytes(r["c"]) for r in sectors.zero_filled(content, blocks.where("block = 1"), "file", "block", "c").collect()}
    assert got == {0: b"\xaa" * 4, 1: b"\0" * 4}
    p = tmp_path / "a"
    p.write_bytes(b"\xaa" * 8192)
    assert sinks.export_zero_filled(str(p), str(tmp_path / "b"), {1}) == (4096, 4096)
    assert (tmp_path / "b").read_bytes() == b"\xaa" * 4096 + bytes(4096)


def test_stores(spark, tmp_path):
    at = str(tmp_path / "c")
    assert stores.load_checkpoint(spark, at, "index").count() == 0
    stores.mark_processed(spark.createDataFrame([("/a", "h")], "path string, hash string"), at, "index")
    stores.mark_processed(spark.createDataFrame([("/a", "h"), ("/b", "h")], "path string, hash string"), at, "export")
    assert stores.load_checkpoint(spark, at, "index").count() == 1 and stores.load_checkpoint(spark, at, "export").count() == 2
    stores.save_settings({"scan": {"hidden": True, "name": 'q"\\x'}}, str(tmp_path / "s.toml"))
    assert stores.load_settings(str(tmp_path / "s.toml"))["scan"] == {"hidden": True, "workers": 8, "name": 'q"\\x'}
    (tmp_path / "d.IMG").write_bytes(b"x" * 5000)
    (tmp_path / "e.img").write_bytes(b"x")
    assert [os.path.basename(p) for p in stores.disk_images(str(tmp_path), 100)] == ["d.IMG"]


def test_report(spark, tree):
    files = search.entries(directory.scan(spark, tree))
    errors = spark.createDataFrame([("<bad>",)], "error string")
    page = sinks.html_report("Case & 1", search.summary(files), errors, {"by": "A"})
    assert "Case &amp; 1" in page and "<td>Image</td><td>2</td>" in page and "&lt;bad&gt;" in page


def test_report_lists_all_errors(spark, tree):
    errors = spark.range(450).select(F.format_string("unreadable %04d", "id").alias("error"))
    page = sinks.html_report("Case", search.summary(search.entries(directory.scan(spark, tree))), errors, {})
    at = [page.find(f"<li>unreadable {i:04d}</li>") for i in range(450)]
    assert at[0] > 0 and at == sorted(at) and "Errors (450)" in page


def test_command_line(spark, tree, tmp_path, capfd):
    from tephra.__main__ import main

    at = lambda n: str(tmp_path / n)
    assert main(["index", tree, at("index")]) == 0
    assert main(["search", at("index"), "*.jpg", "--how", "glob"]) == 0 and "vacation.jpg" in capfd.readouterr().out
    with open(tree + "/copy.txt", "w") as f:
        f.write("notes")
    main(["index", tree, at("index")])
    assert main(["dedup", at("index"), "--keep", "cleanest"]) == 0 and "/copy.txt" in capfd.readouterr().out
    assert main(["export", at("index"), at("out")]) == 0
    assert main(["verify", at("out") + "/manifest"]) == 0
    os.remove(stores.load_manifest(spark, at("out") + "/manifest").first()["dest_path"])
    assert main(["verify", at("out") + "/manifest"]) == 1
    assert main(["report", at("index"), at("report.html")]) == 0 and "<td>Image</td>" in open(at("report.html")).read()
    image = bytearray(8192)
    image[0:4], image[2000:2002] = b"\xff\xd8\xff\xe0", b"\xff\xd9"
    (tmp_path / "a.dd").write_bytes(image)
    assert main(["carve", at("a.dd"), at("carved")]) == 0 and os.listdir(at("carved")) == ["00000000_000000000000.jpg"]


def test_command_line_carves_all_of_many_blocks(spark, tmp_path, monkeypatch, capfd):
    from tephra.__main__ import main
    from tephra.sources import images

    image = bytearray(1 << 20)
    for at in range(0, len(image), 1024):
        image[at : at + 4], image[at + 600 : at + 602] = b"\xff\xd8\xff\xe0", b"\xff\xd9"
    (tmp_path / "a.dd").write_bytes(image)
    blocks = images.image_blocks
    monkeypatch.setattr(images, "image_blocks", lambda s, paths: blocks(s, paths, 1 << 15))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert main(["carve", str(tmp_path / "a.dd"), str(tmp_path / "carved")]) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(os.listdir(tmp_path / "carved")) == [f"00000000_{at:012x}.jpg" for at in range(0, len(image), 1024)]
    assert "only showing top 100 rows" in capfd.readouterr().out


def test_sizes_of_all_files_are_labelled(spark, tmp_path):
    sizes = [None, 0, 1023, 1024, 1536, 3 << 20, 5 << 30, 7 << 40, 9 << 50, 1 << 61]
    spark.createDataFrame([(i, f"/d/{i}.jpg", s) for i, s in enumerate(sizes)], "file_id long, path string, size long").write.parquet(str(tmp_path / "files.parquet"))
    got = {r["label"]: r["files"] for r in index_queries.size_labels_whole(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(["unknown", "0 B", "1023 B", "1.00 KiB", "1.50 KiB", "3.00 MiB", "5.00 GiB", "7.00 TiB", "9.00 PiB", "2048.00 PiB"], 1)
