"""Scans, sinks and streams on files made here."""

from __future__ import annotations

import json
import struct
import zipfile
import zlib

import duckdb
import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillsift import schemas
from quillsift.sources import scans, sinks
from quillsift.streaming import visits

SF = "/root/testdata/sf0.001"


def test_image_scan_and_labels(spark, tmp_path):
    for name in ("healthy/a.JPG", "healthy/b.txt", "ill/c.jfif", "ill/deep/d.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))
    d = scans.labelled_by_folder(scans.images(spark, str(tmp_path)), str(tmp_path))
    assert sorted((r.label, r.suffix) for r in d.collect()) == [("healthy", ".jpg"), ("ill", ".jfif"), ("ill", ".png")]
    assert "content" not in d.columns
    both = scans.classified_images(spark, {"x": [f"{tmp_path}/healthy", f"{tmp_path}/ill"], "y": [f"{tmp_path}/ill"]})
    assert {(r.label, r.class_ord, r.dir_ord) for r in both.collect()} == {("x", 0, 0), ("x", 0, 1), ("y", 1, 0)}
    assert scans.biggest(scans.files(spark, str(tmp_path))).first().path.endswith("ill/deep/d.png")


def test_csv_with_mark_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿path,category,subject_id,lesion_present,excluded_from_metrics,exclusion_reason\na.png,"says ""hi""",,1,true,\n', encoding="utf-8")
    r = scans.read_csv(spark, str(tmp_path / "m.csv"), schemas.EXTERNAL_MANIFEST).first()
    assert (r.path, r.category, r.subject_id, r.lesion_present, r.excluded_from_metrics, r.exclusion_reason) == ("a.png", 'says "hi"', None, 1, True, None)
    (tmp_path / "bad.csv").write_text("a,b\n1,x\noops,y\n")
    assert tuple(scans.parse_check(spark, str(tmp_path / "bad.csv"), "a int, b string").first()) == (2, 1)


def test_hash_cache_and_annotations(spark, tmp_path):
    cache = {"one": {"root": "r", "n_images": 2, "n_failed": 0, "entries": [{"path": "a", "md5": "m", "phash": "9223372036854775807"}, {"path": "b", "md5": "n", "phash": ""}]}}
    (tmp_path / "c.json").write_text(json.dumps(cache))
    assert rows(scans.read_hash_cache(spark, str(tmp_path / "c.json"))) == [("one", "r", "a", "m", 2**63 - 1), ("one", "r", "b", "n", None)]
    notes = {
        "images": [{"id": 1, "file_name": "x.png"}],
        "categories": [{"id": 5, "name": "lesion"}],
        "annotations": [
            {"image_id": 1, "category_id": 5, "segmentation": [0, 0, 4, 0, 4, 3, 0, 3]},
            {"image_id": 1, "category_id": 5, "segmentation": [[0, 0, 2, 0, 2, 2], [0, 0, 1, 1]]},
        ],
    }
    (tmp_path / "n.json").write_text(json.dumps(notes))
    rings = scans.annotation_rings(spark, str(tmp_path / "n.json"))
    assert sorted(r.area for r in rings.collect()) == [2.0, 12.0]
    assert rows(scans.max_area_per_image(rings)) == [("x", "lesion", 2, 14.0)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "train", "a"), (2, "val", "b"), (3, "train", "b")], "id int, split string, label string")
    sinks.write_manifest(d, str(tmp_path / "m"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "m")).where("split = 'train'").count() == 2
    names = {r.id: r.export_name for r in sinks.export_names(d, "split", "label", "id").collect()}
    assert names == {1: "a_00000", 2: "b_00000", 3: "b_00000"}
    assert rows(sinks.missing_only(d, d.where("id = 1"), ["id"]).select("id")) == [(2,), (3,)]
    d.limit(0).write.parquet(str(tmp_path / "p"))
    assert sinks.upsert_and_check(spark, d.unionByName(d), str(tmp_path / "p"), ["id"]).count() == 0
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    f = spark.createDataFrame([(0.59996, 0.1), (0.59994, 0.69996)], "clip_frac double, score double")
    assert [r.proposed_label for r in sinks.rounded_features(f).collect()] == ["clipped", "synthetic"]
    sinks.write_report(d, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    schema = events.schema
    s = visits.events_stream(spark, str(tmp_path / "in"), schema)
    q = visits.visit_changes(s).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    from quillsift.operators.joins import ordered_pairs

    want = ordered_pairs(events, ["user_id", "event_type"], "ts", "event_id", ["value"]).select("older_event_id", "newer_event_id")
    assert rows(spark.sql("SELECT older_event_id, newer_event_id FROM changes")) == rows(want)
    q = visits.windowed_counts(s).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == events.count()


def test_rate_limit_drops_and_never_queues(spark, tmp_path):
    frames = spark.createDataFrame([("c", t, 100) for t in (0, 50, 599, 600, 700, 1300)], "camera string, at_ms long, took_ms long")
    frames.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    q = visits.rate_limited(s).writeStream.format("memory").queryName("taken").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.sql("SELECT at_ms, n_taken, n_dropped FROM taken ORDER BY at_ms").collect()]
    assert got == [(0, 1, 0), (600, 2, 2), (1300, 3, 3)]


def test_register_of_markdown(spark):
    lines = ["| key | value | state | note |", "|---|---|---|---|", "| `a.b` | 1 | Calibrated | x |", "text", "| `a.b` | 2 | provisional | y |", "| two | cells |"]
    d = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    assert [(r.key, r.state) for r in scans.markdown_register(d, ["calibrated", "provisional"]).collect()] == [("a.b", "provisional")]
    assert rows(scans.quoted_terms(spark.createDataFrame([('X = ["one", "two", "one"]',)], "t string"), "t")) == [("one",), ("two",)]


def test_image_sizes_by_header(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b""))
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 6) + b"Exif" + b"\xff\xff\xc2" + struct.pack(">HBHHB", 8, 8, 33, 44, 0)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<IB3x", 10, 0) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    files = {"a.png": png, "b.jpg": jpeg, "c.webp": webp, "d.bmp": b"BM" + bytes(16) + struct.pack("<ii", 7, -9), "e.jpg": b"\xff\xd8\xff", "f.png": b"?"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.error is None) for r in scans.image_sizes(scans.images(spark, str(tmp_path), content=True)).collect()}
    assert got == {"a.png": (640, 480, True), "b.jpg": (44, 33, True), "c.webp": (100, 50, True), "d.bmp": (7, 9, True), "e.jpg": (None, None, False), "f.png": (None, None, False)}
    # by opening the files: a long comment before the frame takes more than the first bytes
    comment = b"\xff\xfe" + struct.pack(">H", 40_002) + bytes(40_000)
    (tmp_path / "g.jpg").write_bytes(b"\xff\xd8" + comment * 2 + jpeg[10:])
    opened = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.error is None) for r in scans.image_sizes(scans.images(spark, str(tmp_path))).collect()}
    assert opened == got | {"g.jpg": (44, 33, True)}


def test_workbook_and_descriptors(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="x1"/><sheet name="Two" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="y"><Relationship Id="x1" Target="worksheets/s1.xml"/><Relationship Id="x2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t> IMG1 </t></si><si><r><t>sore</t></r><r><t> spot</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f"""<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>head</t></is></c><c r="B1"><v>9</v></c></row>
            <row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="E2"><v>3</v></c></row><row r="3"><c r="A3"><v>1</v></c></row></sheetData></worksheet>""")
        z.writestr("xl/worksheets/s2.xml", f"""<worksheet xmlns="{main}"><sheetData><row r="4"><c r="B4" t="inlineStr"><is><t>img1</t></is></c><c r="C4" t="b"><v>1</v></c></row>
            <row r="5"><c r="B5" t="inlineStr"><is><t>img2</t></is></c><c r="D5" t="inlineStr"><is><t>  </t></is></c></row></sheetData></worksheet>""")
    d = scans.workbook_rows(spark, str(tmp_path))
    assert [(r.sheet, r.row, r.cells) for r in d.orderBy("sheet_no", "row").collect()][1] == ("One", 2, [None, " IMG1 ", "sore spot", None, "3"])
    assert rows(scans.descriptors(d.where("sheet_no = 0")).select("key", "labels")) == [("img1", ["sore spot", "3"])]
    assert rows(scans.descriptors(d).select("key", "labels")) == [("img1", ["True"]), ("img2", [])]


def test_json_and_guarded_scans(spark, tmp_path):
    (tmp_path / "assets.json").write_text('[{"name": "a", "bytes": 3}, {"name": "b"}]')
    assert rows(scans.read_json(spark, str(tmp_path / "assets.json"), "name string, bytes long")) == [("a", 3), ("b", None)]
    d = spark.createDataFrame([("x/unannotated/a.png",), ("x/annotated/b.png",), ("x/c.json",), ("x/c.png",)], "path string")
    assert rows(scans.guarded_images(d)) == [("x/c.png",), ("x/unannotated/a.png",)]


def test_lines_refused_bundles_and_deletion(spark, tmp_path):
    d = spark.createDataFrame([(1, "train", 0.5), (2, "val", 1.0)], "id int, split string, share double")
    assert rows(sinks.report_lines(d, "%d %s %.2f", ["id", "split", "share"])) == [("1 train 0.50",), ("2 val 1.00",)]
    assert sinks.publishable(d, F.col("split") == "test").count() == 2
    with pytest.raises(Exception, match="restricted source"):
        sinks.publishable(d, F.col("split") == "val").collect()
    d.write.parquet(str(tmp_path / "t"))
    assert sinks.delete_and_check(spark, d.where("id = 1"), str(tmp_path / "t"), str(tmp_path / "t2"), ["id"]).count() == 0
    assert rows(spark.read.parquet(str(tmp_path / "t2"))) == [(2, "val", 1.0)]
    photos = tmp_path / "photos"
    photos.mkdir()
    for name in ("a.jpg", "b.jpg"):
        (photos / name).write_bytes(b"x")
    found = scans.images(spark, str(photos)).select("path")
    orphans = sinks.orphan_files(found, found.where(F.col("path").endswith("a.jpg")))
    assert [r.gone for r in sinks.delete_files(orphans).collect()] == [True]
    assert [p.name for p in photos.iterdir()] == ["a.jpg"]
    assert rows(sinks.delete_files(spark.createDataFrame([(f"file:{photos}/none.jpg",)], "path string")).select("gone")) == [(True,)]


def test_live_query(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "id int").write.parquet(str(tmp_path / "in"))
    seen = []
    q = visits.on_change(spark.readStream.schema("id int").parquet(str(tmp_path / "in")), lambda d, n: seen.append((n, d.count())), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 5)]


def test_export_names_number_every_row(spark):
    table = [("train", "a", k) for k in (5, 3, None, 3, 9)] + [("val", "a", 1), ("train", None, 2), (None, "b", 2)]
    df = spark.createDataFrame(table, "split string, label string, key int")
    got = sorted(((r.split, r.label, r.key, r.export_name) for r in sinks.export_names(df, "split", "label", "key").collect()), key=repr)
    assert [x for x in got if x[:2] == ("train", "a")] == sorted([("train", "a", None, "a_00000"), ("train", "a", 3, "a_00001"), ("train", "a", 3, "a_00002"), ("train", "a", 5, "a_00003"), ("train", "a", 9, "a_00004")], key=repr)
    assert len(got) == len(table) and ("val", "a", 1, "a_00000") in got and (None, "b", 2, "b_00000") in got


def test_export_names_beyond_five_digits(spark, tmp_path):
    from quillsift.plans import catalog

    d = spark.range(130_000).select(F.col("id").alias("c_custkey"), F.when(F.col("id") != 7, "BUILDING").alias("c_mktsegment"))
    d.write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted((r.c_custkey, r.split, r.export_name or "") for r in catalog.queries()["export_names"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted((k, split, name or "") for split, name, k in c.sql(catalog.oracle_sql()["export_names"]).fetchall())
    whole = sinks.export_names(d.withColumn("split", F.lit("all")), "split", "c_mktsegment", "c_custkey")
    assert whole.agg(F.count_distinct("export_name")).first()[0] == 129_999 and whole.agg(F.max("export_name")).first()[0] == "BUILDING_99999"
    assert whole.where("c_custkey = 129999").first().export_name == "BUILDING_129998"
