"""Guarded scans: image folders, manifests, hash caches, annotations, registers.

Every reader takes an explicit schema and leaves the file listing and pruning to
Spark; a folder scan reads no file contents unless they are asked for.
"""

from __future__ import annotations

import io
import struct
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift import schemas
from quillsift.functions.scalars import c, first_segment, name_of, ring_points, segments, shoelace, slashed, stem_of, suffix_of
from quillsift.operators.filters import IMAGE_SUFFIXES, blocked_path, file_kind, guarded


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length, modificationTime, suffix, kind, and content if asked for) of all files below ``root``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    d = d if content else d.drop("content")
    return d.withColumn("suffix", suffix_of("path")).withColumn("kind", file_kind("suffix"))


def images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    return files(spark, root, content).where(F.col("suffix").isin(*IMAGE_SUFFIXES))


def classified_images(spark: SparkSession, sources: dict[str, list[str]], content: bool = False) -> DataFrame:
    """Images of several folders per class, with the ordinals that decide which duplicate stays."""
    out = None
    for i, (label, dirs) in enumerate(sources.items()):
        for j, d in enumerate(dirs):
            part = images(spark, d, content).select("*", F.lit(label).alias("label"), F.lit(i).alias("class_ord"), F.lit(j).alias("dir_ord"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source folders")
    return out


def labelled_by_folder(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The folder below ``root`` is the label."""
    inside = F.substring_index(slashed(path), root.rstrip("/") + "/", -1)
    return df.withColumn("label", first_segment(inside))


def guarded_images(df: DataFrame, path: str = "path", open_level: str = "unannotated") -> DataFrame:
    """Images outside blocked levels; the result is checked again row by row, and fails rather than leak."""
    return guarded(df.where(~blocked_path(path, open_level)), blocked_path(path, open_level), "a blocked path passed the scan")


def biggest(df: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """The largest file; of equal ones the first by path."""
    return df.groupBy().agg(F.min(F.struct((-F.col(size)).alias("_n"), segments(path).alias("_p"), F.col(path).alias("path"), F.col(size).alias("size"))).alias("_m")).select("_m.path", "_m.size").where("path IS NOT NULL")


def read_csv(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark is dropped, doubled quotes are read, blank cells are null."""
    r = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").schema(schema)
    return (r.option("pathGlobFilter", glob).option("recursiveFileLookup", "true") if glob else r).csv(path)


def parse_check(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(n_rows, n_bad) of a CSV: rows that do not fit the schema are counted, not dropped."""
    d = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").csv(path)
    # the reader parses only the columns that are used, so the check uses them all
    used = F.to_json(F.struct(*[x for x in d.columns if x != "_bad"])).isNotNull()
    return d.select(F.col("_bad").isNotNull().alias("bad"), used.alias("used")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("bad") & F.col("used")).alias("n_bad"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def read_hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, root, path, md5, phash) of a hash cache: one document, a key per data set."""
    text = spark.read.option("wholetext", "true").text(path)
    d = text.select(F.explode(F.from_json("value", F.lit(schemas.HASH_CACHE))).alias("dataset", "v"))
    d = d.select("dataset", "v.root", F.explode("v.entries").alias("e"))
    return d.select("dataset", "root", "e.path", "e.md5", F.expr("try_cast(e.phash AS BIGINT)").alias("phash"))


def read_manifest(manifest: DataFrame, mapping: dict[str, str], files: DataFrame | None = None, category: str = "category", path: str = "path") -> DataFrame:
    """Rows whose category is mapped, with their class; with ``files`` only those whose file is there."""
    spark = manifest.sparkSession
    classes = spark.createDataFrame(list(mapping.items()), f"{category} string, class string")
    d = manifest.join(F.broadcast(classes), category)  # the mapping is a setting of a few rows
    return d if files is None else d.join(files.select(path).distinct(), path, "left_semi")


def annotation_rings(spark: SparkSession, path: str) -> DataFrame:
    """(stem, channel, points, area) per ring of polygon annotations, flat or nested; short rings are left out."""
    d = spark.read.option("multiLine", "true").option("primitivesAsString", "false").schema(schemas.ANNOTATIONS).json(path)
    names = d.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), stem_of("i.file_name").alias("stem"))
    kinds = d.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("channel"))
    marks = d.select(F.posexplode("annotations").alias("annotation", "a")).select("annotation", "a.image_id", "a.category_id", rings("a.segmentation").alias("rings"))
    r = marks.select("annotation", "image_id", "category_id", F.explode("rings").alias("flat")).withColumn("points", ring_points("flat")).where("points IS NOT NULL")
    return r.join(names, "image_id").join(kinds, "category_id").select("stem", "channel", "annotation", "points", shoelace("points").alias("area"))


def rings(text) -> Column:
    """Rings of a JSON text that is one flat ring [x, y, ...] or a list of rings."""
    nested = F.from_json(c(text), F.lit("array<array<double>>"))
    flat = F.from_json(c(text), F.lit("array<double>"))
    return F.when(F.ltrim(c(text)).rlike(r"^\[\s*\["), nested).when(F.size(flat) > 0, F.array(flat))


def max_area_per_image(rings_df: DataFrame) -> DataFrame:
    """(stem, channel, n_annotations, area): the largest ring of each annotation, summed per image."""
    each = rings_df.groupBy("stem", "channel", "annotation").agg(F.max("area").alias("area"))
    return each.groupBy("stem", "channel").agg(F.count(F.lit(1)).alias("n_annotations"), F.sum("area").alias("area"))


def markdown_register(lines: DataFrame, states: list[str], line: str = "value", number: str = "n") -> DataFrame:
    """(key, state, cells) of a table in Markdown text lines; of equal keys the last counts.

    Rows with under four cells are not table rows; a state that is not listed fails.
    """
    cells = F.transform(F.filter(F.split(F.trim(line), r"\|"), lambda x: F.lit(True)), lambda x: F.trim(x))
    d = lines.where(F.trim(line).startswith("|")).select(F.col(number).alias("n"), F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0))).alias("cells"))
    d = d.where((F.size("cells") >= 4) & ~F.get("cells", F.lit(0)).rlike(r"^:?-+:?$") & (F.lower(F.get("cells", F.lit(0))) != "key"))
    d = d.select("n", F.translate(F.get("cells", F.lit(0)), "`", "").alias("key"), F.lower(F.get("cells", F.lit(2))).alias("state"), "cells")
    d = guarded(d, ~F.col("state").isin(*states), "a state that is not known")
    return d.groupBy("key").agg(F.max(F.struct("n", "state", "cells")).alias("m")).select("key", "m.state", "m.cells")


def quoted_terms(df: DataFrame, text: str) -> DataFrame:
    """Quoted strings of a source text, each once."""
    return df.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit('"([^"\n]*)"'), 1))).alias("term"))


def _size(b: bytes) -> tuple[int, int]:
    """Width and height by the header of a PNG, BMP, GIF, WebP or JPEG file."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", b[16:24])
    if b[:2] == b"BM":
        width, height = struct.unpack("<ii", b[18:26])
        return width, abs(height)
    if b[:4] == b"GIF8":
        return struct.unpack("<HH", b[6:10])
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        if b[12:16] == b"VP8X":
            return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
        if b[12:16] == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack("<HH", b[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if b[:2] == b"\xff\xd8":
        at = 2
        while at < len(b):
            while b[at + 1] == 0xFF:  # fill bytes
                at += 1
            kind = b[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", b[at + 5 : at + 9])
                return width, height
            at += 2 if 0xD0 <= kind <= 0xD7 or kind == 1 else 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    raise ValueError("no known header")


#: Bytes of a file that are read for its header; a longer header (large metadata before the frame) takes the whole file.
HEADER_BYTES = 1 << 16


def _opened_size(path: str):
    """Width and height of the file at a path or address, by its first bytes."""
    address = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    store, inner = fs.FileSystem.from_uri(address)
    with store.open_input_file(inner) as f:
        try:
            return _size(f.read(HEADER_BYTES))
        except (ValueError, struct.error, IndexError):
            if f.size() <= HEADER_BYTES:
                raise
            f.seek(0)
            return _size(f.read())


def image_sizes(images: DataFrame) -> DataFrame:
    """(path, width, height, error) of image files; what cannot be read has an error.

    Without a ``content`` column each file is opened where the task runs and only
    its first HEADER_BYTES are read (the store must be one that Arrow opens).  With
    one, for stores that only Spark reads, the header is taken from the content.
    Spark's file scan itself leaves out files without a byte.
    """
    held = "content" in images.columns

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content if held else batch.path):
                try:
                    out.append((path, *(_size(bytes(content)) if held else _opened_size(path)), None))
                except Exception as e:  # any damage is a row of the report
                    out.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    return images.select("path", *(["content"] if held else [])).mapInPandas(run, "path string, width long, height long, error string")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_rows(book: bytes):
    """(sheet, row, cells) of a workbook: stored values as text, blank cells null, sheets in the book's order."""
    z = zipfile.ZipFile(io.BytesIO(book))
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
    shared = [words(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")):
        inner = target[sheet.get(_LINK)]
        last = 0
        for row in ElementTree.fromstring(z.read(inner[1:] if inner.startswith("/") else f"xl/{inner}")).iter(f"{_SHEET}row"):
            last = int(row.get("r") or last + 1)
            cells: list = []
            for cell in row.iter(f"{_SHEET}c"):
                place = 0
                for letter in "".join(filter(str.isalpha, cell.get("r") or "")):
                    place = place * 26 + ord(letter) - 64
                cells += [None] * (place - 1 - len(cells))
                kind, v = cell.get("t"), cell.findtext(f"{_SHEET}v")
                if kind == "inlineStr":
                    v = words(cell)
                elif kind == "s" and v is not None:
                    v = shared[int(v)]
                elif kind == "b" and v is not None:
                    v = "True" if v == "1" else "False"
                cells.append(v)
            yield n, sheet.get("name"), last, cells


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet_no, sheet, row, cells) of XLSX workbooks: cells as text, null where blank; a task reads whole workbooks."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = [(path, *r) for r in _sheet_rows(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "sheet_no", "sheet", "row", "cells"])

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return d.select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string, row long, cells array<string>")


def descriptors(rows: DataFrame) -> DataFrame:
    """(path, key, labels): from the second row on, the second cell is the key and the filled cells after it its labels; of equal keys the last row counts."""
    d = rows.where("row >= 2 AND size(cells) >= 2").withColumn("key", F.lower(F.trim(F.get("cells", F.lit(1))))).where("key != ''")
    labels = F.filter(F.transform(F.slice("cells", 3, F.size("cells")), lambda x: F.trim(x)), lambda x: x != "")
    return d.groupBy("path", "key").agg(F.max_by(labels, F.struct("sheet_no", "row")).alias("labels"))


def timeline(photos: DataFrame) -> DataFrame:
    """Photos, the newest first; equal times by id."""
    return photos.orderBy(F.desc("captured_ms"), F.desc("id"))
