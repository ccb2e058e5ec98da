"""Sources: delimited text, header-coded matrices, gene-set and record files, JSON documents, workbooks, file inventories, seed lists."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assaymill.functions.scalars import integral_text

HEADER = r"^(.*) \((\d+)\)$"  #: ``SYMBOL (NUMBER)``; the last parenthesis counts


def csv_strings(spark: SparkSession, path: str, columns: list[str], wanted: list[str] | None = None, sep: str = ",") -> DataFrame:
    """All columns as strings, empty fields as NULL; the schema is given, never inferred; ``wanted`` prunes in the scan."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=False, enforceSchema=True)
    return df.select(*wanted) if wanted else df


def header_line(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(pos, name): the fields of the first line, without a byte order mark; reads no other line."""
    line = spark.read.text(path).limit(1)
    clean = F.regexp_replace("value", "^﻿", "")
    return line.select(F.posexplode(F.split(clean, sep, -1)).alias("pos", "name"))


def csv_with_mark(spark: SparkSession, path: str) -> DataFrame:
    """A string table whose file may start with a byte order mark."""
    names = [r["name"] for r in header_line(spark, path).orderBy("pos").collect()]
    return csv_strings(spark, path, names)


def header_pairs(header: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pos, symbol, number), rejected (pos, name)) of columns named ``SYMBOL (NUMBER)``."""
    hit = F.col("name").rlike(HEADER)
    pairs = header.filter(hit).select("pos", F.regexp_extract("name", HEADER, 1).alias("symbol"), F.regexp_extract("name", HEADER, 2).alias("number"))
    return pairs, header.filter(~hit).select("pos", "name")


def matrix_rows(spark: SparkSession, path: str, n_meta: int, id_pos: int, keep: DataFrame | None = None) -> DataFrame:
    """(entity, values array<double>) of a wide matrix without making thousands of columns; ``keep`` (entity) selects rows by a semi join.

    Empty fields and NA are missing, which is not zero. The header line is told by its first field.
    """
    first = spark.read.text(path).limit(1).first()
    head = first["value"] if first else ""
    f = F.split("value", ",", -1)
    rows = spark.read.text(path).filter(F.col("value") != F.lit(head)).select(f[id_pos].alias("entity"), F.slice(f, n_meta + 1, F.greatest(F.size(f) - n_meta, F.lit(0))).alias("v"))
    if keep is not None:
        rows = rows.join(keep.select("entity").distinct(), "entity", "left_semi")
    return rows.select("entity", F.transform("v", lambda x: F.when(~F.trim(x).isin("", "NA", "NaN"), F.trim(x).try_cast("double"))).alias("values"))


def gene_sets(spark: SparkSession, path: str, numeric_only: bool = False) -> DataFrame:
    """(set_name, members) of ``name <tab> link <tab> member ...`` lines with at least one member."""
    f = F.split(F.rtrim("value"), "\t", -1)
    sets = spark.read.text(path).filter(F.size(f) >= 3).select(f[0].alias("set_name"), F.slice(f, 3, F.size(f) - 2).alias("members"))
    if numeric_only:
        sets = sets.withColumn("members", F.filter("members", lambda m: m.rlike(r"^\d+$")))
    return sets


def flat_records(spark: SparkSession, path: str, xrefs: list[str]) -> DataFrame:
    """(accession, name, one array per cross-reference) of records that end with a line ``//`` and have lines tagged ID, AC and DR."""
    rec = spark.read.option("lineSep", "//\n").text(path).filter(F.trim("value") != "")
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("value", rf"(?m)^{t}\s+(.*?)\s*$", 1), ";$", ""))
    refs = [F.regexp_extract_all("value", F.lit(rf"(?m)^DR\s+{re.escape(x)};\s*([^\s;]+)"), 1).alias(x.lower()) for x in xrefs]
    return rec.select(tag("AC").alias("accession"), tag("ID").alias("name"), *refs).filter("accession <> ''")


def json_documents(spark: SparkSession, path: str, schema: str, status: str | None = None) -> DataFrame:
    """JSON files (one document each) of a folder, with their path; optionally those of one status."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return df if status is None else df.filter(F.col("status") == status)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, sha256) of all files below a folder; contents are hashed where they are read.

    The binary source holds a file in one row; files near 2 GB and above belong to ``inventory_chunked``. Empty files, which file scans
    leave out, come from the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    full = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return full.unionByName(empty_files(spark, root, pattern)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def empty_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files without content."""
    import fnmatch
    import hashlib

    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, it = [], p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0 and fnmatch.fnmatch(f.getPath().getName(), pattern):
            found.append((f.getPath().toString(), 0, hashlib.sha256(b"").hexdigest()))
    return spark.createDataFrame(found, "path string, length bigint, sha256 string")


def inventory_chunked(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """As ``inventory``, streaming every file in 1 MiB pieces; for files of any size, on any file system Arrow opens by its URI (local, HDFS, object stores)."""
    import hashlib

    from pyarrow import fs

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = []
            for p in b["path"]:
                h = hashlib.sha256()
                system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p))
                with system.open_input_stream(path) as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                sums.append(h.hexdigest())
            yield b.assign(sha256=sums)

    return files.mapInPandas(run, "path string, length bigint, sha256 string").unionByName(empty_files(spark, root, pattern)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(row, cells array<string>) of the first sheet of XLSX workbooks, by zip and XML parsing alone; one workbook per task."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}

    def column(ref: str) -> int:
        n = 0
        for ch in re.sub(r"\d", "", ref):
            n = n * 26 + ord(ch) - 64
        return n - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
                    sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
                    rows = []
                    for i, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"), 1):
                        cells: list[str | None] = []
                        for c in row.findall("m:c", ns):
                            at = column(c.get("r", "")) if c.get("r") else len(cells)
                            cells += [None] * (at + 1 - len(cells))
                            v, text = c.find("m:v", ns), c.find("m:is/m:t", ns)
                            cells[at] = text.text if text is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                        rows.append((name, int(row.get("r", i)), cells))
                yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def seed_candidates(*lists: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(name, candidates array<struct<source, id>>) from several seed tables (df, source, name column, id column); float-like ids are repaired, placeholders dropped."""
    parts = [d.select(F.trim(n).alias("name"), F.struct(F.lit(s).alias("source"), integral_text(F.trim(F.col(i).cast("string"))).alias("id")).alias("c")) for d, s, n, i in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("name <> '' AND c.id IS NOT NULL AND lower(c.id) NOT IN ('', 'nan', 'none')").groupBy("name").agg(F.array_sort(F.collect_set("c")).alias("candidates"))


def first_per_id(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of every integer-like id, with the id as a number to sort by."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), position).alias("_x")).select(key, "_x.*").withColumn("id_number", integral_text(F.col(key).cast("string")).try_cast("bigint"))
