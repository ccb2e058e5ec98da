"""Readers, sinks and the download utility on literal files."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from assaymill.sources import download as D, readers as R, sinks as W
from tests.conftest import rows


def test_matrix_gene_sets_and_records(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,meta,A (1),B (x) (2),bad\nM1,q,1.5,NA,\nM2,q,2,3,4\n", encoding="utf-8")
    pairs, bad = R.header_pairs(R.header_line(spark, str(tmp_path / "m.csv")))
    assert rows(pairs) == [(2, "A", "1"), (3, "B (x)", "2")] and [r["name"] for r in bad.orderBy("pos").collect()] == ["id", "meta", "bad"]
    got = {r["entity"]: r["values"] for r in R.matrix_rows(spark, str(tmp_path / "m.csv"), 2, 0).collect()}
    assert got == {"M1": [1.5, None, None], "M2": [2.0, 3.0, 4.0]}
    keep = spark.createDataFrame([("M2",), ("M2",), ("M9",)], "entity string")
    assert R.matrix_rows(spark, str(tmp_path / "m.csv"), 2, 0, keep).count() == 1
    (tmp_path / "s.gmt").write_text("S1\tu\t1\t2\tX\nS2\tu\n")
    assert rows(R.gene_sets(spark, str(tmp_path / "s.gmt"), True).select("set_name", F.size("members"))) == [("S1", 2)]
    (tmp_path / "c.txt").write_text("ID   HeLa\nAC   CVCL_0030;\nDR   Cosmic; 1;\nDR   Cosmic; 2;\n//\nID   X\nAC   CVCL_1;\n//\n")
    got = {r["accession"]: (r["name"], r["cosmic"]) for r in R.flat_records(spark, str(tmp_path / "c.txt"), ["Cosmic"]).collect()}
    assert got == {"CVCL_0030": ("HeLa", ["1", "2"]), "CVCL_1": ("X", [])}


def test_csv_is_all_strings_with_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n007,\n"x,y","q""z"\n')
    assert rows(R.csv_strings(spark, str(tmp_path / "a.csv"), ["a", "b"])) == [("007", None), ("x,y", 'q"z')]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert [(r["row"], r["cells"]) for r in R.workbook(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()] == [(1, ["name", None, "2.5"]), (3, [None, "ab", "in"])]


def test_inventory_agrees_with_chunked_hashing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.bin").write_bytes(b"x" * 3_000_000)
    (tmp_path / "d" / "b.bin").write_bytes(b"")
    a, b = (rows(f(spark, str(tmp_path)).select("name", "length", "sha256")) for f in (R.inventory, R.inventory_chunked))
    assert a == b and len(a) == 2


def test_seed_candidates_and_first(spark):
    s = spark.createDataFrame([("n1", "12.0"), ("n1", "nan"), ("n2", None)], "name string, cid string")
    t = spark.createDataFrame([("n1", "7"), ("", "8")], "name string, cid string")
    assert [(r["name"], [(c["source"], c["id"]) for c in r["candidates"]]) for r in R.seed_candidates((s, "s", "name", "cid"), (t, "t", "name", "cid")).collect()] == [("n1", [("s", "12"), ("t", "7")])]
    d = spark.createDataFrame([("10", "b", 2), ("10", "a", 1), ("9.0", "c", 3)], "id string, v string, p int")
    assert [(r["id"], r["v"]) for r in R.first_per_id(d, "id", "p").orderBy("id_number").collect()] == [("9.0", "c"), ("10", "a")]


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b string")
    assert W.csv_report(empty, tmp_path / "e.csv") == 0 and (tmp_path / "e.csv").read_text().strip() == "a,b"
    with pytest.raises(ValueError):
        W.csv_report(spark.range(5).toDF("x"), tmp_path / "f.csv", limit=3)
    assert W.feature_dir("r", 1, 2) != W.feature_dir("r", 1, 3) and W.feature_dir("r", 1, 2).split("/")[1] == W.feature_dir("r", 1, 3).split("/")[1]
    root = f"file://{tmp_path}/cache"
    first = W.cached_features(spark.range(3).toDF("x"), root, "v1")
    assert W.cached_features(spark.range(9).toDF("x"), root, "v1").count() == 3 == first.count() and W.cached_features(spark.range(9).toDF("x"), root, "v2").count() == 9
    t = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0)], "k string, n string, v double")
    assert rows(W.wide_contributions(t, "k", "n", "v", ["a", "b", "c"])) == [("s", 1.0, 2.0, None)]


class Reply(io.BytesIO):
    def __init__(self, data, length=None):
        super().__init__(data)
        self.headers = {"Content-Length": str(len(data) if length is None else length)}


def test_download_checks_retries_and_never_overwrites(tmp_path):
    calls = []

    def flaky(url):
        calls.append(url)
        return Reply(gzip.compress(b"data"), None if len(calls) > 1 else 999)

    rec = D.download("http://x/f.gz", tmp_path / "f.gz", wait=0, opener=flaky)
    assert rec["kind"] == "gzip" and rec["attempts"] == 2 and not (tmp_path / "f.gz.part").exists()
    with pytest.raises(FileExistsError):
        D.download("http://x/f.gz", tmp_path / "f.gz", opener=flaky)
    with pytest.raises(ValueError):
        D.download("http://x/g", tmp_path / "g", opener=lambda u: Reply(b"<!DOCTYPE html><p>"), wait=0)
    assert not (tmp_path / "g").exists()


def test_lookup_is_limited_and_survives_failures():
    waits, seen = [], []

    def fetch(k):
        seen.append(k)
        if k == "bad":
            raise OSError("down")
        return {"k": k}

    out = D.lookup(["a", "bad", "a"], fetch, sleep=waits.append)
    assert out == {"a": {"k": "a"}, "bad": None} and seen == ["a", "bad", "bad", "bad"] and len(waits) == 4
    assert list(D.refetch_conflicts([{"key": 1, "status": "conflict"}, {"key": 2, "status": "exact"}], fetch, sleep=waits.append)) == ["1"]
