"""Dangling references: nulls, placeholders, repeats, boundaries, skew, empty and clashing tables."""

from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from assaymill.operators import orphans as O
from tests.conftest import rows

MASTER = "cell_id string, registered_at timestamp_ntz, retired_at timestamp_ntz, period string, id string"
FACTS = "sample_id string, cell_id string, loaded_at timestamp_ntz, field string"


def made(spark, facts, master, **kw):
    m = spark.createDataFrame([(*x, "p", "x") for x in master], MASTER)
    f = spark.createDataFrame([(*x, "clash") for x in facts], FACTS)
    return O.judge(O.references(f, ["cell_id"], "loaded_at", "sample_id"), O.validity(m, "cell_id", "cell_id"), **kw)


def test_boundaries_nulls_and_repeats(spark):
    master = [("cl1 ", T(2024, 1, 10), T(2024, 2, 10)), ("CL1", T(2024, 2, 10), T(2024, 3, 1)), ("CL1", T(2024, 2, 10), T(2024, 3, 1)), ("CL2", None, None), ("CL3", T(2024, 1, 1), None), ("CL4", T(2024, 2, 1), T(2024, 1, 1))]
    facts = [
        ("a", "CL1", T(2024, 1, 10)), ("b", "CL1", T(2024, 1, 9)), ("c", " cl1", T(2024, 2, 10)), ("d", "CL1", T(2024, 3, 1)), ("e", "CL2", T(2024, 5, 1)), ("f", "CL3", T(2024, 5, 1)), ("g", "unknown", T(2024, 5, 1)),
        ("h", None, T(2024, 5, 1)), ("i", "CL9", T(2024, 5, 1)), ("i", "CL9", T(2024, 5, 1)), ("j", "CL3", None), (None, "CL9", T(2024, 5, 2)), ("k", "CL4", T(2024, 1, 15)),
    ]
    j = made(spark, facts, master)
    found = rows(O.dangling_rows(j).select("row_id"))
    assert found == [("b",), ("d",), ("e",), ("i",), ("i",), ("j",), ("k",), (None,)]
    counts = {(r["period"] and r["period"].isoformat()): (r["n_dangling"], r["n_ids"]) for r in O.dangling_counts(j).collect()}
    assert counts == {"2024-01-01": (2, 2), "2024-03-01": (1, 1), "2024-05-01": (4, 2), None: (1, 1)}


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_hot_key_takes_either_path_with_equal_results(spark, broadcast_rows):
    facts = [(f"s{i}", "CL1", T(2024, 1 + i % 3, 5)) for i in range(300)] + [(f"t{i}", f"CL{i}", T(2024, 2, 5)) for i in range(2, 40)]
    master = [("CL1", T(2024, 2, 1), T(2024, 3, 1)), *[(f"CL{i}", T(2024, 1, 1), None) for i in range(2, 40, 2)]]
    j = made(spark, facts, master, heavy_share=0.1)
    assert rows(j.heavy.select("id")) == [("CL1",)]
    got = {r["row_id"] for r in O.dangling_rows(j, broadcast_rows=broadcast_rows).collect()}
    assert got == {f"s{i}" for i in range(300) if i % 3 != 1} | {f"t{i}" for i in range(3, 40, 2)}
    assert O.dangling_counts(j, broadcast_rows).agg(F.sum("n_dangling")).first()[0] == len(got)


def test_empty_tables(spark):
    assert made(spark, [], []).judged.count() == 0
    assert O.dangling_rows(made(spark, [], [("CL1", T(2024, 1, 1), None)])).count() == 0
    assert rows(O.dangling_rows(made(spark, [("a", "CL1", T(2024, 1, 1))], [])).select("row_id")) == [("a",)]
