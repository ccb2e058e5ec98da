"""Queries of the training-data operators on the test tables."""

import os

import pytest

from assaymill.llm import queries as Q
from tests.oracle import SF, connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
FOUND = {
    "p2_found": ["sanger_model_id", "model_id"], "p3_found": ["feature", "vec_id_a", "vec_id_b"], "p4_found": ["sample_id_a", "sample_id_b"], "p6_found": ["compound_id", "chemical_group_id"],
    "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_agrees_with_sql(spark, name):
    assert not differences(Q.QUERIES[name](spark, SF), connect(), Q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.columns == FOUND[name]
    got = [tuple(r) for r in df.collect()]
    assert got and len(got) == len(set(got)) and all(None not in r for r in got)


def test_recall_and_reports(spark):
    assert all(r["n_true"] == 0 or r["recall"] >= 0.9 for r in Q.p3_recall(spark, SF).collect())
    shares = {r["source"]: r for r in Q.p8_shares(spark, SF).collect()}
    assert all(r["most_repeats"] <= r["max_repeats"] for r in shares.values())
    assert Q.p9_composition(spark, SF).count() > 0 and Q.p7_leaked_items(spark, SF).count() == 160
    assert all(r["within"] for r in Q.p8_gap(spark, SF).collect()) and all(r["within"] for r in Q.p5_gap(spark, SF).collect())
    assert Q.p7_reparameterised(spark, SF).columns == ["doc_id", "item_id", "covered", "renamed"]
    assert Q.p5_shares(spark, SF).count() > 0 and Q.p2_matches(spark, SF).filter("confidence <= 0 OR confidence > 1").count() == 0
