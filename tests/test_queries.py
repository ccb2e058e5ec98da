"""Every core query with an SQL twin agrees with it, and plans read no more than they need."""

import os

import pytest

from assaymill.plans import checks, entities, evaluation, general, inputs, modelling
from tests.oracle import SF, connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
MODULES = [general, inputs, entities, checks, evaluation, modelling]


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rpartition(".")[2])
def test_queries_agree_with_sql(spark, duck, module):
    wrong = {n: d for n, sql in module.ORACLE.items() if (d := differences(module.QUERIES[n](spark, SF), duck, sql))}
    assert not wrong


def test_every_twin_has_a_query():
    for m in MODULES:
        assert set(m.ORACLE) <= set(m.QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = inputs.s11_pruned_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), LessThan(l_quantity,5.0), EqualTo(l_returnflag,R)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in plan
