"""Shapes of the physical plans."""

import subprocess
import sys

import pytest

from tallywise.plans import load

QUERIES, ORACLES = load()
# trained models and streams run jobs while they are built
BUILT_BY_JOBS = {"k06_k09_train_and_evaluate", "k07_model_search", "k08_predict", "k11_retrain_and_register",
                 "l01_file_drop_predict", "k09_registered_models"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BUILT_BY_JOBS))
def test_no_pairwise_joins_and_no_python_rows(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = plan_of(QUERIES["f04_confidence_tiers"](spark, sf))
    assert "props" not in plan.split("ReadSchema")[1]
    rows = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey > 10").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan_of(rows)


def test_row_level_queries_do_not_shuffle(spark, sf):
    for name in ("j01_bank_money", "c14_accounting_projection", "f08_f09_vote", "d03_review_queue", "c01_household_transform"):
        assert "hashpartitioning" not in plan_of(QUERIES[name](spark, sf)), name


def test_small_tables_are_not_dealt_out(spark, sf):
    assert "RoundRobin" not in plan_of(QUERIES["c12_debit_credit"](spark, sf))


def test_queries_load_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) < set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_term_weights_are_not_shuffled(spark, sf):
    for name in ("k01_tfidf_word", "k02_tfidf_char", "k03_apply_vocabulary"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "hashpartitioning" not in plan and "Window" not in plan, name
