import pytest

from lendscope.plans import model_queries
from lendscope.plans.inputs import frame
from lendscope.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE_SQL[name])


def test_model_queries(spark, monkeypatch):
    """No SQL tells them: held-out metrics, and scores in their ranges; with fewer trees than the queries grow."""
    monkeypatch.setattr(model_queries, "TREES", 20)
    place = "/root/testdata/sf0.01"
    metrics = QUERIES["ml_train_eval"](spark, place).first()
    assert metrics["rows"] > 0 and metrics["auc"] > 0.9 and metrics["accuracy"] > 0.8
    n = spark.read.parquet(f"{place}/customer.parquet").count()
    scores = QUERIES["ml_score"](spark, place).collect()
    assert len(scores) == n and all(0 <= r["low"] <= r["credit_score"] <= r["high"] <= 100 for r in scores)
    drivers = QUERIES["feature_drivers"](spark, place).collect()
    assert {r["rank"] for r in drivers} == set(range(1, 11)) and len({r["company_id"] for r in drivers}) == n
    assert len({r["feature"] for r in drivers if r["rank"] == 1}) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["company_id", "layered_score", "pairs", "severity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_macro_items_and_directors_come_from_all_rows(spark):
    place = "/root/testdata/sf0.001"
    assert frame(spark, place, "macro_items").count() == frame(spark, place, "documents").count()
    links = frame(spark, place, "lineitem").selectExpr("l_suppkey", "l_partkey % 500").distinct().count()
    assert frame(spark, place, "directors").count() == links
