"""Stages of a run, trees as a table, exact ranks, and one run from transactions to the sink."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope import stages
from lendscope.operators import decision, model, trees
from lendscope.plans import model_queries
from lendscope.plans.inputs import FEATURES, frame
from lendscope.plans.registry import QUERIES
from lendscope.sources import feeds

SF = "/root/testdata/sf0.001"
NAMES = list(FEATURES)


def test_a_step_is_written_once_and_goes_with_the_run(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    with stages.run(spark, SF) as run:
        assert stages.step(run, "a", build).count() == stages.step(run, "a", build).count() == 5 and len(built) == 1
        with stages.run(spark, run) as inner:
            assert inner is run
        place = run.place.removeprefix("file://")
        assert os.path.isdir(f"{place}/a") and f"{run}/x" == f"{SF}/x"
        kept = run.result(stages.step(run, "a", build))
    assert not os.path.exists(place) and kept.count() == 5
    assert stages.step(SF, "a", build).count() == 5 and len(built) == 2


def test_a_run_reads_payments_twice_at_most(spark):
    with stages.run(spark, SF) as run:
        QUERIES["feature_vector"](spark, run)
        read = [name for name, df in run.steps.items() if any("lineitem" in f for f in df.inputFiles())]
        assert {"movements", "fin_lines", "bank_monthly", "itc", "edges_txns"} <= set(run.steps) and not read
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in run.steps.values()]
        assert max(p.count("Relation") for p in plans) <= 1  # each step reads its own table alone


@pytest.fixture(scope="module")
def trained(spark):
    f = frame(spark, SF, "features")
    seen, held = model.split(f.join(decision.ml_labels(f), "company_id"))
    return f, model.train(seen, NAMES, trees=6, depth=3), held


def test_trees_as_a_table(spark, trained, tmp_path):
    f, fitted, _ = trained
    count = len(fitted.stages[-1].trees)
    table = trees.tree_table(fitted.stages[-1], f"file://{tmp_path}/model", spark)
    ready = model.prepared(fitted, f)
    impacts = trees.steps(ready, table, count, 3)
    found = {r["company_id"]: r["p"] for r in trees.margins(ready, impacts, trees.base_margin(table)).collect()}
    scored = {r["company_id"]: r["default_probability"] for r in model.ml_score(fitted, f).collect()}
    assert len(found) == len(scored) == f.count()
    assert all(abs(found[i] - p) < 1e-4 for i, p in scored.items())  # contributions and roots add up to the score
    table.write.parquet(f"{tmp_path}/trees")
    ready.write.parquet(f"{tmp_path}/rows")
    con = duckdb.connect()
    sql = f"""WITH RECURSIVE t AS (SELECT * FROM '{tmp_path}/trees/*.parquet'), r AS (SELECT * FROM '{tmp_path}/rows/*.parquet'),
      walk AS (SELECT company_id, v, tree, 0 AS node FROM r, (SELECT DISTINCT tree FROM t)
             UNION ALL SELECT company_id, v, tree, CASE WHEN v[feature + 1] <= threshold THEN "left" ELSE "right" END FROM walk JOIN t USING (tree, node) WHERE feature IS NOT NULL)
      SELECT company_id, 1 / (1 + exp(-2 * sum(weight * value))) AS p FROM walk JOIN t USING (tree, node) WHERE feature IS NULL GROUP BY 1"""
    told = dict(con.execute(sql).fetchall())
    assert told.keys() == found.keys() and all(math.isclose(told[i], found[i], abs_tol=1e-9) for i in told)
    rows = trees.drivers(impacts, NAMES, 4).collect()
    first = {r["company_id"]: (r["feature"], r["impact"]) for r in rows if r["rank"] == 1}
    assert len(set(first.values())) > 1 and max(r["rank"] for r in rows) <= 4  # drivers differ by row


def test_rows_walk_in_their_own_tasks(spark, trained, tmp_path):
    """No row is multiplied by the trees or joined with them, and rows are dealt over all tasks, though they are one small file."""
    f, fitted, _ = trained
    table = trees.tree_table(fitted.stages[-1], f"file://{tmp_path}/model", spark)
    ready = model.prepared(fitted, stages.write(stages.spread(f, "company_id"), f"file://{tmp_path}/rows"))
    assert len(ready.inputFiles()) == spark.sparkContext.defaultParallelism
    impacts = trees.steps(ready, table, len(fitted.stages[-1].trees), 3)
    plan = impacts._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Exchange", "Generate"))
    nodes = {(r["tree"], r["node"]): r for r in table.collect()}
    want = {}
    for row in ready.collect():
        for tree in {t for t, _ in nodes}:
            at = nodes[tree, 0]
            while at["left"] is not None:
                side = "left" if row["v"][at["feature"]] <= at["threshold"] else "right"
                key = row["company_id"], at["feature"]
                want[key] = want.get(key, 0.0) + at["weight"] * (at[f"{side}_value"] - at["value"])
                at = nodes[tree, at[side]]
    found = {(r["company_id"], r["feature"]): r["impact"] for r in impacts.collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-9) for k in want)
    assert impacts.count() == len(found) and trees.steps(ready.limit(0), table, 6, 3).count() == 0


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 40, 3000), rng.integers(0, 2, 3000), strict=True)] + [(7.0, 1)] * 500 + [(None, 1)]
    scores = spark.createDataFrame(rows, "score double, label int")
    good = np.array([s for s, y in rows if y == 1 and s is not None])
    bad = np.array([s for s, y in rows if y == 0])
    want = ((good[:, None] > bad[None]).sum() + 0.5 * (good[:, None] == bad[None]).sum()) / (len(good) * len(bad))
    for parts in (3, 256):
        found = model.rank_auc(scores, parts).first()
        assert abs(found["auc"] - want) < 1e-6 and (found["positives"], found["negatives"]) == (len(good), len(bad))
    assert model.rank_auc(scores.where("label = 1")).first()["auc"] is None
    assert tuple(model.rank_auc(scores.limit(0)).first()) == (None, 0, 0)


def test_one_run_from_transactions_to_the_sink(spark, monkeypatch):
    """Each figure of the result is worked out again from the tables, the features and the model's score."""
    monkeypatch.setattr(model_queries, "TREES", 5)
    found = {r["company_id"]: r for r in QUERIES["run_decision"](spark, SF).collect()}
    features = {r["company_id"]: r for r in QUERIES["feature_vector"](spark, SF).collect()}
    assert found.keys() == features.keys()
    # A feature from the payments themselves: turnover declared against turnover banked.
    con = duckdb.connect()
    sums = con.execute(f"""SELECT * FROM (SELECT o_custkey, sum(o_totalprice) AS gst FROM '{SF}/orders.parquet' GROUP BY 1)
      JOIN (SELECT o_custkey, sum(l_extendedprice) AS bank FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey GROUP BY 1) USING (o_custkey)""").fetchall()
    told = {i: round(min(abs(g - b) / g / 0.5, 1.0), 3) for i, g, b in sums}
    close = [i for i in told if abs(features[i]["gst_bank_mismatch_score"] - told[i]) <= 0.0015]
    assert len(close) == len(told) > 50
    for i, r in found.items():
        f, result = features[i].asDict(), r["result"]
        hard = [n for n, op, t in decision.HARD_RULES if (f[n] > t if op == ">" else f[n] < t)]
        points = sum(p for n, op, t, p in decision.POLICY_RULES if (f[n] > t if op == ">" else f[n] < t))
        assert result["rules"]["hard_reject"] == bool(hard) and result["rules"]["reason"] == (hard[0] if hard else None)
        assert result["rules"]["policy_score"] == max(100 - points, 0)
        ml = result["model"]["ml_score"]
        assert abs(100 * (1 - result["model"]["ml_default_probability"]) - ml) < 0.1
        if hard:
            assert (r["verdict"], result["decision"]["credit_score"]) == ("REJECT", ml)
        else:
            s = result["decision"]["credit_score"]
            assert r["verdict"] == ("APPROVE" if s >= 75 else "CONDITIONAL_APPROVE" if s >= 60 else "REJECT")
        assert abs(result["decision"]["default_probability"] - 1 / (1 + math.exp(-(0.5 - 0.055 * result["decision"]["credit_score"])))) < 1e-4
        assert (result["decision"]["conditions"] is None) == (r["verdict"] == "REJECT")
        assert [x["rank"] for x in result["explanation"]["drivers"]] == list(range(1, len(result["explanation"]["drivers"]) + 1))
    totals = {r["company_id"]: r["weighted_total"] for r in decision.scorecard(QUERIES["feature_vector"](spark, SF)).collect()}
    for i, r in found.items():
        if not r["result"]["rules"]["hard_reject"]:
            mixed = 0.5 * r["result"]["model"]["ml_score"] + 0.2 * r["result"]["rules"]["policy_score"] + 0.3 * totals[i]
            assert abs(r["result"]["decision"]["credit_score"] - mixed) <= 0.051
    trace = QUERIES["run_trace"](spark, SF).where("is_top_driver").groupBy("company_id").agg(F.collect_set("feature").alias("x")).collect()
    for r in trace:
        assert set(r["x"]) == {x["feature"] for x in found[r["company_id"]]["result"]["explanation"]["drivers"]}


def test_a_batch_is_replaced_as_a_whole(spark, tmp_path):
    place = f"file://{tmp_path}/sink"
    rows = lambda *x: spark.createDataFrame(list(x), "company_id long, verdict string")
    feeds.write_results(rows((1, "APPROVE"), (2, "REJECT")), place, "monday")
    feeds.write_results(rows((1, "APPROVE")), place, "tuesday")
    feeds.write_results(rows((1, "REJECT"), (2, "REJECT"), (3, "REJECT")), place, "monday", rows_in_file=1)
    assert sorted(map(tuple, feeds.read_results(spark, place, "monday").collect())) == [(1, "REJECT"), (2, "REJECT"), (3, "REJECT")]
    assert feeds.read_results(spark, place, "tuesday").count() == 1
    assert len([f for _, _, names in os.walk(f"{tmp_path}/sink/batch=monday") for f in names if f.endswith(".parquet")]) == 3


def test_only_series_are_aggregated_as_objects(spark):
    """Greatest values are plain sums of a hash table; companies without a series, and none, keep their row."""
    lines = [(1, "revenue", 2021, 5.0), (1, "revenue", 2020, 7.0), (1, "inventories", 2021, 3.0), (2, "cash", 2021, 4.0), (None, "pat", 2021, 1.0)]
    out = decision.fin_agg(spark.createDataFrame(lines, "company_id long, metric string, period int, value double"))
    objects = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "ObjectHashAggregate" in x]
    assert objects and not any("max(" in x for x in objects)
    found = {r["company_id"]: r for r in out.collect()}
    assert len(found) == 3 and found[1]["revenue_series"] == [5.0, 7.0] and found[1]["revenue"] == 7.0 and found[1]["inventories"] == 3.0
    assert found[2]["cash"] == 4.0 and found[2]["revenue_series"] == [] and found[None]["pat_series"] == [1.0]


def test_texts_are_searched_by_all_tasks(spark):
    plan = QUERIES["sector_detect"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and f", {spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
