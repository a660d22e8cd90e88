"""Lexicons, exact order statistics, merged identifiers, tables read in splits, and what follows a name on a line."""

import os
import statistics
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lendscope import stages
from lendscope.functions import lexicon, quantiles
from lendscope.operators import documents, filings, graph, research, signals
from lendscope.operators.statements import read_tables
from lendscope.plans.registry import QUERIES


def test_lexicons_hold_all_types_and_sectors():
    sections, sectors = lexicon.read_lexicon("sections"), lexicon.read_lexicon("sectors")
    assert len({t for t, *_ in sections}) == 10 and len({s for s, *_ in sectors}) == 16
    assert all(0 < float(r) < 1 for _, r, _ in sectors)
    assert ("annual_report", "related_party", "arm's length") in sections


def test_sections_by_document_type(spark, tmp_path):
    rows = [(1, "gst", "input tax credit and itc claimed"), (2, "legal", "in the court of appeal, plaintiff"), (3, "other", "income statement of ours"), (4, "itr", None), (5, "gst", "")]
    blocks = spark.createDataFrame([(i, 0, t, x) for i, t, x in rows], "doc_id long, block_no int, doc_type string, text string")
    found = {r["doc_id"]: (r["section"], r["confidence"]) for r in filings.classify_sections(blocks).collect()}
    assert found == {1: ("itc_details", 0.75), 2: ("case_header", 0.5), 3: ("profit_loss", 0.55), 4: ("unclassified", 0.15), 5: ("unclassified", 0.15)}
    (tmp_path / "own.csv").write_text("doc_type,section,phrase\ngst,mine,tax\n")
    own = filings.classify_sections(blocks, lexicon.read_lexicon(tmp_path / "own.csv"))
    assert own.where("doc_id = 1").first()["section"] == "mine"


def test_sectors_of_companies(spark):
    docs = spark.createDataFrame([(1, "A refinery and a lng pipeline"), (1, "solar"), (2, None), (3, "irrigation"), (3, "irrigation")], "company_id long, text string")
    found = {r["company_id"]: (r["sector"], r["hits"]) for r in research.sector_detect(docs).collect()}
    assert found == {1: ("energy", 4), 2: ("default", 0), 3: ("infrastructure", 2)}  # irrigation holds rig, too
    news = spark.createDataFrame([], "company_id long, sentiment string")
    none = spark.createDataFrame([], "company_id long, mentions long")
    risk = {r["company_id"]: (r["outlook"], r["sector_risk"]) for r in research.sector_risk(research.sector_detect(docs), news, none).collect()}
    assert risk == {1: ("NEUTRAL", 0.5), 2: ("NEUTRAL", 0.5), 3: ("NEUTRAL", 0.55)}


def test_order_statistics_are_exact_on_a_skewed_key(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.integers(0, 5000, 20_000)] + [("hot", 7.0)] * 5000 + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    values = spark.createDataFrame(rows, "key string, value double")
    by = {k: sorted(v for kk, v in rows if kk == k and v is not None) for k in ("hot", "one", "two")}
    assert {r["key"]: r["median"] for r in quantiles.upper_medians(values, ["key"]).collect()} == {k: v[len(v) // 2] for k, v in by.items()}
    assert {r["key"]: r["median"] for r in quantiles.medians(values, ["key"]).collect()} == {k: statistics.median(v) for k, v in by.items()}
    ninth = quantiles.order_statistic(values, ["key"], F.ceil(0.9 * F.col("n")), parts=5).collect()
    assert {r["key"]: r["value"] for r in ninth} == {k: v[int(np.ceil(0.9 * len(v))) - 1] for k, v in by.items()}
    assert quantiles.medians(values.limit(0), ["key"]).count() == 0


def test_identifiers_merge_in_the_order_of_first_sight(spark):
    pan = [f"ABCDE{i:04}F" for i in range(20)]
    blocks = [(2, 0, " ".join(pan[:3])), (1, 1, f"{pan[5]} {pan[0]}"), (1, 0, " ".join([pan[4], pan[4], *pan[6:18]])), (3, 0, None)]
    found = documents.section_identifiers(spark.createDataFrame(blocks, "doc_id long, block_no int, text string"))
    assert found.where("doc_id = 1 AND block_no = 0").count() == 10  # ten a section, repeated ones once
    merged = documents.merged_identifiers(found.withColumn("company_id", F.lit(9)), "company_id").orderBy("rank").collect()
    assert [r["value"] for r in merged] == [pan[4], *pan[6:15], pan[5], pan[0], pan[1], pan[2]]


def test_one_large_file_is_read_in_splits(spark, tmp_path):
    lines, wanted = [], []
    for i in range(3000):
        note = f'"said ""{i}"",\nand so, on"' if i % 7 == 0 else f"plain {i}"
        lines.append(",".join([str(i), note, *[str(j) for j in range(70)]]))
        wanted.append([str(i), f'said "{i}",\nand so, on' if i % 7 == 0 else f"plain {i}", *map(str, range(70))])
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.csv").write_text('a, b ,,\n\n,,\n"x; y",z\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(f"{tmp_path}/big.csv").rdd.getNumPartitions() > 10
        rows = read_tables(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    of = lambda name: [r["cells"] for r in sorted(rows, key=lambda r: r["row_no"]) if r["table_id"].endswith(name)]
    assert of("big.csv") == wanted
    assert of("small.csv") == [["a", "b"], ["x; y", "z"]]
    assert len({(r["table_id"], r["row_no"]) for r in rows}) == len(rows)


def test_figures_after_a_name(spark):
    text = "Debt-to-equity ratio was\nnot told\nD/E: 2.5 times\nDSCR of the year 1.1; current ratio 0.9\nCapacity of 3 lines, used at 65 %\nThe top 5 customers give 45 %. collateral Rs. 25.5"
    docs = spark.createDataFrame([(1, 1, text), (1, 2, "DSCR 9"), (2, 1, None)], "company_id long, doc_id long, text string")
    row = {r["company_id"]: r for r in documents.text_ratios(docs).collect()}[1]
    assert (row["debt_to_equity"], row["dscr"], row["current_ratio"], row["cfo"]) == (2.5, 1.1, 0.9, None)
    notes = {r["company_id"]: r for r in filings.notes_signals(docs.where("doc_id = 1").withColumn("debt_crore", F.lit(10.0))).collect()}
    assert (notes[1]["collateral_coverage"], notes[1]["capacity_utilization"], notes[1]["customer_concentration"]) == (2.55, 0.65, 0.45)
    assert (notes[2]["collateral_coverage"], notes[2]["capacity_utilization"], notes[2]["customer_concentration"]) == (1.3, 0.7, 0.4)


def test_promoters_in_the_news_make_no_pairs(spark):
    articles = spark.createDataFrame([(1, i, "NEGATIVE", f"Award case {i}") for i in range(50)] + [(1, 99, "POSITIVE", "award"), (2, 1, "NEGATIVE", None)], "company_id long, ordinal long, sentiment string, title string")
    promoters = spark.createDataFrame([(1, "Award Singh"), (1, "case Rao"), (2, "Steel Iyer"), (2, "")], "company_id long, name string")
    assert [tuple(r) for r in signals.promoter_news(articles, promoters).collect()] == [(1, 50)]


def plain_cycles(edges, longest):
    out = {}
    ahead = {}
    for s, d, t in edges:
        ahead.setdefault(s, {})[d] = t
    def walk(path, total):
        for d, t in ahead.get(path[-1], {}).items():
            if d == path[0] and len(path) > 1:
                out[">".join(path)] = round(total + t, 2)
            elif d > path[0] and d not in path and len(path) < longest:
                walk([*path, d], total + t)
    for s in ahead:
        walk([s], 0.0)
    return out


def test_cycles_with_hubs_equal_a_walk(spark):
    rng = np.random.default_rng(7)
    names = [f"N{i:02}" for i in range(40)]
    pairs = {(names[a], names[b]) for a, b in rng.integers(0, 40, (150, 2)).tolist() if a != b}
    pairs |= {("HUB", n) for n in names[:25]} | {(n, "HUB") for n in names[15:40]} | {("X", "Y"), ("Y", "Z"), ("Z", "HUB"), ("START", "X")}
    edges = [(s, d, float(i % 90 + 1)) for i, (s, d) in enumerate(sorted(pairs))]
    df = spark.createDataFrame([(1, s, d, t, 1) for s, d, t in edges], "company_id long, src string, dst string, total_amount double, txn_count long")
    for longest in (2, 3, 4, 5):
        found = graph.cycles(df, longest).collect()
        assert {r["path"]: r["amount"] for r in found} == plain_cycles(edges, longest)
        assert len(found) == len({r["path"] for r in found}) and Counter(r["length"] for r in found).keys() <= set(range(2, longest + 1))
    assert graph.cycles(df.limit(0)).count() == 0


def test_cycles_keep_no_table_but_their_own(spark):
    """Edges are a step of the run, places are whole numbers of their own, and what the search wrote goes."""
    with stages.run(spark, "/root/testdata/sf0.001") as run:
        found = QUERIES["cycle_score"](spark, run)
        assert "edges_graph_txns" in run.steps and found.count() == 1
        left = [(at, sorted(names)) for at, names, _ in os.walk(run.place.removeprefix("file://")) if len(os.path.basename(at)) == 32]
        assert [names for _, names in left] == [["cycles"]]
        pay = run.steps["edges_graph_txns"].where("total_amount > 0 AND src <> dst")
        nodes, kept, _ = graph.placed(pay, stages.shared_place(spark))
        assert dict(kept.dtypes) == {"company_id": "int", "s": "bigint", "d": "bigint"}
        told = nodes.agg(F.count("at"), F.count_distinct("at"), F.min("at")).first()
        assert told[0] == told[1] > 0 and told[2] >= 0
        order = [r["degree"] for r in nodes.join(graph.both_ways(pay, "src", "dst"), ["company_id", "node"]).orderBy("at").collect()]
        assert all(np.floor(8 * np.log2(a)) <= np.floor(8 * np.log2(b)) for a, b in zip(order, order[1:]))
