"""Registered queries of the feature row, the model, evidence, feeds and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendscope.functions.rounding import half_up_sql as r
from lendscope.operators import credit, decision, filings, graph, model, trees, vectors
from lendscope.plans import signal_queries, statement_queries  # noqa: F401  whose queries are parts of those here
from lendscope.plans.filing_queries import CLASSIFIED, FILINGS
from lendscope.plans.figures import FIN
from lendscope.plans.inputs import FEATURES, frame
from lendscope.plans.inputs import sql as s
from lendscope.plans.queries import F_SQL, FIRED, ORACLE_SQL, QUERIES, RULES, SCORECARD, SHELL_SCORE, VERDICT, _fin, query
from lendscope.sources import feeds
from lendscope.stages import delete, run, shared_place, spread, step, whole, write

NAMES = list(FEATURES)
#: Query, then its columns and the features that they are.
PARTS = {
    "ratios": {c: c for c in ("ebitda_margin", "pat_margin", "debt_to_equity", "current_ratio", "interest_coverage_ratio", "dscr")}, "cagr": {"growth": "revenue_growth_3yr"},
    "days": {c: c for c in ("debtor_days", "inventory_days", "working_capital_days")}, "cfo_volatility": {"cfo_volatility": "cashflow_volatility"},
    "gst_bank_mismatch": {"score": "gst_bank_mismatch_score"}, "itc_check": {"score": "gstr2a_3b_mismatch_score"}, "itr_check": {"score": "itr_revenue_mismatch_score"},
    "circular_composite": {"circular_score": "circular_trading_score"}, "benford": {"benford_score": "benford_deviation_score"},
    "litigation_score": {"cases": "litigation_count", "greatest(severity_score, risk)": "litigation_severity_score"}, "news_score": {"news_risk": "news_sentiment_score"},
    "notes_signals": {"collateral_coverage": "collateral_coverage_ratio", "capacity_utilization": "capacity_utilization", "customer_concentration": "customer_concentration"},
    "promoter_network_risk": {"promoter_network_risk": "promoter_network_risk"}, "sector_risk": {"sector_risk": "sector_risk_score"}, "audit_violations": {"violations": "regulatory_violation_count"},
}
_made = {f for columns in PARTS.values() for f in columns.values()}
_value = lambda c, d: r(f"coalesce({f'x.{c}, ' if c in vectors.TEXT_FIRST else ''}{f'{c}_, ' if c in _made else ''}{d}e0)", 6)
VECTOR = f"""(SELECT c.c_custkey AS company_id, {", ".join(f"{_value(c, d)} AS {c}" for c, d in vectors.DEFAULTS.items())} FROM customer c
  {" ".join(f"LEFT JOIN (SELECT company_id, {', '.join(f'{a} AS {b}_' for a, b in columns.items())} FROM ({ORACLE_SQL[q]})) q{i} ON q{i}.company_id = c.c_custkey" for i, (q, columns) in enumerate(PARTS.items()))}
  LEFT JOIN ({ORACLE_SQL["text_ratios"]}) x ON x.company_id = c.c_custkey)"""


@query(f"SELECT * FROM {VECTOR}")
@whole
def feature_vector(spark, d):
    parts = [QUERIES[q](spark, d).select("company_id", *[F.expr(a).alias(b) for a, b in columns.items()]) for q, columns in PARTS.items()]
    return vectors.feature_vector(frame(spark, d, "customer").select(F.col("c_custkey").alias("company_id")), parts, QUERIES["text_ratios"](spark, d))


_over = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} > 0 THEN {r(f'{a} / {b}', 4)} END"


@query(f"SELECT company_id, {r('revenue / 1e7', 4)} AS turnover_crore, {_over('ebitda', 'revenue')} AS ebitda_margin, {_over('pat', 'revenue')} AS pat_margin, {_over('total_debt', 'equity')} AS debt_to_equity, {_over('ebitda', 'interest')} AS interest_coverage FROM {FIN}")
def display_ratios(spark, d):
    return vectors.display_ratios(_fin(spark, d))


GOVERNED = {"layered_score": "layered_score", "shell_network_score": "shell_network_score", "audit_remark_score": "audit_score"}
_more = " ".join(f"LEFT JOIN (SELECT company_id, {c} FROM ({ORACLE_SQL[q]})) USING (company_id)" for q, c in GOVERNED.items())


@query(f"""SELECT company_id, governance_score, {r("100 - 100 * governance_score", 2)} AS character_score FROM (SELECT company_id, {r('''least(0.25e0 * least(litigation_severity_score, 1e0)
+ 0.1e0 * least(litigation_count / 10, 1e0) + 0.12e0 * least(benford_deviation_score, 1e0) + 0.08e0 * least(circular_trading_score, 1e0) + 0.03e0 * least(coalesce(layered_score, 0e0), 1e0) + 0.02e0 * least(coalesce(shell_score, 0e0), 1e0) + 0.03e0 * least(coalesce(shell_network_score, 0e0), 1e0)
+ 0.1e0 * least(coalesce(audit_score, 0e0), 1e0) + 0.08e0 * least(gst_bank_mismatch_score, 1e0)
+ 0.07e0 * least(gstr2a_3b_mismatch_score, 1e0) + 0.05e0 * least(itr_revenue_mismatch_score, 1e0) + 0.15e0 * least(regulatory_violation_count / 10, 1e0), 1e0)''', 4)} AS governance_score FROM ({F_SQL}) {_more} LEFT JOIN {SHELL_SCORE} USING (company_id))""")
@whole
def governance_score(spark, d):
    out = frame(spark, d, "features").join(graph.shell_score(QUERIES["shell_entities"](spark, d)), "company_id", "left")
    for q, c in GOVERNED.items():
        out = out.join(QUERIES[q](spark, d).select("company_id", c), "company_id", "left")
    return decision.governance_score(out)




# ---- fraud score ------------------------------------------------------------------------

#: Query, then its columns and the parts of the fraud score that they are; without a row a part is 0.
FRAUD_PARTS = {
    "circular_composite": {"circular_score": "circular"}, "benford": {"benford_score": "benford"}, "gst_bank_mismatch": {"score": "gst"},
    "itc_check": {"score": "gstr", "itc_to_turnover": "itc_ratio"}, "bank_anomaly": {"bank_anomaly": "bank"}, "audit_remark_score": {"audit_score": "audit"},
    "layered_score": {"layered_score": "layered"},
}
_joined = " ".join(f"LEFT JOIN (SELECT company_id, {', '.join(f'{a} AS {b}' for a, b in columns.items())} FROM ({ORACLE_SQL[q]})) USING (company_id)" for q, columns in FRAUD_PARTS.items())
_weighed = " + ".join(f"coalesce({c}, 0e0) * {w}e0" for c, w in graph.FRAUD_WEIGHTS.items())
FRAUD = f"""(SELECT company_id, {r("boosted * 100", 1)} AS fraud_score, coalesce(circular, 0e0) > 0.8 OR boosted > 0.85 AS hard_reject
FROM (SELECT *, CASE WHEN itc_ratio > 0.25 THEN least(b + 0.3e0, 1e0) ELSE b END AS boosted FROM (SELECT *, least({_weighed}, 1e0) AS b
  FROM (SELECT c_custkey AS company_id FROM customer) {_joined} LEFT JOIN (SELECT company_id, shell_score AS shell FROM {SHELL_SCORE}) USING (company_id))))"""


@query(f"SELECT * FROM {FRAUD}")
@whole
def fraud_composite(spark, d):
    out = frame(spark, d, "customer").select(F.col("c_custkey").alias("company_id"))
    for q, columns in FRAUD_PARTS.items():
        out = out.join(QUERIES[q](spark, d).select("company_id", *[F.col(a).alias(b) for a, b in columns.items()]), "company_id", "left")
    shell = graph.shell_score(QUERIES["shell_entities"](spark, d)).withColumnRenamed("shell_score", "shell")
    return graph.fraud_composite(out.join(shell, "company_id", "left"))


@query(f"SELECT company_id, fraud_score, CASE WHEN fraud_score <= 20 THEN 'LOW' WHEN fraud_score <= 40 THEN 'MODERATE' WHEN fraud_score <= 70 THEN 'HIGH' ELSE 'SEVERE' END AS band, {r('100 - fraud_score', 1)} AS integrity_score FROM {FRAUD}")
def fraud_bands(spark, d):
    return decision.fraud_bands(fraud_composite(spark, d))


# ---- model: no SQL, held-out metrics are tested ------------------------------------------

TREES, DEPTH = 300, 5
#: Models by application, files and trees: several queries read one, and changed files get another.
_MODELS: dict = {}


def _labelled(spark, d):
    f = frame(spark, d, "features")
    return f.join(decision.ml_labels(f), "company_id")


@query(" UNION ALL ".join(f"SELECT company_id, '{c}' AS feature, {r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()', 6)} AS value FROM ({F_SQL})" for c in NAMES))
def ml_prepare(spark, d):
    return model.ml_prepare(frame(spark, d, "features"), NAMES)


def _model(spark, d):
    files = spark.read.format("binaryFile").load(f"{d}/customer.parquet").selectExpr("path", "modificationTime", "length")
    key = (spark.sparkContext.applicationId, TREES, *sorted(map(tuple, files.collect())))  # a row a file
    if key not in _MODELS:
        seen, held = model.split(_labelled(spark, d))
        place = shared_place(spark)
        try:
            _MODELS[key] = model.train(write(spread(seen, "company_id"), place), NAMES, trees=TREES, depth=DEPTH), held
        finally:
            delete(spark, place)
    return _MODELS[key]


def ml_train_eval(spark, d):
    trained, held = _model(spark, d)
    return model.evaluate(trained, held)


def ml_score(spark, d):
    return model.ml_score(_model(spark, d)[0], spread(frame(spark, d, "features"), "company_id"))


def _trees(spark, d, trained):
    """The model's trees as a step, and how many there are."""
    return step(d, "trees", lambda: trees.tree_table(trained.stages[-1], f"{d.place}/model", spark)), len(trained.stages[-1].trees)


@whole
def feature_drivers(spark, d):
    """Contributions of each row's own path."""
    trained = _model(spark, d)[0]
    table, count = _trees(spark, d, trained)
    return trees.drivers(trees.steps(model.prepared(trained, spread(frame(spark, d, "features"), "company_id")), table, count, DEPTH), NAMES)


@query(f"""WITH s AS (SELECT -weighted_total AS score, label FROM {SCORECARD} JOIN ({ORACLE_SQL["ml_labels"]}) USING (company_id))
SELECT {r("(SELECT sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END) FROM s a JOIN s b ON a.label = 1 AND b.label = 0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))", 6)} AS auc,
count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM s""")
def score_auc(spark, d):
    """How well a low weighted total tells the default label."""
    scores = QUERIES["scorecard"](spark, d).join(QUERIES["ml_labels"](spark, d), "company_id")
    return model.rank_auc(scores.select((-F.col("weighted_total")).alias("score"), "label"))


QUERIES.update(ml_train_eval=ml_train_eval, ml_score=ml_score, feature_drivers=feature_drivers)

# ---- evidence, feeds, results -----------------------------------------------------------

SECTIONS = f"(SELECT DISTINCT doc_id, section FROM {CLASSIFIED})"
_fed = " UNION ALL ".join(f"SELECT company_id, 'doc:' || doc_id, 'feature:{c}', 'feeds' FROM {FILINGS} WHERE doc_type = '{t}'" for t, names in vectors.SOURCES.items() for c in names)
_rule = "'rule:' || lower(kind) || ':' || feature"


@query(f"""SELECT DISTINCT * FROM (SELECT company_id, 'doc:' || doc_id AS src, 'section:' || section AS dst, 'has_section' AS relation FROM {FILINGS} JOIN {SECTIONS} USING (doc_id) UNION ALL {_fed}
UNION ALL SELECT company_id, 'feature:' || feature, {_rule}, 'fires' FROM {FIRED} UNION ALL SELECT company_id, {_rule}, 'decision:' || verdict, 'leads_to' FROM {FIRED} JOIN {VERDICT} USING (company_id))""")
def evidence_edges(spark, d):
    docs = frame(spark, d, "filings")
    sections = filings.classify_sections(filings.segment_blocks(docs))
    fired = decision.fired_rules(frame(spark, d, "features"))
    return vectors.evidence_edges(docs, sections, fired, QUERIES["verdict"](spark, d).select("company_id", "verdict"))


_placed = "CASE " + " ".join(f"WHEN feature IN ({', '.join(map(repr, names))}) THEN '{k}'" for k, names in vectors.PLACES.items()) + " END"
_drivers = ("debt_to_equity", "interest_coverage_ratio", "sector_risk_score")
_listed = [(t, c) for t, names in vectors.SOURCES.items() for c in names]
_listed += [(None, c) for c in NAMES if c in _drivers and c not in {c for _, c in _listed}]
_kind = lambda t: f"'{t}'" if t else "CAST(NULL AS VARCHAR)"
_traced = " UNION ALL ".join(f"SELECT company_id, {_drivers.index(c) - 100 if c in _drivers else i} AS i, '{c}' AS feature, {_kind(t)} AS doc_type, {c} AS value FROM ({F_SQL})" for i, (t, c) in enumerate(_listed))


@query(f"""SELECT company_id, CAST(rank AS INT) AS rank, feature, coalesce(doc_type, 'Internal Computation') AS doc_type, coalesce(doc_id, -1) AS doc_id, file_name, CASE WHEN doc_type IS NULL THEN 'Derived' ELSE {_placed} END AS section, {r("value", 4)} AS value, fired, feature IN {_drivers} AS is_top_driver FROM (SELECT t.*, g.doc_id, g.file_name, h.feature IS NOT NULL AS fired, row_number() OVER (PARTITION BY t.company_id ORDER BY i) AS rank
FROM ({_traced}) t LEFT JOIN (SELECT company_id, doc_type, min(doc_id) AS doc_id, arg_min(file_name, doc_id) AS file_name FROM {FILINGS} GROUP BY 1, 2) g ON g.company_id = t.company_id AND g.doc_type = t.doc_type
LEFT JOIN (SELECT DISTINCT company_id, feature FROM {FIRED}) h ON h.company_id = t.company_id AND h.feature = t.feature) WHERE rank <= 20""")
def evidence_trace(spark, d):
    """Three features stand in for each company's drivers, so that SQL can tell them; run_trace has the model's."""
    f = frame(spark, d, "features")
    fixed = F.posexplode(F.array(*map(F.lit, _drivers))).alias("rank", "feature")
    traced = vectors.evidence_trace(f, frame(spark, d, "filings"), decision.fired_rules(f), f.select("company_id", fixed))
    return traced.fillna(-1, ["doc_id"])


@query(f"SELECT company_id, ordinal, url, title, snippet FROM ({s('articles')})")
def src_articles(spark, d):
    lines = frame(spark, d, "articles").select(F.to_json(F.struct("company_id", "ordinal", "url", "title", "snippet")).alias("value"))
    return feeds.parse_articles(lines).select("company_id", "ordinal", "url", "title", "snippet")


@query(f"SELECT company_id, verdict, credit_score, default_probability, hard_reject, reason, policy_score FROM {VERDICT} JOIN (SELECT company_id, reason, policy_score FROM ({ORACLE_SQL['rules_eval']})) USING (company_id)")
def sink_result(spark, d):
    """Written as a batch of nested rows, twice, and read back: the second run of a batch replaces the first."""
    joined = QUERIES["verdict"](spark, d).join(QUERIES["rules_eval"](spark, d).select("company_id", "reason", "policy_score"), "company_id")
    nested = joined.select("company_id", "verdict", feeds.result(decision=["credit_score", "default_probability"], rules=["hard_reject", "reason", "policy_score"]).alias("result"))
    place = shared_place(spark)
    for _ in range(2):
        feeds.write_results(nested, place, "current")
    return feeds.read_results(spark, place, "current").select("company_id", "verdict", "result.decision.*", "result.rules.*")


# ---- from transactions to the decision --------------------------------------------------

_real = lambda sql: f"WITH real AS MATERIALIZED (SELECT * FROM {VECTOR}) SELECT * FROM {sql.replace(F_SQL, 'SELECT * FROM real')}"


@query(_real(RULES))
@whole
def run_rules(spark, d):
    """Rules on the features that transactions, returns and documents give."""
    return decision.rules_eval(feature_vector(spark, d))


@query(_real(VERDICT))
@whole
def run_verdict(spark, d):
    """The verdict on these features, with the capacity score in the model's place, so that SQL can tell it."""
    f = feature_vector(spark, d)
    scores = decision.five_cs(f).select("company_id", F.col("capacity").alias("ml_score"))
    return credit.verdicts(f, scores)


def run_decision(spark, d):
    """One run from transactions to the sink: features, model score, rules, verdict, grade, conditions, loan and drivers."""
    with run(spark, d) as stages:
        place = shared_place(spark, of_run=False)
        feeds.write_results(_decided(spark, stages).decisions(), place, "current")
        return feeds.read_results(spark, place, "current")


@whole
def run_trace(spark, d):
    """The evidence of that run: the model's drivers of each company first."""
    return _decided(spark, d).trace(frame(spark, d, "filings"))


def _decided(spark, d):
    trained = _model(spark, d)[0]
    table, count = _trees(spark, d, trained)
    features = step(d, "run_features", lambda: spread(feature_vector(spark, d), "company_id"))
    return credit.Decisions(features, trained, table, count, DEPTH, NAMES, frame(spark, d, "turnover"), lambda name, build: step(d, name, build))


QUERIES.update(run_decision=run_decision, run_trace=run_trace)
