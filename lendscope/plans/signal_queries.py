"""Registered queries of research and of signals, with the same results told in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendscope.functions.lexicon import read_lexicon
from lendscope.functions.rounding import half_up_sql as r
from lendscope.operators import documents, research, signals
from lendscope.plans.inputs import frame
from lendscope.plans.inputs import sql as s
from lendscope.plans.queries import ARTICLES, CASES, F_SQL, HITS, KEPT, ORACLE_SQL, QUERIES, VALUES, query
from lendscope.stages import spread

SEEN = lambda c, words: "(" + " + ".join(f"max(CAST(contains({c}, '{w}') AS INT))" for w in words) + ")"
OWN = lambda k, words: "(" + " + ".join(f"max(CAST(category = '{k}' AND contains(low, '{w}') AS INT))" for w in words) + ")"


def _trend(scope: str) -> str:
    down, up = SEEN("low", research.DOWNGRADE), SEEN("low", research.UPGRADE)
    return f"(SELECT {scope}, CASE WHEN {down} > {up} THEN 'DETERIORATING' WHEN {up} > {down} THEN 'IMPROVING' ELSE 'STABLE' END AS trend FROM (SELECT {scope}, lower(text) AS low FROM ({s('ratings')})) GROUP BY 1)"


@query(f"SELECT 'company' AS scope, company_id AS id, trend FROM {_trend('company_id')} UNION ALL SELECT 'sector', sector, trend FROM {_trend('sector')}")
def rating_trend(spark, d):
    t = frame(spark, d, "ratings")
    part = lambda name, c: research.rating_trend(t, c).select(F.lit(name).alias("scope"), F.col(c).alias("id"), "trend")
    return part("company", "company_id").unionByName(part("sector", "sector"))


@query(f"""SELECT company_id, rating, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY doc_id, place) AS rank FROM (
SELECT company_id, rating, doc_id, place FROM (SELECT company_id, doc_id, unnest(x) AS rating, unnest(range(len(x))) AS place FROM (SELECT company_id, doc_id, regexp_extract_all(text, '{research.RATING}', 1) AS x FROM ({s("ratings")})))
QUALIFY row_number() OVER (PARTITION BY company_id, rating ORDER BY doc_id, place) = 1)) WHERE rank <= 5""")
def rating_mentions(spark, d):
    return research.rating_mentions(frame(spark, d, "ratings"))


MACRO = f"""(SELECT sector, CASE WHEN h > v THEN 'HAWKISH' WHEN v > h THEN 'DOVISH' ELSE 'NEUTRAL' END AS rate_environment, CASE WHEN u > w THEN 'ACCELERATING' WHEN w > u THEN 'DECELERATING' ELSE 'STEADY' END AS growth_signal,
  {r("0.45e0 + CASE WHEN h > v THEN 0.1e0 WHEN v > h THEN -0.05e0 ELSE 0e0 END + CASE WHEN w > u THEN 0.1e0 WHEN u > w THEN -0.05e0 ELSE 0e0 END + CASE WHEN b > 0 THEN 0.08e0 ELSE 0e0 END + CASE WHEN g > 0 THEN 0.07e0 ELSE 0e0 END", 4)} AS macro_risk
  FROM (SELECT sector, {OWN("rates", research.HAWKISH)} AS h, {OWN("rates", research.DOVISH)} AS v, {OWN("growth", research.RISING)} AS u, {OWN("growth", research.FALLING)} AS w,
  {OWN("banking", research.BANK_STRESS)} AS b, {OWN("global", research.GLOBAL_RISK)} AS g FROM (SELECT sector, category, lower(text) AS low FROM ({s("macro_items")})) GROUP BY 1))"""


@query(f"SELECT * FROM {MACRO}")
def macro_score(spark, d):
    return research.macro_score(frame(spark, d, "macro_items"), "sector")


_sectors = [(name, risk, i, phrase) for i, (name, risk, phrase) in enumerate(read_lexicon("sectors"))]
DETECTED = f"""(SELECT company_id, coalesce(arg_max(sector, (n, -o)), 'default') AS sector, coalesce(max(n), 0) AS hits
  FROM (SELECT DISTINCT company_id FROM ({s("reports")})) LEFT JOIN (SELECT company_id, sector, count(DISTINCT phrase) AS n, min(o) AS o
    FROM (SELECT company_id, lower(text) AS low FROM ({s("reports")})) JOIN {VALUES([(a, o, p) for a, _, o, p in _sectors])} l(sector, o, phrase) ON contains(low, phrase) GROUP BY 1, 2) USING (company_id) GROUP BY 1)"""


@query(f"SELECT * FROM {DETECTED}")
def sector_detect(spark, d):
    return research.sector_detect(spread(frame(spark, d, "reports"), "doc_id"))


_base = "CASE sector " + " ".join(f"WHEN '{n}' THEN {x}e0" for n, x in {n: x for n, x, *_ in _sectors}.items()) + " ELSE 0.5e0 END"


@query(f"""SELECT company_id, sector, CASE WHEN risk > 0.6 THEN 'NEGATIVE' WHEN risk < 0.4 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS outlook, {r("least(risk + least(0.05e0 * coalesce(mentions, 0), 0.15e0), 1e0)", 4)} AS sector_risk
FROM (SELECT company_id, sector, mentions, {r(f"least(greatest({_base} + coalesce(move, 0e0), 0e0), 1e0)", 4)} AS risk FROM {DETECTED}
LEFT JOIN (SELECT company_id, CAST(count(*) FILTER (sentiment = 'NEGATIVE') - count(*) FILTER (sentiment = 'POSITIVE') AS DOUBLE) / count(*) * 0.1e0 AS move FROM {KEPT} GROUP BY 1) USING (company_id)
LEFT JOIN (SELECT company_id, count(*) AS mentions FROM ({s("articles")}) WHERE contains(lower(title), 'notice') GROUP BY 1) USING (company_id))""")
def sector_risk(spark, d):
    mentions = frame(spark, d, "articles").where("contains(lower(title), 'notice')").groupBy("company_id").agg(F.count(F.lit(1)).alias("mentions"))
    return research.sector_risk(sector_detect(spark, d), QUERIES["news_dedup_topk"](spark, d), mentions)


_side = lambda k, words: f"SELECT company_id, '{k}' AS side, title, min(ordinal) AS ordinal FROM ({s('articles')}) WHERE title <> '' AND {HITS("lower(title || ' ' || snippet)", words)} > 0 GROUP BY 1, 2, 3"


_good = f"SELECT company_id, 'positive' AS side, title, min(ordinal) AS ordinal FROM {ARTICLES} WHERE title <> '' AND sentiment = 'POSITIVE' GROUP BY 1, 2, 3"


@query(f"SELECT company_id, side, title, ordinal, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, side ORDER BY ordinal) AS rank FROM ({_side('headwind', research.HEADWIND)} UNION ALL {_side('tailwind', research.TAILWIND)} UNION ALL {_good})) WHERE rank <= CASE side WHEN 'positive' THEN 3 ELSE 5 END")
def head_tailwinds(spark, d):
    return research.head_tailwinds(research.sentiment(frame(spark, d, "articles")))


@query(f"SELECT address, count(DISTINCT company_id) AS companies FROM (SELECT company_id, trim(regexp_replace(upper(address), '[^A-Z0-9]+', ' ', 'g')) AS address FROM ({s('addresses')})) WHERE address <> '' GROUP BY 1 HAVING count(DISTINCT company_id) >= 2")
def shared_address(spark, d):
    return research.shared_address(frame(spark, d, "addresses"))


PROMOTER_GRAPH = f"""(SELECT DISTINCT company_id, name AS promoter, target, relation FROM ({s("promoters")}) JOIN (
  SELECT company_id, director AS target, 'is_director' AS relation FROM ({s("directors")}) UNION ALL
  SELECT company_id, 'case:' || ordinal, 'involved_in' FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ordinal) AS n FROM {CASES} WHERE feed = 1) WHERE n <= 40 UNION ALL
  SELECT company_id, lender, 'borrowed_from' FROM ({s("lenders")})) USING (company_id))"""


@query(f"SELECT * FROM {PROMOTER_GRAPH}")
def promoter_graph(spark, d):
    cases = QUERIES["cases_union"](spark, d).where("feed = 1").select("company_id", F.col("ordinal").alias("case_id"))
    return research.promoter_graph(frame(spark, d, "promoters"), frame(spark, d, "directors"), cases, frame(spark, d, "lenders"))


@query(f"SELECT company_id, relation, node, degree, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, relation ORDER BY degree DESC, node) AS rank FROM (SELECT company_id, relation, target AS node, count(*) AS degree FROM {PROMOTER_GRAPH} WHERE relation <> 'is_director' GROUP BY 1, 2, 3)) WHERE rank <= 5")
def central_nodes(spark, d):
    return research.central_nodes(promoter_graph(spark, d))


_parts = s("risk_parts")


@query(f"""SELECT company_id, promoter_risk, promoter_risk > 0.7 AS flagged FROM (SELECT company_id, {r('''least(least(least(0.5e0 * severity_score, 0.4e0) + least(0.1e0 * high, 0.3e0)
+ CASE WHEN disqualified THEN 0.3e0 ELSE 0e0 END + CASE WHEN nodes > 20 THEN 0.1e0 ELSE 0e0 END, 1e0) + 0.3e0 * shell_network_score, 1e0)''', 4)} AS promoter_risk FROM ({_parts}))""")
def promoter_risk(spark, d):
    return research.promoter_risk(frame(spark, d, "risk_parts"))


_shell = ORACLE_SQL["shell_network_score"]


@query(f"SELECT company_id, {r('least(promoter_risk + 0.2e0 * coalesce(shell_network_score, 0e0), 1e0)', 4)} AS promoter_network_risk FROM ({ORACLE_SQL['promoter_risk']}) LEFT JOIN ({_shell}) USING (company_id)")
def promoter_network_risk(spark, d):
    return research.promoter_network_risk(promoter_risk(spark, d), QUERIES["shell_network_score"](spark, d))


@query(f"SELECT company_id, {r('''0.25e0 * news_risk + 0.35e0 * litigation_risk + 0.2e0 * sector_risk + 0.1e0 * macro_risk + 0.1e0 * CASE WHEN rating_trend = 'DETERIORATING' THEN 0.1e0 ELSE 0e0 END''', 4)} AS research_risk FROM ({_parts})")
def research_risk(spark, d):
    return research.research_risk(frame(spark, d, "risk_parts"))


# ---- signals ----------------------------------------------------------------------------

PROMOTER_NEWS = f"""(SELECT company_id, count(*) AS promoter_news FROM {KEPT} k WHERE sentiment = 'NEGATIVE' AND EXISTS (
  SELECT 1 FROM ({s("promoters")}) p WHERE p.company_id = k.company_id AND contains(lower(k.title), lower(split_part(p.name, ' ', 1)))) GROUP BY 1)"""
EXTERNAL = f"(SELECT company_id, count(*) AS cases FROM {CASES} WHERE feed = 1 GROUP BY 1)"
_legal = "|".join(p for k, p in documents.RED_FLAGS.items() if k.startswith("LEGAL"))
DISCLOSED = f"(SELECT DISTINCT company_id FROM ({s('reports')}) WHERE doc_id % 4 = 0 AND regexp_matches(lower(text), '{_legal}'))"


def _kept(spark, d):
    return research.news_dedup_topk(research.sentiment(frame(spark, d, "articles")))


@query(f"SELECT * FROM {PROMOTER_NEWS}")
def promoter_news(spark, d):
    return signals.promoter_news(_kept(spark, d), frame(spark, d, "promoters"))


def _external(spark, d):
    return QUERIES["cases_union"](spark, d).where("feed = 1").groupBy("company_id").agg(F.count(F.lit(1)).alias("cases"))


def _disclosed(spark, d):
    """Companies whose filed documents (every fourth) hold a legal red flag."""
    filed = frame(spark, d, "reports").where("doc_id % 4 = 0")
    flagged = documents.red_flags(filed).where(F.col("flags").contains("LEGAL:")).select("doc_id")
    return filed.join(flagged, "doc_id", "left_semi").select("company_id").distinct()


@query(f"SELECT * FROM {EXTERNAL} WHERE cases > 2 AND company_id NOT IN (SELECT company_id FROM {DISCLOSED})")
def disclosure_gap(spark, d):
    return signals.disclosure_gap(_external(spark, d), _disclosed(spark, d))


@query(" UNION ALL ".join(f"SELECT company_id, '{side}' AS side, '{point}' AS point FROM ({F_SQL}) WHERE {t}" for side, point, t in signals.SWOT))
def swot(spark, d):
    return signals.swot(frame(spark, d, "features"))


FACTS = f"""(SELECT f.*, coalesce(n.negative_news, 0) AS negative_news, coalesce(e.cases, 0) AS external_cases, coalesce(p.promoter_news, 0) AS promoter_news, g.company_id IS NOT NULL AS disclosed
  FROM ({F_SQL}) f LEFT JOIN (SELECT company_id, count(*) FILTER (sentiment = 'NEGATIVE') AS negative_news FROM {KEPT} GROUP BY 1) n USING (company_id)
  LEFT JOIN {EXTERNAL} e USING (company_id) LEFT JOIN {PROMOTER_NEWS} p USING (company_id) LEFT JOIN {DISCLOSED} g USING (company_id))"""


def _facts(spark, d):
    news = _kept(spark, d).groupBy("company_id").agg(F.count_if(F.col("sentiment") == "NEGATIVE").alias("negative_news"))
    out = frame(spark, d, "features").join(news, "company_id", "left").join(_external(spark, d).withColumnRenamed("cases", "external_cases"), "company_id", "left")
    out = out.join(promoter_news(spark, d), "company_id", "left").join(_disclosed(spark, d).withColumn("disclosed", F.lit(True)), "company_id", "left")
    return out.fillna(0, ["negative_news", "external_cases", "promoter_news"]).fillna(False, ["disclosed"])


_first = lambda choices, i: "CASE " + " ".join(f"WHEN {c[-1]} THEN '{c[i]}'" for c in choices) + " END"
TRIANGULATION = "(" + " UNION ALL ".join(f"SELECT * FROM (SELECT company_id, '{k}' AS \"check\", {_first(c, 0)} AS kind, {_first(c, 1)} AS severity FROM facts) WHERE kind IS NOT NULL" for k, c in signals.TRIANGULATION.items()) + ")"
TRIANGULATED = f"""(SELECT *, {r("least(0.15e0 * corroborated + 0.1e0 * discrepancies, 0.9e0)", 4)} AS triangulation_risk FROM (SELECT company_id, count(*) FILTER (kind = 'CORROBORATED') AS corroborated,
  count(*) FILTER (kind = 'DISCREPANCY') AS discrepancies, count(*) FILTER (kind = 'UNVERIFIED') AS unverified FROM {TRIANGULATION} GROUP BY 1))"""
_with = f"WITH facts AS {FACTS} "


@query(f"{_with} SELECT * FROM {TRIANGULATION}")
def triangulation(spark, d):
    return signals.triangulation(_facts(spark, d))


@query(f"{_with} SELECT * FROM {TRIANGULATED}")
def triangulation_risk(spark, d):
    return signals.triangulation_risk(triangulation(spark, d))


_EARLY = f"""{_with}, more AS (SELECT f.*, coalesce(t.corroborated, 0) AS corroborated, coalesce(t.discrepancies, 0) AS discrepancies, m.macro_risk, coalesce(a.trend, 'STABLE') AS rating_trend, b.trend AS sector_trend
FROM facts f LEFT JOIN {TRIANGULATED} t USING (company_id) LEFT JOIN {MACRO} m ON m.sector = f.company_id % 5 LEFT JOIN {_trend("company_id")} a USING (company_id) LEFT JOIN {_trend("sector")} b ON b.sector = f.company_id % 5) """
WARNED = "(" + " UNION ALL ".join(f"SELECT * FROM (SELECT company_id, '{k}' AS category, {_first(c, 0)} AS severity FROM more) WHERE severity IS NOT NULL" for k, c in signals.WARNINGS.items()) + ")"


@query(f"{_EARLY} SELECT * FROM {WARNED}")
def early_warning(spark, d):
    facts, ratings = _facts(spark, d), frame(spark, d, "ratings")
    out = facts.join(signals.triangulation_risk(signals.triangulation(facts)), "company_id", "left").fillna(0, ["corroborated", "discrepancies"]).withColumn("sector", F.col("company_id") % 5)
    out = out.join(research.macro_score(frame(spark, d, "macro_items"), "sector"), "sector", "left")
    out = out.join(research.rating_trend(ratings, "company_id").withColumnRenamed("trend", "rating_trend"), "company_id", "left").fillna("STABLE", ["rating_trend"])
    return signals.early_warning(out.join(research.rating_trend(ratings, "sector").withColumnRenamed("trend", "sector_trend"), "sector", "left"))


@query(f"{_EARLY} SELECT *, {r('least(0.25e0 * critical + 0.12e0 * high + 0.05e0 * medium, 1e0)', 4)} AS early_warning_score FROM (SELECT company_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium FROM {WARNED} GROUP BY 1)")
def early_warning_score(spark, d):
    return signals.early_warning_score(early_warning(spark, d))
