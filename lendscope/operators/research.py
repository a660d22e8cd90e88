"""News, cases, directors: aggregations over articles and registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.lexicon import bound, hits, read_lexicon
from lendscope.functions.rounding import half_up

#: Words of good and bad news.
POSITIVE = ["revenue", "profit", "growth", "expansion", "award", "win", "export", "strong", "record", "dividend", "orders", "contract", "upgrade", "increase", "surplus", "positive", "improvement", "success", "milestone", "approved"]
NEGATIVE = ["fraud", "default", "npa", "lawsuit", "penalty", "raid", "loss", "closure", "insolvency", "nclt", "ed", "cbi", "investigation", "arrest", "cheque bounce", "winding up", "bankrupt", "shutdown", "fir", "complaint", "wilful defaulter", "sebi", "drt", "drat", "pmla", "money laundering", "fake", "bogus", "overdue", "interest rate hike", "decline", "downgrade", "restructuring"]
#: Words that tell of a case.
LITIGATION = ["npa", "default", "nclt", "insolvency", "drt", "recovery", "fraud", "cheque bounce", "section 138", "wilful defaulter", "ed raid", "cbi", "sebi", "attachment order", "winding up"]
#: Words that tell a case's severity, the gravest first, with its weight.
SEVERITY = {
    "CRITICAL": (["wilful defaulter", "fraud classification", "pmla", "enforcement directorate", "cbi", "insolvency", "ibc"], 1.0),
    "HIGH": (["nclt", "drt", "drat", "winding up", "recovery suit", "criminal complaint", "fir"], 0.75),
    "MEDIUM": (["cheque bounce", "section 138", "civil suit", "arbitration", "claim"], 0.4),
    "LOW": (["consumer forum", "labour dispute", "minor claim"], 0.15),
}


def sentiment(articles: DataFrame, whole_words: bool = False) -> DataFrame:
    """articles with sentiment, from the words in title and snippet (anywhere, or as whole words), and
    has_litigation_signal: whether any word of a case is in them."""
    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    count = (lambda words: sum((low.rlike(rf"\b{w}\b").cast("int") for w in words), F.lit(0))) if whole_words else (lambda words: hits(low, words))
    bad, good = count(NEGATIVE), count(POSITIVE)
    told = F.when(bad > good, "NEGATIVE").when(good > bad, "POSITIVE").otherwise("NEUTRAL")
    return articles.withColumns({"sentiment": told, "has_litigation_signal": hits(low, LITIGATION) > 0})


#: Letters, No and a number with a year.
CASE_NUMBER = r"[A-Z]+ *No\.? *[0-9]+[/-][0-9]{4}"


def legal_cases(docs: DataFrame) -> DataFrame:
    """A feed of cases_union: one case a legal document. docs: company_id, doc_id, doc_type, text. The summary names the
    document and its first three case numbers."""
    numbers = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(CASE_NUMBER), F.lit(0)), 1, 3), ", ")
    summary = F.concat(F.lit("Legal document "), F.col("doc_id"), F.lit(": "), F.coalesce(F.nullif(numbers, F.lit("")), F.lit("case reference found")))
    return docs.where("doc_type = 'legal'").select("company_id", F.col("doc_id").alias("ordinal"), summary.alias("summary"), "text", F.col("doc_id").cast("string").alias("document"))


def news_cases(articles: DataFrame) -> DataFrame:
    """A feed of cases_union: articles (of sentiment()) with a litigation signal; their snippet tells the severity."""
    return articles.where("has_litigation_signal").select("company_id", "ordinal", F.coalesce("title", F.lit("")).alias("summary"), F.col("snippet").alias("text"))


def news_dedup_topk(articles: DataFrame, k: int = 20) -> DataFrame:
    """First article of each url of a company (empty urls go), bad news first, then longer snippets; k stay."""
    once = articles.where("url <> ''").groupBy("company_id", "url").agg(F.min_by(F.struct("ordinal", "title", "snippet", "sentiment"), "ordinal").alias("a"))
    rows = once.select("company_id", "url", "a.*")
    order = Window.partitionBy("company_id").orderBy((F.col("sentiment") == "NEGATIVE").desc(), F.length("snippet").desc(), "ordinal")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def news_score(kept: DataFrame) -> DataFrame:
    good, bad = F.count_if(F.col("sentiment") == "POSITIVE"), F.count_if(F.col("sentiment") == "NEGATIVE")
    raw = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (good - 1.5 * bad) / F.count(F.lit(1))))
    return kept.groupBy("company_id").agg(half_up((1 - raw) / 2, 4).alias("news_risk"), F.count(F.lit(1)).alias("articles"))


def case_severity(text: Column) -> Column:
    low, out = F.lower(text), F.lit("LOW")
    for name, (words, _) in reversed(list(SEVERITY.items())):
        out = F.when(hits(low, words) > 0, name).otherwise(out)
    return out


def cases_union(*feeds: DataFrame) -> DataFrame:
    """feeds: company_id, ordinal, summary; in order of preference. First of each 60-character summary.

    A feed may also have text, the whole text that severity is told from in place of the summary, and
    document, a name: cases of different documents stay apart."""
    rows = None
    for i, feed in enumerate(feeds):
        text = F.coalesce("text", "summary") if "text" in feed.columns else F.col("summary")
        document = F.col("document").cast("string") if "document" in feed.columns else F.lit(None).cast("string")
        own = feed.select("company_id", F.lit(i).alias("feed"), "ordinal", "summary", case_severity(text).alias("severity"), document.alias("document"))
        rows = own if rows is None else rows.unionByName(own)
    order = Window.partitionBy("company_id", F.substring("summary", 1, 60), "document").orderBy("feed", "ordinal")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "document")


def litigation_score(cases: DataFrame) -> DataFrame:
    weight = F.lit(0.0)
    for name, (_, w) in SEVERITY.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    out = cases.groupBy("company_id").agg(F.sum(weight.cast("decimal(10,2)")).cast("double").alias("weight"), F.count(F.lit(1)).alias("cases"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("high"))
    flags = F.concat_ws(",", F.when(F.col("high") > 0, F.lit("SIGNIFICANT_LITIGATION")), F.when(F.col("cases") > 15, F.lit("LITIGATION_COUNT_HIGH")))
    return out.select("company_id", "cases", "high", half_up(F.least(F.col("weight") / 5, F.lit(1.0)), 4).alias("severity_score"), half_up(F.least(F.col("cases") / 20, F.lit(1.0)), 4).alias("risk"), flags.alias("flags"))


def multi_company_directors(directors: DataFrame, least: int = 3) -> DataFrame:
    """directors: director, company_id. Directors with that many companies or more, and these."""
    ids = F.array_sort(F.collect_set("company_id"))
    out = directors.groupBy("director").agg(F.size(ids).cast("long").alias("companies"), ids.alias("company_ids"))
    return out.where(F.col("companies") >= least)


def shell_network_score(directors: DataFrame, flagged: DataFrame) -> DataFrame:
    """min(0.2 n, 0.6) for each company with n flagged directors."""
    hit = directors.distinct().join(flagged.select("director"), "director", "left_semi")
    return hit.groupBy("company_id").agg(half_up(F.least(0.2 * F.count(F.lit(1)), F.lit(0.6)), 2).alias("shell_network_score"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """edges: a, b. degree / (n - 1) of each node."""
    ends = edges.distinct().select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    others = ends.agg((F.countDistinct("node") - 1).alias("n")).scalar()
    return degree.select("node", "degree", half_up(F.col("degree") / F.greatest(others, F.lit(1)).cast("double"), 6).alias("centrality"))


def central_nodes(edges: DataFrame, k: int = 5) -> DataFrame:
    """edges of promoter_graph. The k case and lender nodes of a company with most edges."""
    few = edges.where("relation <> 'is_director'").groupBy("company_id", "relation", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    order = Window.partitionBy("company_id", "relation").orderBy(F.desc("degree"), "node")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Words of falling and rising ratings.
DOWNGRADE = ["downgrade", "lower", "negative outlook", "watch negative", "default", "withdrawn", "suspend", "junk", "speculative grade", "below investment grade", "credit watch", "review for downgrade", "npa"]
UPGRADE = ["upgrade", "improve", "positive outlook", "watch positive", "affirm", "raise", "investment grade", "outlook stable", "outlook positive", "removed from watch", "reaffirm"]
#: A symbol, alone or after an agency, that no letter, digit or sign follows.
RATING = r"\b((?:IND|CRISIL|ICRA|CARE) [A-D][+-]?|AAA|AA[+-]?|A[+-]?|BBB[+-]?|BB[+-]?|B[+-]?|CCC|CC|C|D)(?:[^A-Za-z0-9+-]|$)"
#: Words of the macro categories.
HAWKISH = ["hike", "tighten", "restrictive", "inflation", "elevated", "caution", "withdraw", "liquidity absorption"]
DOVISH = ["cut", "ease", "accommodative", "pause", "stable", "lower", "reduce", "support", "surplus liquidity"]
RISING = ["growth", "recovery", "expansion", "strong", "acceleration", "surplus", "gdp beat", "record", "buoyant"]
FALLING = ["slowdown", "contraction", "recession", "downside", "weak", "stress", "crisis", "decline", "stagflation", "pressure"]
BANK_STRESS = ["npa rise", "stress", "defaults climb"]
GLOBAL_RISK = ["recession", "war", "sanction", "slowdown"]
#: Words against and for a sector.
HEADWIND = ["risk", "challenge", "decline", "slowdown", "pressure", "penalty", "ban", "crisis"]
TAILWIND = ["growth", "demand", "expansion", "boost", "positive", "recovery", "export"]
DEFAULT_SECTOR_RISK = 0.50


def _seen(words: list[str]) -> Column:
    """How many of the words occur anywhere in a group's texts (column low), without joining the texts."""
    return sum((F.max(F.col("low").contains(w).cast("int")) for w in words), F.lit(0))


def _trend(down: Column, up: Column) -> Column:
    return F.when(down > up, "DETERIORATING").when(up > down, "IMPROVING").otherwise("STABLE")


def rating_trend(texts: DataFrame, scope: str) -> DataFrame:
    """texts: the scope's column, text. Falling words against rising words over all texts of the scope."""
    return texts.select(scope, F.lower("text").alias("low")).groupBy(scope).agg(_trend(_seen(DOWNGRADE), _seen(UPGRADE)).alias("trend"))


def rating_mentions(texts: DataFrame, k: int = 5) -> DataFrame:
    """texts: company_id, doc_id, text. The first k distinct rating symbols of a company, as written."""
    found = texts.select("company_id", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(RATING), F.lit(1))).alias("place", "rating"))
    once = found.groupBy("company_id", "rating").agg(F.min(F.struct("doc_id", "place")).alias("seen"))
    order = Window.partitionBy("company_id").orderBy("seen")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("company_id", "rating", "rank")


def macro_score(items: DataFrame, scope: str) -> DataFrame:
    """items: the scope's column, category (rates, growth, banking, global), text."""
    low = items.select(scope, "category", F.lower("text").alias("t"))
    own = lambda c, words: sum((F.max(((F.col("category") == c) & F.col("t").contains(w)).cast("int")) for w in words), F.lit(0))
    seen = low.groupBy(scope).agg(
        own("rates", HAWKISH).alias("hawkish"), own("rates", DOVISH).alias("dovish"), own("growth", RISING).alias("rising"), own("growth", FALLING).alias("falling"),
        own("banking", BANK_STRESS).alias("stress"), own("global", GLOBAL_RISK).alias("world"),
    )
    side = lambda a, b: F.when(F.col(a) > F.col(b), 0.10).when(F.col(b) > F.col(a), -0.05).otherwise(0.0)
    risk = 0.45 + side("hawkish", "dovish") + side("falling", "rising") + F.when(F.col("stress") > 0, 0.08).otherwise(0.0) + F.when(F.col("world") > 0, 0.07).otherwise(0.0)
    name = lambda a, b, x, y, z: F.when(F.col(a) > F.col(b), x).when(F.col(b) > F.col(a), y).otherwise(z)
    return seen.select(
        scope, name("hawkish", "dovish", "HAWKISH", "DOVISH", "NEUTRAL").alias("rate_environment"), name("rising", "falling", "ACCELERATING", "DECELERATING", "STEADY").alias("growth_signal"),
        half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), 4).alias("macro_risk"),
    )


def sector_detect(docs: DataFrame, lexicon: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The sector with most phrases over a company's texts, the first declared on a tie; default without any. lexicon:
    sector, its base risk, phrase; by default that of the library, of 16 sectors. A text leaves its task as the phrases that it holds."""
    rows = lexicon or read_lexicon("sectors")
    order = {s: i for i, s in enumerate(dict.fromkeys(s for s, *_ in rows))}
    phrases = F.array(*[F.struct(F.lit(order[s]).alias("o"), F.lit(s).alias("sector"), F.lit(p).alias("phrase")) for s, _, p in rows])
    held = bound(F.lower(F.coalesce("text", F.lit(""))), lambda low: F.filter(phrases, lambda x: F.contains(low, x["phrase"])))
    seen = docs.select("company_id", F.explode_outer(held).alias("of")).distinct()
    counts = seen.groupBy("company_id", F.col("of.o").alias("o"), F.col("of.sector").alias("sector")).agg(F.count("of.phrase").alias("hits"))
    best = counts.groupBy("company_id").agg(F.max(F.struct("hits", (-F.col("o")).alias("first"), "sector")).alias("b"))
    return best.select("company_id", F.coalesce("b.sector", F.lit("default")).alias("sector"), F.col("b.hits").alias("hits"))


def sector_risk(detected: DataFrame, kept: DataFrame, regulatory: DataFrame, lexicon: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Base risk, moved by the balance of kept news and by regulatory mentions (company_id, mentions). lexicon: as in
    sector_detect."""
    base = {s: float(risk) for s, risk, _ in lexicon or read_lexicon("sectors")}
    known = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    bad, good = F.count_if(F.col("sentiment") == "NEGATIVE"), F.count_if(F.col("sentiment") == "POSITIVE")
    news = kept.groupBy("company_id").agg(((bad - good) / F.count(F.lit(1)) * 0.10).alias("move"))
    joined = detected.join(news, "company_id", "left").join(regulatory, "company_id", "left")
    risk = F.coalesce(F.try_element_at(known, F.col("sector")), F.lit(DEFAULT_SECTOR_RISK)) + F.coalesce("move", F.lit(0.0))
    out = joined.select(
        "company_id", "sector", half_up(F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)), 4).alias("risk"), F.least(0.05 * F.coalesce("mentions", F.lit(0)), F.lit(0.15)).alias("extra")
    )
    outlook = F.when(F.col("risk") > 0.60, "NEGATIVE").when(F.col("risk") < 0.40, "POSITIVE").otherwise("NEUTRAL")
    return out.select("company_id", "sector", outlook.alias("outlook"), half_up(F.least(F.col("risk") + F.col("extra"), F.lit(1.0)), 4).alias("sector_risk"))


def head_tailwinds(articles: DataFrame, k: int = 5, good: int = 3) -> DataFrame:
    """The first k distinct titles of a company whose title or body tells of a headwind, and of a tailwind, and the first
    good ones of positive articles. articles: of sentiment()."""
    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    sides = F.filter(F.array(F.when(hits(low, HEADWIND) > 0, F.lit("headwind")), F.when(hits(low, TAILWIND) > 0, F.lit("tailwind")), F.when(F.col("sentiment") == "POSITIVE", F.lit("positive"))), lambda x: x.isNotNull())
    once = articles.where("title <> ''").select("company_id", "ordinal", "title", F.explode(sides).alias("side")).groupBy("company_id", "side", "title").agg(F.min("ordinal").alias("ordinal"))
    order = Window.partitionBy("company_id", "side").orderBy("ordinal")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.when(F.col("side") == "positive", good).otherwise(k))


def shared_address(addresses: DataFrame, least: int = 2) -> DataFrame:
    """addresses: company_id, address. Addresses, in upper case with single blanks, of that many companies or more."""
    norm = F.trim(F.regexp_replace(F.upper("address"), "[^A-Z0-9]+", " "))
    return addresses.select("company_id", norm.alias("address")).where("address <> ''").groupBy("address").agg(F.countDistinct("company_id").alias("companies")).where(F.col("companies") >= least)


def promoter_graph(promoters: DataFrame, directors: DataFrame, cases: DataFrame, lenders: DataFrame, most_cases: int = 40) -> DataFrame:
    """Edges from a company's promoters (bounded, see promoters) to its directors, first cases and lenders."""
    order = Window.partitionBy("company_id").orderBy("case_id")
    few = cases.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_cases)
    ends = (
        directors.select("company_id", F.col("director").alias("target"), F.lit("is_director").alias("relation"))
        .unionByName(few.select("company_id", F.concat(F.lit("case:"), F.col("case_id")).alias("target"), F.lit("involved_in").alias("relation")))
        .unionByName(lenders.select("company_id", F.col("lender").alias("target"), F.lit("borrowed_from").alias("relation")))
    )
    return promoters.select("company_id", F.col("name").alias("promoter")).join(ends, "company_id").distinct()


def promoter_risk(f: DataFrame) -> DataFrame:
    """f: company_id, severity_score, high, disqualified, nodes, shell_network_score."""
    score = F.least(0.5 * F.col("severity_score"), F.lit(0.40)) + F.least(0.10 * F.col("high"), F.lit(0.30)) + F.when(F.col("disqualified"), 0.30).otherwise(0.0) + F.when(F.col("nodes") > 20, 0.10).otherwise(0.0)
    risk = half_up(F.least(F.least(score, F.lit(1.0)) + 0.30 * F.col("shell_network_score"), F.lit(1.0)), 4)
    return f.select("company_id", risk.alias("promoter_risk")).withColumn("flagged", F.col("promoter_risk") > 0.7)


def promoter_network_risk(risk: DataFrame, shell: DataFrame) -> DataFrame:
    """Promoter risk with a fifth of the shell network score, 1 at most."""
    both = F.col("promoter_risk") + 0.20 * F.coalesce("shell_network_score", F.lit(0.0))
    return risk.join(shell, "company_id", "left").select("company_id", half_up(F.least(both, F.lit(1.0)), 4).alias("promoter_network_risk"))


def research_risk(f: DataFrame) -> DataFrame:
    """f: company_id, news_risk, litigation_risk, sector_risk, macro_risk, rating_trend."""
    score = 0.25 * F.col("news_risk") + 0.35 * F.col("litigation_risk") + 0.20 * F.col("sector_risk") + 0.10 * F.col("macro_risk") + 0.10 * F.when(F.col("rating_trend") == "DETERIORATING", 0.10).otherwise(0.0)
    return f.select("company_id", half_up(score, 4).alias("research_risk"))
