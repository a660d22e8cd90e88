"""Sections, figures, remarks and people in filed documents, by built-in text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.lexicon import best_class, bound, by_class, lines_of, number_after, percent_after, read_lexicon
from lendscope.functions.numbers import UNIT, multiplier
from lendscope.functions.rounding import half_up
from lendscope.operators.documents import around, matches

#: A line that is a heading: capitals of two words or more, a number and a capital, or three words in title case.
HEADING = r"^(?:[A-Z][A-Z0-9&()/,.:-]*(?: +[A-Z0-9&()/,.:-]+)+|(?:[0-9]{1,2}\.?[0-9]{0,2}\.?|[A-Z]\.) +[A-Z][^\n]*|[A-Z][a-z]+(?: +[A-Z][a-z]+){2,})$"
#: Pattern, type and weight of audit remarks; the first pattern of a type counts.
REMARKS = [
    ("qualified opinion|basis for qualified", "QUALIFIED_OPINION", 0.7), ("adverse opinion", "ADVERSE_OPINION", 1.0), ("going concern|material uncertainty", "GOING_CONCERN", 0.9),
    ("emphasis of matter", "EMPHASIS_OF_MATTER", 0.2), ("material weakness", "MATERIAL_WEAKNESS", 0.6), ("scope.?limitation|unable to obtain sufficient", "SCOPE_LIMITATION", 0.5),
    (r"caro\b|companies auditor.?s report order", "CARO_QUALIFICATION", 0.4), ("reconciliation[^\n]*differ|differ[^\n]*reconciliation", "RECONCILIATION_DIFFERENCE", 0.3),
    ("non.compliance[^\n]*(?:act|regulation|rule)|(?:act|regulation)[^\n]*non.compliance", "NON_COMPLIANCE", 0.5),
    ("internal financial controls[^\n]*(?:inadequate|deficient|not adequate)", "INTERNAL_CONTROL_DEFICIENCY", 0.4), ("provision[^\n]*not made|not provided for|not provisioned", "UNDER_PROVISIONING", 0.2),
]
UNKNOWN_REMARK = 0.1
#: Metrics of figures in running text.
FIGURE_METRICS = {
    "revenue": ["revenue from operations", "net revenue", "total revenue", "turnover"], "ebitda": ["ebitda", "operating profit", "earnings before interest"],
    "pat": ["profit after tax", "pat", "net profit", "net income"], "gross_profit": ["gross profit", "gross margin"], "total_debt": ["total debt", "total borrowings", "long term debt", "short term borrowings"],
    "net_worth": ["net worth", "shareholders equity", "share capital and reserves", "total equity"], "current_assets": ["current assets"], "current_liab": ["current liabilities"], "cash": ["cash and cash equivalents", "cash and bank"],
    "capex": ["capital expenditure", "capex", "purchase of fixed assets", "additions to ppne"], "dscr": ["debt service coverage", "dscr"], "interest_coverage": ["interest coverage", "icr", "interest service"],
    "debt_equity": ["debt equity ratio", "d/e ratio", "leverage ratio"], "current_ratio": ["current ratio"], "itc": ["input tax credit", "itc"], "tax_paid": ["tax paid", "gst deposited", "gst paid"],
}
_LABEL = r"\b([A-Za-z][A-Za-z ]{2,39}?)[: \t]+"
#: Groups: label, value, unit.
FIGURES = {
    "currency": rf"(?i){_LABEL}(?:Rs\.?|₹|INR) *([0-9][0-9,]*\.?[0-9]*) *((?:{UNIT})\b)?", "percentage": rf"(?i){_LABEL}([0-9]{{1,3}}\.?[0-9]*) *(%)", "ratio": rf"(?i){_LABEL}([0-9]{{1,2}}\.?[0-9]*) *(x|times)\b",
}
_AMOUNT = rf"[^\n0-9]{{0,80}}?([0-9][0-9,]*\.?[0-9]*) *((?:{UNIT})\b)?"
#: Document type, metric and the words before its amount.
FINANCIALS = [
    ("gst", "gst_turnover", "taxable value|outward supplies|total turnover|aggregate turnover"), ("gst", "itc_claimed", "input tax credit|itc"), ("bank_statement", "opening_balance", "opening balance"),
    ("bank_statement", "closing_balance", "closing balance"), ("bank_statement", "total_credits", "total credits?"), ("bank_statement", "total_debits", "total debits?"),
    ("annual_report", "revenue", "revenue from operations|total revenue|net revenue"), ("annual_report", "ebitda", "ebitda"), ("annual_report", "pat", "profit after tax|net profit"),
    ("annual_report", "total_debt", "total debt|total borrowings"), ("annual_report", "equity", "net worth|total equity"), ("annual_report", "current_assets", "current assets"),
    ("annual_report", "current_liabilities", "current liabilities"), ("annual_report", "interest", "finance costs?|interest expense"), ("itr", "gross_total_income", "gross total income|total income"),
]
ASSESSMENT_YEAR = r"(?i)assessment year[: ]*(20[0-9]{2}-[0-9]{2,4})"
#: In upper-cased text: up to seven words before a legal form; up to five words after a director's number; two words or
#: more before a six-digit postal code.
COMPANY = r"\b((?:[A-Z0-9&]{2,} ){1,7}(?:PVT|PRIVATE|LIMITED|LTD|LLP))\b"
DIRECTOR = r"\bDIN\W{0,3}[0-9]{8}\W{1,5}((?:[A-Z]+\.? ){1,4}[A-Z]+)"
ADDRESS = r"\b((?:[A-Z]+[ ,.-]+){2,12})[0-9]{6}\b"
LEGAL_FORM = r"\b(?:PVT|PRIVATE|LTD|LIMITED|LLP|INC|CORP)\b\.?"
#: Two or three capitalised words, and these after a role or a title.
_PERSON = r"((?:[A-Z][a-z]+ +){1,2}[A-Z][a-z]+)"
PROMOTER = rf"\b(?:[Pp]romoter|[Mm]anaging [Dd]irector|[Cc]hairman|CEO|CFO|CMD)\W{{1,3}}(?:(?:Mr|Ms|Dr|Shri|Smt)\.? )?{_PERSON}"
HONORED = rf"\b(?:Mr|Ms|Dr|Shri|Smt|CA|CS)\.? +{_PERSON}"
DIN = r"(?i)DIN[ :]*([0-9]{8})"
#: A sentence of a charge: its amount, and up to six words after the one that names the lender.
CHARGE = r"(?i)\b(?:charge|hypothecation|mortgage|pledge)\b[^.\n]{0,120}?(?:₹|\brs\b\.?) ?([0-9][0-9,]*)[^.\n]{0,60}? (?:in favour of|to) ((?:[a-z&]+ ){0,5}[a-z&]+)"
CIN = r"\b[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b"


def _all(pattern: str, group: int, text="text") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def segment_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, heading, text, and doc_type if docs have it. A block ends before a heading and at two blank lines or more; blank lines after a
    heading belong to its block. Blank blocks are dropped, and a null text has none. heading is empty without one."""
    line = lambda x: F.when(F.length(F.trim(x)).between(4, 120) & F.trim(x).rlike(HEADING), F.concat(F.lit("\x01"), F.trim(x))).otherwise(x)
    marked = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    joined = F.regexp_replace(marked, "(\x01[^\n]*)\n(?:[ \t\r]*\n)+", "$1\n")
    kept = ["doc_id", "doc_type"] if "doc_type" in docs.columns else ["doc_id"]
    rows = docs.select(*kept, F.posexplode(F.filter(F.split(joined, "(?=\x01)|\n[ \t\r]*\n(?:[ \t\r]*\n)+"), lambda b: F.regexp_replace(b, "[ \t\r\n]", "") != "")).alias("block_no", "block"))
    headed = F.col("block").startswith("\x01")
    heading = F.when(headed, F.substring_index(F.substr("block", F.lit(2)), "\n", 1)).otherwise("")
    return rows.select("doc_id", "block_no", heading.alias("heading"), F.regexp_replace("block", "\x01", "").alias("text"), *kept[1:])


#: Words of a block's first 300 characters, and the section they head, where no keyword tells it.
HEADERS = [
    ("balance *sheet|statement of[^\n]*assets", "balance_sheet"), ("profit *(?:&|and) *loss|income *statement", "profit_loss"), ("cash *flow", "cash_flow"), ("auditor.?s? *report|independent *auditor", "auditors_report"),
    ("director.?s? *report", "directors_report"), ("notes *(?:to|on) *(?:the *)?(?:financial|account)", "notes_to_accounts"), ("related *party", "related_party"), ("contingent *liabilit", "contingent_liabilities"),
    ("corporate *governance", "corporate_governance"), ("management[^\n]*discussion|md *& *a", "management_discussion"), ("schedule[^\n]*(?:borrowing|debt|loan|fixed *asset)", "notes_to_accounts"),
]


def section_table(spark, lexicon: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_type, sections (name and phrases, in declared order) of a lexicon of document types, sections and phrases."""
    types: dict[str, list] = {}
    for (kind, section), words in by_class(lexicon or read_lexicon("sections")).items():
        types.setdefault(kind, []).append((section, words))
    return spark.createDataFrame(list(types.items()), "doc_type string, sections array<struct<name: string, phrases: array<string>>>")


def classify_sections(blocks: DataFrame, lexicon: list[tuple[str, str, str]] | None = None, default: str = "annual_report") -> DataFrame:
    """The section with most phrases of the block's document type (default, where blocks have none), the first declared
    on a tie; 0.5, 0.75 or 0.95 sure. Without a phrase, or for a type that the lexicon lacks, the one that the block's first
    300 characters head (0.55), else unclassified (0.15). lexicon: document type, section, phrase; by default that of the
    library, of ten types."""
    head = F.lit(None).cast("string")
    for pattern, section in reversed(HEADERS):
        head = F.when(F.substring("low", 1, 300).rlike(pattern), section).otherwise(head)
    kind = F.col("doc_type") if "doc_type" in blocks.columns else F.lit(default)
    low = blocks.select("doc_id", "block_no", kind.alias("doc_type"), F.lower("text").alias("low"))
    told = low.join(F.broadcast(section_table(blocks.sparkSession, lexicon)), "doc_type", "left")  # some rows, one a type
    best = told.select("doc_id", "block_no", best_class(F.col("low"), F.col("sections")).alias("b"), head.alias("head"))
    n = F.coalesce("b.n", F.lit(0))
    sure = F.when(n > 0, F.least(0.5 + (n - 1) * 0.25, F.lit(0.95))).when(F.col("head").isNotNull(), 0.55).otherwise(0.15)
    return best.select("doc_id", "block_no", F.when(n > 0, F.col("b.name")).otherwise(F.coalesce("head", F.lit("unclassified"))).alias("section"), sure.alias("confidence"))


def audit_texts(docs: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """docs with the text of its auditor's sections in place of the whole, where it has such sections. blocks: doc_id, block_no,
    text; sections: of classify_sections."""
    own = blocks.join(sections.where("section = 'auditors_report'").select("doc_id", "block_no"), ["doc_id", "block_no"])
    joined = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("audit_text"))
    return docs.join(joined, "doc_id", "left").withColumn("text", F.coalesce("audit_text", "text")).drop("audit_text")


def audit_remarks(docs: DataFrame) -> DataFrame:
    """doc_id, company_id, type, weight, context (80 characters before and 120 after): each type of remark once a document."""
    low = docs.select("doc_id", "company_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    context = lambda p: around(F.col("low"), F.regexp_extract("low", p, 0), 80, 120)
    each = F.array(*[F.when(matches(F.col("low"), p), F.struct(F.lit(t).alias("type"), F.lit(w).alias("weight"), context(p).alias("context"))) for p, t, w in REMARKS])
    return low.select("doc_id", "company_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("doc_id", "company_id", "x.*")


def audit_remark_score(remarks: DataFrame) -> DataFrame:
    weight = F.coalesce("weight", F.lit(UNKNOWN_REMARK)).cast("decimal(6,2)")
    return remarks.groupBy("company_id").agg(half_up(F.least(F.sum(weight).cast("double"), F.lit(1.0)), 4).alias("audit_score"))


def bank_anomaly(statements: DataFrame) -> DataFrame:
    """Sum over a company's statements: returned cheques 0.3, returned mandates 0.2, over 20 cash withdrawals 0.2, zeroing 0.15."""
    low = statements.select("company_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    has = lambda *words: F.when(sum((F.col("t").contains(w).cast("int") for w in words), F.lit(0)) > 0, 1).otherwise(0)
    cents = 30 * has("cheque return", "dishonor", "insufficient funds") + 20 * has("ecs return", "nach return") + 20 * (F.regexp_count("t", F.lit("cash withdrawal")) > 20).cast("int")
    cents = cents + 15 * (F.col("t").contains("end of day balance") & F.col("t").contains("0.00")).cast("int")
    return low.groupBy("company_id").agg((F.least(F.sum(cents), F.lit(100)) / 100.0).alias("bank_anomaly"))


def _figure(kind: str):
    group = lambda x, i: F.regexp_extract(x, FIGURES[kind], i)
    return lambda x: F.struct(F.lit(kind).alias("type"), F.lower(F.trim(group(x, 1))).alias("label"), F.regexp_replace(group(x, 2), ",", "").try_cast("double").alias("n"), F.lower(group(x, 3)).alias("unit"), x.alias("found"))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, type, label, metric, value, has_unit, context: each label and value of a document once; amounts in rupees; what
    stands within 60 characters of its first place."""
    parts = [F.transform(_all(p, 0), _figure(kind)) for kind, p in FIGURES.items()]  # a text is scanned once a pattern
    found = docs.select("doc_id", "text", F.posexplode(F.concat(*parts)).alias("place", "x")).select("doc_id", "place", "x.*", around(F.col("text"), F.col("x.found"), 60, 60).alias("context")).where("n IS NOT NULL")
    metric = F.lit("other")
    for name, words in reversed(list(FIGURE_METRICS.items())):
        metric = F.when(sum((F.col("label").contains(w).cast("int") for w in words), F.lit(0)) > 0, name).otherwise(metric)
    value = F.col("n") * F.when(F.col("type") == "currency", multiplier(F.col("unit"))).otherwise(1.0)
    keys = [F.col("doc_id"), F.col("type"), F.col("label"), metric.alias("metric"), value.alias("value"), (F.col("unit") != "").alias("has_unit")]
    return found.select(*keys, "place", "context").groupBy("doc_id", "type", "label", "metric", "value", "has_unit").agg(F.min_by("context", "place").alias("context"))


def doc_financials(docs: DataFrame) -> DataFrame:
    """docs: doc_id, doc_type, text. The first amount after a metric's words, in rupees, for the metrics of the type."""
    each = []
    for kind, metric, words in FINANCIALS:
        p = f"(?i)(?:{words}){_AMOUNT}"
        value = F.regexp_replace(F.regexp_extract("text", p, 1), ",", "").try_cast("double") * multiplier(F.regexp_extract("text", p, 2))
        each.append(F.when((F.col("doc_type") == kind) & (value > 0), F.struct(F.lit(metric).alias("metric"), value.alias("value"))))
    return docs.select("doc_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


def assessment_years(docs: DataFrame) -> DataFrame:
    """doc_id, assessment_year: the first one that a tax return tells."""
    year = F.nullif(F.regexp_extract("text", ASSESSMENT_YEAR, 1), F.lit(""))
    return docs.where("doc_type = 'itr'").select("doc_id", year.alias("assessment_year")).where("assessment_year IS NOT NULL")


#: Words after which notes tell a share in percent.
CAPACITY_NAMES, CUSTOMER_NAMES = ["capacity", "utilization", "util"], ["customer"]
CUSTOMERS = "major customers?|top [0-9]+ customers?"


def notes_signals(notes: DataFrame) -> DataFrame:
    """notes: company_id, text, debt_crore. Collateral over debt (1.3), capacity (0.7) and top customers' share (0.4), with
    defaults. Collateral and capacity are told on a line; customers' share in a sentence about major or top customers."""
    low = F.lower("text")
    line = lambda lines: F.struct(number_after(lines, "collateral").alias("pledged"), F.coalesce(*[percent_after(lines, n) for n in CAPACITY_NAMES]).alias("used"))
    about = lambda text: F.filter(F.split(text, "[.]"), lambda x: x.rlike(CUSTOMERS))
    told = notes.select("company_id", "debt_crore", "text", bound(lines_of(F.col("text")), line).alias("x"), bound(about(low), lambda x: percent_after(x, CUSTOMER_NAMES[0])).alias("share"))
    cover = F.when(F.col("debt_crore") > 0, half_up(F.col("x.pledged") / F.col("debt_crore"), 3))
    words = F.when(low.contains("low capacity") | low.contains("idle"), 0.35).when(low.contains("full capacity") | low.contains("running well"), 0.90).otherwise(0.70)
    return told.select(
        "company_id", F.coalesce(cover, F.lit(1.3)).alias("collateral_coverage"), F.coalesce(half_up(F.col("x.used") / 100, 4), words).alias("capacity_utilization"),
        F.coalesce(half_up(F.col("share") / 100, 4), F.lit(0.4)).alias("customer_concentration"),
    )


def _first_seen(docs: DataFrame, pattern: str, k: int) -> DataFrame:
    found = docs.select("company_id", "doc_id", F.posexplode(_all(pattern, 1)).alias("place", "name"))
    once = found.groupBy("company_id", F.regexp_replace("name", " +", " ").alias("name")).agg(F.min(F.struct("doc_id", "place")).alias("seen"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("company_id").orderBy("seen"))).where(F.col("rank") <= k)


def promoters(docs: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct names of a company that follow a role."""
    return _first_seen(docs, PROMOTER, k).select("company_id", "name", "rank")


def mca_directors(docs: DataFrame, k: int = 10) -> DataFrame:
    """company_id, name, din: the first k names with an honorific of each document, paired with its DINs by position;
    of a name with several the least DIN."""
    rows = F.slice(F.arrays_zip(_all(HONORED, 1).alias("n"), _all(DIN, 1).alias("d")), 1, k)
    found = docs.select("company_id", F.explode(rows).alias("x")).where("x.n IS NOT NULL")
    return found.groupBy("company_id", F.regexp_replace("x.n", " +", " ").alias("name")).agg(F.min("x.d").alias("din"))


def mca_charges(docs: DataFrame) -> DataFrame:
    rows = F.arrays_zip(_all(CHARGE, 1).alias("a"), _all(CHARGE, 2).alias("l"))
    found = docs.select("company_id", "doc_id", F.explode(rows).alias("x"))
    return found.select("company_id", "doc_id", F.regexp_replace("x.a", ",", "").try_cast("double").alias("amount"), F.trim("x.l").alias("lender")).distinct()


def mca_status(docs: DataFrame) -> DataFrame:
    """The first CIN of a company, and STRUCK_OFF if any of its documents says so, else ACTIVE if any does."""
    low = F.lower(F.coalesce("text", F.lit("")))
    cin = F.nullif(F.regexp_extract("text", CIN, 0), F.lit(""))
    rows = docs.select("company_id", "doc_id", cin.alias("c"), low.contains("struck off").alias("s"), low.contains("active").alias("a"))
    return rows.groupBy("company_id").agg(F.min_by("c", F.when(F.col("c").isNotNull(), F.col("doc_id"))).alias("cin"), F.when(F.bool_or("s"), "STRUCK_OFF").when(F.bool_or("a"), "ACTIVE").otherwise("UNKNOWN").alias("status"))


def doc_company_names(docs: DataFrame) -> DataFrame:
    """company_id, kind, name: distinct companies (without their legal form), directors and addresses in upper-cased texts."""
    up = docs.select("company_id", F.upper("text").alias("text"))
    tidy = lambda x: F.trim(F.regexp_replace(x, " +", " "))
    ends = r"[ ,.-]+$"
    kinds = [("company", COMPANY, lambda x: tidy(F.regexp_replace(x, LEGAL_FORM, " "))), ("director", DIRECTOR, tidy), ("address", ADDRESS, lambda x: F.substring(tidy(F.regexp_replace(x, ends, "")), 1, 60))]
    named = lambda kind, f: lambda x: F.struct(F.lit(kind).alias("kind"), f(x).alias("name"))
    rows = [F.transform(_all(p, 1), named(k, f)) for k, p, f in kinds]
    return up.select("company_id", F.explode(F.concat(*rows)).alias("x")).select("company_id", "x.*").where("length(name) > 4").distinct()
