"""Secrets in texts, in DataFrame functions only: strong spans, and weak ones that their
complements confirm.

Strong kinds (assign, access, hex) are reported wherever their patterns match. Two weak kinds
mean little alone: a bare run of 40 base64 characters (secret) and a service address
(endpoint). They are reported where complementary parts co-occur in one scope: a secret with an
access identifier, an endpoint with an access identifier or an assignment, no more than SCOPE
characters apart in the same text. That is an interval join: intervals, widened by the scope,
are dealt over cells of SCOPE characters, and equal cells meet.

Defined cases: null text is empty, and an empty text has no spans. Equal spans of repeated
rows are joined once and reported for each row. Positions count code points, ends are
exclusive. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.shared import fresh, shared_dir, stored

#: Kind, pattern, group whose length counts, least length, most length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, None),
    ("hex", r"[0-9a-f]{32,}", 0, 32, None),
    ("secret", r"[A-Za-z0-9+/]{40,}", 0, 40, 40),
    ("endpoint", r"https?://[A-Za-z0-9.:/_-]+", 0, 8, None),
]
BASE = ("assign", "access", "hex")
SCOPE = 200
#: Matches of a text that are put in place at once.
RUN = 256


def placed(rows: Column, at: Column) -> Column:
    """start, end and part of each match of rows (gap before it, its size, its part), from at on."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,part:int>>")

    def step(so_far, x):
        start = so_far["at"] + x["gap"]
        end = start + x["size"]
        here = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part"))
        more = F.when(x["size"].isNotNull(), F.array_append(so_far["spans"], here)).otherwise(so_far["spans"])
        return F.struct(F.coalesce(end, start).alias("at"), more.alias("spans"))

    return F.aggregate(rows, F.struct(at.alias("at"), none.alias("spans")), step, lambda x: x["spans"])


def placed_in_runs(rows: Column) -> Column:
    """placed() of many matches: runs of RUN matches, each from the sum of what is before it, so that
    no long array is copied for each match."""
    zero = F.lit(0).cast("long")
    numbers = F.sequence(F.lit(0), ((F.size(rows) - 1) / RUN).cast("int"))
    run = lambda i: F.slice(rows, i * RUN + 1, F.lit(RUN))
    width = lambda x: x["gap"] + F.coalesce(x["size"], zero)
    sums = F.transform(numbers, lambda i: F.aggregate(run(i), zero, lambda so_far, x: so_far + width(x)))
    starts = F.aggregate(
        sums, F.array(zero), lambda so_far, x: F.array_append(so_far, F.element_at(so_far, -1) + x)
    )
    return F.flatten(F.zip_with(numbers, F.slice(starts, 1, F.size(numbers)), lambda i, at: placed(run(i), at)))


def spans(text: Column, pattern: str, group: int, least: int, most: int | None) -> Column:
    """Array of (start, end) of the pattern's matches whose group has a fitting length.

    Lengths of what stands between matches and of the matches add up to positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("found"), part.alias("part")),
        lambda x: F.struct(
            F.length(x["gap"]).cast("long").alias("gap"), F.length(x["found"]).cast("long").alias("size"), F.length(x["part"]).alias("part")
        ),
    )
    # The lambda's variable holds the matches, so that the text is scanned once and not again for each run.
    put = lambda r: F.when(F.size(r) <= RUN, placed(r, F.lit(0).cast("long"))).otherwise(placed_in_runs(r))
    every = F.element_at(F.transform(F.array(rows), put), 1)
    fits = F.filter(every, lambda x: (x["part"] >= least) & (F.lit(most is None) | (x["part"] <= (most or 0))))
    plain = F.transform(fits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), plain).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def tagged(kind: str, column: Column) -> Column:
    """The spans with their kind and its place in KINDS, for sorting."""
    rank = [k for k, *_ in KINDS].index(kind)
    return F.transform(
        column, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def listed(columns: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    line = F.array_sort(F.concat(*[tagged(k, c) for k, c in columns]))
    return F.array_join(F.transform(line, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def confirmed(found: DataFrame) -> DataFrame:
    """doc, key, secret and endpoint arrays of the weak spans that a complement confirms."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k, *_ in KINDS if k != "hex"])
    rows = (
        found.where("size(secret) + size(endpoint) > 0 AND size(assign) + size(access) > 0")
        .select("doc", "key", F.explode(each).alias("of"))
        .select("doc", "key", F.col("of.kind").alias("kind"), F.explode("of.spans").alias("span"))
        .select("doc", "key", "kind", "span.start", "span.end")
    )
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE)))
    weak = rows.where("kind IN ('secret', 'endpoint')").distinct().withColumn("cell", cells(F.col("start"), F.col("end")))
    strong = (
        rows.where("kind IN ('assign', 'access')")
        .select("doc", "key", F.col("kind").alias("by"), F.col("start").alias("from"), F.col("end").alias("to"))
        .withColumn("cell", cells(F.col("from") - SCOPE, F.col("to") + SCOPE))
        .distinct()
    )
    near = (
        weak["doc"].eqNullSafe(strong["doc"]) & (weak["key"] == strong["key"]) & (weak["cell"] == strong["cell"])
        & (F.col("from") - F.col("end") <= SCOPE) & (F.col("start") - F.col("to") <= SCOPE)
        & ((F.col("kind") == "endpoint") | (F.col("by") == "access"))
    )
    real = weak.join(strong, near, "left_semi").select("doc", "key", "kind", "start", "end").distinct()
    pick = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end"))).alias(k)
    return real.groupBy("doc", "key").agg(pick("secret"), pick("endpoint"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, key, an array of (start, end) for each kind of KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("key"), *[spans(text, *rule).alias(k) for k, *rule in KINDS]
    )
    found = stored(found, f"{shared_dir(docs.sparkSession)}/found")
    real = confirmed(found).select(F.col("doc").alias("d"), F.col("key").alias("k"), F.col("secret").alias("s"), F.col("endpoint").alias("e"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return found.join(real, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select(
        F.col("doc").alias("doc_id"), "key", *BASE, F.coalesce("s", none).alias("secret"), F.coalesce("e", none).alias("endpoint")
    )


def report(scanned: DataFrame) -> DataFrame:
    """The digest of secret_scan's result for each row."""
    base = listed([(k, F.col(k)) for k in BASE])
    every = listed([(k, F.col(k)) for k, *_ in KINDS])
    return scanned.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), every.alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span replaced by a mark that names its kind; n_chars follows.

    All rows stay, repeated ones each, with their other columns; null text stays null.
    """
    d, k, hits, key = fresh(docs.columns, "d", "k", "hits", "key")
    scanned = secret_scan(docs).groupBy("doc_id", "key").agg(*[F.first(kind).alias(kind) for kind, *_ in KINDS])
    every = F.array_sort(F.concat(*[tagged(kind, F.col(kind)) for kind, *_ in KINDS]))
    found = scanned.select(F.col("doc_id").alias(d), F.col("key").alias(k), every.alias(hits)).where(F.size(hits) > 0)
    found = stored(found, f"{shared_dir(docs.sparkSession)}/hits")
    with_key = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = with_key.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left")

    def step(so_far, x):
        free = x["start"] >= so_far["at"]
        between = F.substring(F.col("text"), (so_far["at"] + 1).cast("int"), F.greatest(x["start"] - so_far["at"], F.lit(0)).cast("int"))
        mark = F.concat(F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(
            F.greatest(so_far["at"], x["end"]).alias("at"),
            F.when(free, F.array_append(so_far["out"], F.concat(between, mark))).otherwise(so_far["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        F.col(hits), start, step, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(F.col("text"), (x["at"] + 1).cast("int"), 2147483647))
    )
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(clean)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hits).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _oracle() -> str:
    """The same by DuckDB: positions from window sums, the interval join as a semi-join."""
    found = " UNION ALL ".join(
        f"""SELECT r, {rank} AS rank, '{kind}' AS kind, i,
             length(gaps[i]) AS gap, length(hits[i]) AS size, length(parts[i]) AS part
           FROM (SELECT r, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM (
             SELECT r, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits,
                    regexp_extract_all(t, '{p}', {group}) AS parts FROM d))"""
        for rank, (kind, pattern, group, *_) in enumerate(KINDS)
        for p in [pattern.replace("'", "''")]
    )
    fits = " OR ".join(f"kind = '{k}' AND part >= {least}" + (f" AND part <= {most}" if most else "") for k, _, _, least, most in KINDS)
    line = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) {}, '')"
    strong = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM m),
fit AS (SELECT r, rank, kind, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE {fits}),
hit AS (SELECT * FROM fit f WHERE {strong} OR EXISTS (
  SELECT 1 FROM fit a WHERE a.r = f.r AND a.s - f.e <= {SCOPE} AND f.s - a.e <= {SCOPE}
    AND (a.kind = 'access' OR a.kind = 'assign' AND f.kind = 'endpoint'))),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, {line.format(f"FILTER ({strong})")} AS base, {line.format("")} AS spans
      FROM hit GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
