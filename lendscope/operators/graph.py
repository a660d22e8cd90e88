"""Transaction graph: edges, counterparties, reciprocal payments, cycles, round trips, Benford."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.numbers import first_digit
from lendscope.functions.rounding import half_up
from lendscope.stages import delete, shared_place, write

PLACEHOLDERS = ("SELF", "UNKNOWN")
#: Parts of the fraud score.
FRAUD_WEIGHTS = {"circular": 0.30, "benford": 0.18, "gst": 0.17, "gstr": 0.12, "bank": 0.08, "audit": 0.10, "layered": 0.03, "shell": 0.02}


def txn_edges(txns: DataFrame) -> DataFrame:
    """One row per company and (src, dst): total, count, first and last date."""
    real = (F.col("src") != F.col("dst")) & ~((F.col("src") == "UNKNOWN") & (F.col("dst") == "UNKNOWN"))
    return txns.where(real).groupBy("company_id", "src", "dst").agg(
        F.sum("amount").cast("decimal(18,2)").cast("double").alias("total_amount"),
        F.count(F.lit(1)).alias("txn_count"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("company_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("company_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges and density m/(n(n-1)) per company."""
    stats = node_degrees(edges).groupBy("company_id").agg(F.count(F.lit(1)).alias("node_count"), (F.sum("degree") / 2).cast("long").alias("edge_count"))
    n = F.col("node_count").cast("double")
    return stats.withColumn("density", F.when(n > 1, half_up(F.col("edge_count") / (n * (n - 1)), 4)).otherwise(0.0))


def top_nodes(edges: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("company_id").orderBy(F.desc("degree"), "node")
    return node_degrees(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counterparty_freq(txns: DataFrame) -> DataFrame:
    ends = txns.select("company_id", F.explode(F.array("src", "dst")).alias("entity")).where(~F.col("entity").isin(*PLACEHOLDERS))
    return ends.groupBy("company_id", "entity").agg(F.count(F.lit(1)).alias("freq"))


def top_counterparties(freq: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent counterparties of a company, the first by name on a tie."""
    order = Window.partitionBy("company_id").orderBy(F.desc("freq"), "entity")
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counterparties(freq: DataFrame) -> DataFrame:
    """company_id, entity: each counterparty of a company once."""
    return freq.select("company_id", "entity").distinct()


def counterparty_concentration(freq: DataFrame) -> DataFrame:
    share = half_up(F.max("freq") / F.sum("freq"), 4)
    out = freq.groupBy("company_id").agg(share.alias("concentration"))
    c = F.col("concentration")
    return out.withColumn("severity", F.when(c > 0.5, "HIGH").when(c > 0.35, "MEDIUM").otherwise("NONE"))


def layered_pairs(edges: DataFrame) -> DataFrame:
    """Pairs that pay each other, once each: ratio of the smaller to the larger flow, and their sum."""
    flow = lambda forth: F.max(F.when((F.col("src") < F.col("dst")) == forth, F.col("total_amount")))
    ends = [F.least("src", "dst").alias("entity_a"), F.greatest("src", "dst").alias("entity_b")]
    both = edges.where("total_amount > 0 AND src <> dst").groupBy("company_id", *ends).agg(flow(True).alias("x"), flow(False).alias("y"))
    x, y = F.col("x"), F.col("y")
    return both.where("x IS NOT NULL AND y IS NOT NULL").select(
        "company_id", "entity_a", "entity_b", half_up(F.least(x, y) / F.greatest(x, y), 3).alias("ratio"), half_up(x + y, 2).alias("combined"),
    )


def layered_score(edges: DataFrame, pairs: DataFrame, ordered: bool = True) -> DataFrame:
    """Share of flow in reciprocal pairs, weighted by their ratio; each pair counts once a direction."""
    totals = edges.groupBy("company_id").agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("total"))
    weighed = F.sum((F.col("ratio") * F.col("combined")).cast("decimal(24,6)")).cast("double")
    found = pairs.groupBy("company_id").agg(weighed.alias("weighed"), F.count(F.lit(1)).alias("pairs"))
    joined = totals.join(found, "company_id", "left")
    score = half_up(F.least((2.0 if ordered else 1.0) * F.coalesce("weighed", F.lit(0.0)) / F.col("total"), F.lit(1.0)), 4)
    out = joined.select("company_id", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), score.alias("layered_score"))
    s = F.col("layered_score")
    return out.withColumn("severity", F.when(s > 0.15, "HIGH").when(s > 0.05, "MEDIUM").otherwise("NONE"))


#: Rounds of trimming go on while one takes more than this share of the payments; the work depends on it, the cycles don't.
TRIM = 1 / 16
#: Bits of a place for a node's number; above them are eight steps for each doubling of its partners.
NUMBER_BITS = 54


def both_ways(pay: DataFrame, a: str, b: str) -> DataFrame:
    """company_id, node, degree of the nodes that pay somebody and are paid. pay: company_id, payer a, payee b."""
    end = lambda c, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("n_out"), F.lit(1 - out).alias("n_in"))
    ends = pay.select("company_id", F.explode(F.array(end(a, 1), end(b, 0))).alias("e")).select("company_id", "e.*")
    sums = ends.groupBy("company_id", "node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    return sums.where("n_out > 0 AND n_in > 0").select("company_id", "node", (F.col("n_out") + F.col("n_in")).alias("degree"))


def placed(pay: DataFrame, place: str) -> tuple[DataFrame, DataFrame, str]:
    """The nodes (company_id, node, at) and payments (company_id, s, d: places; and their folder) that a cycle can hold: those to a node that
    pays nobody, or from one that nobody pays, go until a round takes hardly any. at is a node's place in an order by
    partners, as a number of its own. Each round is a table; that before it is deleted."""
    spark, n = pay.sparkSession, 0
    at = F.shiftleft(F.floor(8 * F.log2(F.col("degree"))).cast("long"), NUMBER_BITS).bitwiseOR(F.monotonically_increasing_id())
    nodes = write(both_ways(pay, "src", "dst").select("company_id", "node", at.alias("at")), f"{place}/nodes")
    by = lambda c, to: nodes.select("company_id", F.col("node").alias(c), F.col("at").alias(to))
    now = write(pay.select("company_id", "src", "dst").join(by("src", "s"), ["company_id", "src"]).join(by("dst", "d"), ["company_id", "dst"]).select("company_id", "s", "d"), f"{place}/trim0")
    size, left = pay.count(), now.count()
    while size - left > TRIM * size:
        n += 1
        alive = write(both_ways(now, "s", "d").select("company_id", "node"), f"{place}/alive{n}")
        on = lambda c: alive.select("company_id", F.col("node").alias(c))  # noqa: E731, B023
        now = write(now.join(on("s"), ["company_id", "s"], "left_semi").join(on("d"), ["company_id", "d"], "left_semi"), f"{place}/trim{n}")
        delete(spark, f"{place}/trim{n - 1}")
        delete(spark, f"{place}/alive{n}")
        size, left = left, now.count()
    return nodes, now, f"{place}/trim{n}"


def rings(pay: DataFrame, longest: int) -> DataFrame:
    """company_id, ring (places in the order of payment, from the greatest on): each simple cycle once. pay: company_id, s, d.

    A cycle is found at its greatest place: a way out from it and a way back to it, of half its edges each, meet at their
    ends, and all places on the ways are less. So a hub is an end of open paths and never their middle, unless a greater
    hub begins them, and no open path has more than half a cycle's edges. Ways are rows of numbers.
    """
    hop = pay.select(F.col("company_id").alias("g"), F.col("s").alias("x"), F.col("d").alias("y"))
    new = lambda c, names: functools.reduce(lambda a, b: a & b, [F.col(c) < F.col("start"), *[F.col(c) != F.col(n) for n in names]])
    ways = {}
    for side, first, last, own, far in (("o", "s", "d", "x", "y"), ("b", "d", "s", "y", "x")):  # from the start on, and back to it
        way = pay.where(F.col(last) < F.col(first)).select("company_id", F.col(first).alias("start"), F.col(last).alias(f"{side}1"))
        ways[side] = [way]
        for k in range(2, (longest + (side == "o")) // 2 + 1):
            names = [f"{side}{i}" for i in range(1, k)]
            on = (F.col("company_id") == F.col("g")) & (F.col(names[-1]) == F.col(own)) & new(far, names)
            ways[side].append(ways[side][-1].join(hop, on).select("company_id", "start", *names, F.col(far).alias(f"{side}{k}")))
    found = None
    for k, out in enumerate(ways["o"], 1):
        names = [f"o{i}" for i in range(1, k + 1)]
        homes = None
        for j in (k - 1, k):  # edges of the way back
            if 1 <= j <= longest - k:
                more = [F.col(f"b{i}").alias(f"m{i}") if i < j else F.lit(None).cast("long").alias(f"m{i}") for i in range(1, k)]
                home = ways["b"][j - 1].select("company_id", "start", F.col(f"b{j}").alias(names[-1]), *more)
                homes = home if homes is None else homes.unionByName(home)
        if homes is None:
            continue
        met = out.join(homes, ["company_id", "start", names[-1]])
        for n in names[:-1]:
            for i in range(1, k):
                met = met.where(F.col(f"m{i}").isNull() | (F.col(f"m{i}") != F.col(n)))
        ring = F.array_compact(F.array("start", *names, *[f"m{i}" for i in range(k - 1, 0, -1)]))
        own = met.select("company_id", ring.alias("ring"))
        found = own if found is None else found.unionByName(own)
    return found


def cycles(edges: DataFrame, longest: int = 4, hub: int | None = None) -> DataFrame:
    """Simple directed cycles of 2 to longest nodes, each from its least node on; suspicious up to four nodes.

    Payments that can't be on a cycle leave first, and cycles are sought among numbers (rings); names and amounts are
    looked up for the cycles alone. edges are read several times, so large ones should be a table. hub, off by default:
    nodes with more edges than that, in or out, leave, too.
    """
    spark = edges.sparkSession
    place = shared_place(spark)
    pay = edges.where("total_amount > 0 AND src <> dst").select("company_id", "src", "dst", "total_amount")
    if hub is not None:
        for end in ("src", "dst"):
            few = pay.groupBy("company_id", end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hub)
            pay = pay.join(few, ["company_id", end], "left_semi")
    nodes, kept, folder = placed(pay, place)
    found = write(rings(kept, longest), f"{place}/rings")
    delete(spark, folder)
    keys = ["company_id", "ring"]
    each = found.select(*keys, F.posexplode("ring").alias("i", "at")).join(nodes, ["company_id", "at"])
    named = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("ring_names"))
    least = F.array_position("ring_names", F.array_min("ring_names"))
    turned = F.concat(F.slice("ring_names", least, F.size("ring_names")), F.slice("ring_names", F.lit(1), least - 1))
    named = named.select("company_id", turned.alias("path"))
    steps = F.transform("path", lambda x, i: F.struct(i.alias("i"), x.alias("src"), F.get("path", (i + 1) % F.size("path")).alias("dst")))
    paid = named.select("company_id", "path", F.explode(steps).alias("e")).select("company_id", "path", "e.*").join(pay, ["company_id", "src", "dst"])
    amounts = F.transform(F.array_sort(F.collect_list(F.struct("i", "total_amount"))), lambda x: x["total_amount"])
    summed = paid.groupBy("company_id", "path").agg(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x).alias("amount"))
    out = summed.select("company_id", F.size("path").alias("length"), F.array_join("path", ">").alias("path"), half_up(F.col("amount"), 2).alias("amount"), (F.size("path") <= 4).alias("suspicious"))
    out = write(out, f"{place}/cycles")
    for name in ("nodes", "rings"):
        delete(spark, f"{place}/{name}")
    return out


def cycle_score(edges: DataFrame, found: DataFrame) -> DataFrame:
    totals = edges.groupBy("company_id").agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("total"))
    sums = found.where("suspicious").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
    one, none = F.lit(1.0), F.lit(0.0)
    by_amount = F.least(F.coalesce("amount", none) / F.when(F.col("total") > 0, F.col("total")).otherwise(one), one)
    by_count = F.least(F.coalesce("n", F.lit(0)) * 10 / F.lit(100.0), one)
    return totals.join(sums, "company_id", "left").select(
        "company_id", F.coalesce("n", F.lit(0)).cast("long").alias("cycles"), half_up(F.least(0.7 * by_amount + 0.3 * by_count, one), 4).alias("cycle_score")
    )


def round_trip(txns: DataFrame, days: int = 30) -> DataFrame:
    """Payments out to a party that paid back within days: the sum that came back after each.

    A range frame of running sums, so a busy pair isn't joined with itself.
    """
    party = F.when(F.col("direction") == "debit", F.col("dst")).otherwise(F.col("src"))
    day = F.datediff("txn_date", F.lit("1970-01-01").cast("date"))
    rows = txns.select("company_id", party.alias("party"), "txn_id", "direction", "amount", day.alias("day"))
    ahead = Window.partitionBy("company_id", "party").orderBy("day").rangeBetween(0, days)
    back = F.sum(F.when(F.col("direction") == "credit", F.col("amount"))).over(ahead)
    out = rows.withColumn("returned", back).where("direction = 'debit' AND returned > 0")
    return out.groupBy("company_id", "party").agg(
        F.count(F.lit(1)).alias("round_trips"), F.sum("amount").cast("decimal(18,2)").cast("double").alias("paid_out")
    )


def benford(values: DataFrame, least: float = 1000, enough: int = 100) -> DataFrame:
    """Deviation of first digits from Benford's law per company; values: company_id, amount."""
    digits = values.where(F.col("amount") > least).select("company_id", first_digit(F.col("amount")).alias("digit"))
    counts = digits.groupBy("company_id", "digit").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("company_id").pivot("digit", list(range(1, 10))).agg(F.first("n"))
    seen = lambda d: F.coalesce(F.col(str(d)), F.lit(0)).cast("double")
    n = sum((seen(d) for d in range(1, 10)), F.lit(0.0))
    chi = F.lit(0.0)
    for d in range(1, 10):
        expected = n * math.log10(1 + 1 / d)
        chi = chi + (seen(d) - expected) * (seen(d) - expected) / expected
    out = spread.select("company_id", n.cast("long").alias("amounts"), half_up(F.when(n >= enough, chi).otherwise(0.0), 2).alias("chi_square"))
    x = F.col("chi_square")
    return out.select(
        "*", half_up(F.least(x / 31.0, F.lit(1.0)), 4).alias("benford_score"),
        F.when(F.col("amounts") < enough, "INSUFFICIENT_DATA").when(x > 31.02, "HIGH").when(x > 15.51, "MEDIUM").otherwise("NONE").alias("severity"),
    )


def benford_distribution(values: DataFrame, least: float = 1000) -> DataFrame:
    """company_id, digit, observed, expected: shares of the first digits 1 to 9 of a company's amounts, and Benford's."""
    digits = values.where(F.col("amount") > least).select("company_id", first_digit(F.col("amount")).alias("digit"))
    counts = digits.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("digit"), half_up(F.col(f"d{d}") / F.col("n"), 4).alias("observed"), F.lit(round(math.log10(1 + 1 / d), 4)).alias("expected")) for d in range(1, 10)]))
    return counts.select("company_id", rows.alias("x")).select("company_id", "x.*")


def circular_composite(companies: DataFrame, cycle: DataFrame, layered: DataFrame, shell: DataFrame, concentration: DataFrame) -> DataFrame:
    joined = companies
    for scores in (cycle, layered, shell, concentration):
        joined = joined.join(scores, "company_id", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.5 * part("cycle_score") + 0.25 * part("layered_score") + 0.15 * part("shell_score") + 0.1 * part("concentration")
    out = joined.select("company_id", half_up(F.least(score, F.lit(1.0)), 4).alias("circular_score"))
    s = F.col("circular_score")
    return out.select("*", (s > 0.25).alias("suspicious"), (s > 0.8).alias("hard_reject"))


def shell_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Counterparties that share two name tokens or more with a company named in documents, and
    aren't that company; the first by name is the match. entities: company_id, entity;
    names: company_id, name."""
    suffix = r"(?i)\b(PVT|PRIVATE|LTD|LIMITED|LLP|INC|CORP)\b\.?"
    tokens = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(F.regexp_replace(c, suffix, " ")), "[^A-Z0-9]+", " "), " "), lambda x: x != "")))
    # Names meet by pairs of tokens, as single ones such as STEEL would join all names that have them.
    pairs = lambda x: F.explode(F.flatten(F.transform(x, lambda a: F.transform(F.filter(x, lambda b: b > a), lambda b: F.concat_ws(" ", a, b)))))
    left = entities.distinct().select("company_id", "entity", pairs(tokens(F.col("entity"))).alias("pair"))
    right = names.where(F.length("name") > 4).distinct().select("company_id", "name", pairs(tokens(F.col("name"))).alias("pair"))
    shared = left.join(right, ["company_id", "pair"]).where(F.upper("entity") != F.upper("name"))
    return shared.groupBy("company_id", "entity").agg(F.min("name").alias("matched"))


def shell_score(shells: DataFrame) -> DataFrame:
    """min(0.15 n, 1) for each company with n shell-like counterparties."""
    return shells.groupBy("company_id").agg(half_up(F.least(0.15 * F.count(F.lit(1)), F.lit(1.0)), 4).alias("shell_score"))


def fraud_composite(scores: DataFrame) -> DataFrame:
    """Weighted fraud score in percent; scores holds the eight parts and the ITC to turnover ratio."""
    base = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in FRAUD_WEIGHTS.items()), F.lit(0.0))
    base = F.least(base, F.lit(1.0))
    boosted = F.when(F.col("itc_ratio") > 0.25, F.least(base + 0.3, F.lit(1.0))).otherwise(base)
    return scores.select(
        "company_id", half_up(boosted * 100, 1).alias("fraud_score"), ((F.coalesce("circular", F.lit(0.0)) > 0.8) | (boosted > 0.85)).alias("hard_reject")
    )


def node_marks(edges: DataFrame, cycles: DataFrame, shells: DataFrame) -> DataFrame:
    """company_id, node, txns, in_cycle, is_shell, suspicious for each node. shells: company_id, entity."""
    nodes = edges.select("company_id", F.explode(F.array("src", "dst")).alias("node"), "txn_count").groupBy("company_id", "node").agg(F.sum("txn_count").alias("txns"))
    ring = cycles.select("company_id", F.explode(F.split("path", ">")).alias("node")).distinct().withColumn("in_cycle", F.lit(True))
    shell = shells.select("company_id", F.col("entity").alias("node")).distinct().withColumn("is_shell", F.lit(True))
    out = nodes.join(ring, ["company_id", "node"], "left").join(shell, ["company_id", "node"], "left").fillna(False, ["in_cycle", "is_shell"])
    return out.withColumn("suspicious", F.col("in_cycle") | F.col("is_shell"))


def edge_marks(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """company_id, src, dst, mark: cycle before layered (the reverse edge exists) before plain."""
    nodes = F.split("path", ">")
    steps = F.transform(nodes, lambda x, i: F.struct(x.alias("src"), F.get(nodes, (i + 1) % F.size(nodes)).alias("dst")))
    ring = cycles.select("company_id", F.explode(steps).alias("e")).select("company_id", "e.src", "e.dst").distinct().withColumn("c", F.lit(True))
    back = edges.select("company_id", F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("b", F.lit(True))
    keys = ["company_id", "src", "dst"]
    out = edges.select(keys).join(ring, keys, "left").join(back, keys, "left")
    return out.select(*keys, F.when(F.col("c"), "cycle").when(F.col("b"), "layered").otherwise("plain").alias("mark"))
