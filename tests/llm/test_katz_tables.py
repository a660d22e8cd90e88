"""Stored Katz tables: as katz at order two, and normalised at order three."""

import math
import zlib

from lendscope.llm import katz, katz_tables
from tests.llm.test_operators import prose

ROWS = [(i, prose(6 + i % 30, i % 25) + (" Rare%d" % i if i % 4 else "")) for i in range(100)] + [(500, None), (501, "unseen words Only"), (501, "unseen words Only"), (None, "")]


def test_order_two_equals_the_block_model(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    trained = [r for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    model = katz_tables.train(spark.createDataFrame(trained, "doc_id long, text string"), 2)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in katz_tables.score(d, model).collect())
    want = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in katz.score_documents(d).collect())
    assert len(got) == len(want) and all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_contexts_of_order_three_sum_to_one(spark):
    model = katz_tables.train(spark.createDataFrame(ROWS, "doc_id long, text string"), 3)
    p = [{tuple(r[:-1]): r[-1] for r in t.collect()} for t in model.levels]
    b = [{} if t is None else {tuple(r[:-1]): r[-1] for r in t.collect()} for t in model.backoff]
    words = [w for (w,) in p[0]]

    def chance(context, w):
        if not context:
            return p[0].get((w,), model.unknown)
        got = p[len(context)].get((*context, w))
        return got if got is not None else b[len(context)].get(tuple(context), 1.0) * chance(context[1:], w)

    for context in [*list(b[2])[:6], ("=the", "=nothing"), ("<", "<"), ("=no", "=no")]:
        assert math.isclose(sum(chance(context, w) for w in [*words, "=unknown"]), 1, rel_tol=1e-9), context
    text = "the of unseen and to in"
    line = ["<", "<", *[f"={w}" for w in text.split()], ">"]
    want = sum(math.log10(chance(tuple(line[i : i + 2]), line[i + 2])) for i in range(len(line) - 2))
    got = katz_tables.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert math.isclose(got["score"], want, rel_tol=1e-9) and got["n_tokens"] == 7


def test_no_training_documents(spark):
    d = spark.createDataFrame(ROWS[:3], "doc_id long, text string")
    model = katz_tables.train(d.limit(0), 2)
    assert [r["score"] for r in katz_tables.score(d, model).collect()] == [0.0] * 3 and katz_tables.score(d.limit(0), model).count() == 0
