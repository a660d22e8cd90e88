"""Many partitions, long runs and words, repeated rows, and many matches in one text."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import bpe_words, jaccard_join, packing, secret_scan
from lendscope.llm.shared import tokenizer_path

WORDS = "the of and to in is was for that with on be are by it this from at or an".split()
LONG = [(1, "a" + " " * 2_000_000 + "b"), (2, "hello" * 1_000_000), (3, "\n" * 300_000 + "　" * 200_000 + "x"), (4, "1" * 500_000 + "!" * 500_000), (5, " it's <|endoftext|> fine ")]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    tool.no_truncation()
    tool.no_padding()
    return {i: tool.encode(t, add_special_tokens=False).ids for i, t in LONG}


def test_long_runs_and_words(spark, whole, tmp_path):
    spark.createDataFrame(LONG, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    texts = dict(LONG)
    for r in bpe_words.digests(bpe_words.code_documents(docs)).collect():
        line = ",".join(map(str, whole[r["doc_id"]]))
        assert r["n_tokens"] == len(whole[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    ends = {i: np.append(ids, 0).astype("<u4") for i, ids in whole.items()}
    pieces = packing.digests(packing.pack_documents(docs)).collect()
    for r in pieces:
        part = ends[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ends[r["doc_id"]])
    assert sum(r["length"] for r in pieces) == sum(map(len, ends.values()))


def test_more_partitions_than_numbers_once_had_room_for(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    docs.repartition(200, "doc_id").write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))  # a partition a file
    try:
        stored = spark.read.parquet(f"{tmp_path}/docs")
        assert stored.rdd.getNumPartitions() > 128
        coded = bpe_words.code_documents(stored)
        assert coded.select("row").distinct().count() == 400
        again = bpe_words.decode(coded.select("doc_id", "ids").repartition(200, "doc_id"))
        assert again.select("row").distinct().count() == 400
        assert again.join(docs, ["doc_id", "text"]).count() == 400
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_row_numbers_differ_and_say_when_they_cannot():
    last = (2**23 - 1 << 32) + 2**23 - 1
    assert bpe_words.row_numbers(last, 1 << 17)[-1] == 2**63 - 1
    assert bpe_words.row_numbers(1 << 32, 1)[0] > bpe_words.row_numbers(2**23 - 1, 1 << 17)[-1]
    with pytest.raises(ValueError):
        bpe_words.row_numbers(0, (1 << 17) + 1)


def test_a_repeated_row_is_shingled_once(spark):
    rng = np.random.default_rng(8)
    text = " ".join(rng.choice(WORDS, 200).tolist())
    rows = [(1, text, i) for i in range(4000)] + [(2, text + " and more", 0), (3, None, 0), (4, " ", 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(8, "place")
    payload = jaccard_join.with_shingles(docs.where("text IS NOT NULL").select("text"))
    assert payload.count() == 3  # two texts and the set without words
    found = jaccard_join.near_documents(docs).groupBy("doc_id", "class_id", "n_links", "kept").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 4000, True, 4000), (2, 1, 4000, False, 1), (3, 3, 0, True, 2), (4, 4, 0, True, 1)]


def test_secrets_in_linear_time(spark):
    line = "0123456789abcdef0123456789abcdef0123 "
    docs = lambda n: spark.createDataFrame([(1, line * n + "password: abcdefgh")], "doc_id long, text string")
    secret_scan.report(secret_scan.secret_scan(docs(10))).collect()
    began = time.perf_counter()
    found = secret_scan.report(secret_scan.secret_scan(docs(64_000))).first()
    assert time.perf_counter() - began < 60
    assert found["n_hex"] == 64_000 and found["n_assign"] == 1
    spans = found["spans"].split(",")
    assert spans[0] == "hex:0:36" and spans[63_999] == f"hex:{37 * 63_999}:{37 * 63_999 + 36}" and spans[-1].startswith(f"assign:{37 * 64_000}:")
