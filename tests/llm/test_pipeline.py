"""The corpus pipeline against brute force, on small tables."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lendscope.llm import exact_dedup, jaccard_join, language_mix, queries, secret_scan, shared
from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, hits int, kept_sha string, Stays int, `class` string"


def near(base, n):
    words = base.split()
    words[n] = f"other{n}"
    return " ".join(words)


A, B, C = prose(300, 1), prose(200, 2), prose(150, 3)
SECRET = prose(60, 9) + " password = abcdefgh12345678 " + prose(60, 8)
TEXTS = [
    (1, A), (5, near(A, 100)), (5, B), (7, C), (7, C), (8, C.replace(" ", "  ")), (9, None), (10, ""), (11, "12 345 — ..."), (None, prose(90, 4)), (None, near(prose(90, 4), 40)),
    (12, SECRET), (13, near(SECRET, 3)), (14, prose(120, 6)), (-(2**63), prose(80, 7)), (20, prose(80, 7)), (21, "x " * 3000), (22, near(near(A, 20), 200)),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or ""), "a", k, "b", k, "c") for k, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    return place


def exact_by_hand(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    best = {}
    for i, t in rows:
        key = (-len(t or ""), i is None, i or 0)
        if plain(t) not in best or key < best[plain(t)][0]:
            best[plain(t)] = (key, (i, t))
    return sorted((x for _, x in best.values()), key=str)


def near_by_hand(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    out = []
    for r in set(root):
        own = [rows[i] for i in range(len(rows)) if root[i] == r]
        out.append(min(own, key=lambda x: (x[0] is None, x[0] or 0)))
    return sorted(out, key=str)


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_stages_equal_brute_force(spark, table):
    docs = shared.load(spark, table, "documents")
    rows = [(i, t) for i, t in TEXTS if re.search("[a-z]", t or "")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, table), f"{shared.shared_dir(spark)}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_sha256", "hits", "kept_sha", "Stays", "class"]
        if name == "exact_copies":
            rows = exact_by_hand(rows)
        elif name == "near_copies":
            rows = near_by_hand(rows)
        elif name == "secrets":
            rows = [(i, re.sub(r"password = \w+", "<assign>", t)) for i, t in rows]
        assert pairs(docs) == sorted(rows, key=str), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    kept = [(i, t) for i, t in rows]
    assert (5, B) in kept and (1, A) in kept and not any(i == 5 and t != B for i, t in kept) and sum(i == 7 for i, _ in kept) == 0


def test_run_packs_every_kept_document(spark, table):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(shared.tokenizer_path())
    wanted = near_by_hand(exact_by_hand([(i, t) for i, t in TEXTS if re.search("[a-z]", t or "")]))
    ids = sorted([*tool.encode(re.sub(r"password = \w+", "<assign>", t), add_special_tokens=False).ids, 0] for _, t in wanted)
    windows = {}
    for r in corpus_pipeline.run(spark, table).collect():
        windows.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["tokens"], "<u4").tolist()))
    assert sorted([i for _, part in sorted(own) for i in part] for own in windows.values()) == ids


def test_run_of_an_empty_table(spark, table, tmp_path):
    shared.load(spark, table, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_ids(spark):
    rows = [(1, A), (5, near(A, 100)), (5, prose(70, 30)), (7, C), (7, C), (None, near(C, 70))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(jaccard_join.one_of_each(d)) == sorted([(1, A), (5, prose(70, 30)), (7, C)], key=str)
    assert pairs(exact_dedup.drop_copies(d)) == sorted(set(rows), key=str)


def test_near_copies_without_ids_are_linked(spark):
    d = spark.createDataFrame([(None, A), (None, near(A, 100)), (None, B)], "doc_id long, text string")
    assert sorted(r["n_links"] for r in jaccard_join.near_documents(d).collect()) == [0, 1, 1]


def test_ids_of_sets_that_clash_are_told(spark, monkeypatch):
    real = jaccard_join.set_ids
    monkeypatch.setattr(jaccard_join, "set_ids", lambda sets, salt=0: real(sets, salt) % 2 if salt == 0 else real(sets, salt))
    d = spark.createDataFrame([(1, A), (2, near(A, 100)), (3, B), (4, C)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in jaccard_join.near_documents(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_least_doc_id_and_many_secrets(spark):
    d = spark.createDataFrame([(-(2**63), "a b"), (3, "ab"), (4, "zz")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(d).collect()} == {-(2**63): -(2**63), 3: -(2**63), 4: 4}
    many = " ".join(f"token = abcdefgh{i:06d}" for i in range(1000))
    row = secret_scan.report(secret_scan.secret_scan(spark.createDataFrame([(1, many)], "doc_id long, text string"))).first()
    spans = [tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(",")]
    assert spans == [m.span() for m in re.finditer(r"token = \w+", many)] and row["n_assign"] == 1000


def test_many_short_texts_stay_in_bounded_blocks(spark):
    from lendscope.llm import blocks

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([""] * 150_000 + ["ab"] * 30_000)})
    sizes = [t.num_rows for t in blocks.gathered([batch], rows=40_000)]
    assert sum(sizes) == 180_000 and max(sizes) <= 40_000


def test_languages_of_mixtures_by_brute_force():
    """EM's proportions are the likeliest ones: no proportion on a fine grid is likelier."""
    rng = np.random.default_rng(2)
    likely = rng.random((200, 2)) ** 3 + 1e-6
    share, chance = language_mix.mixture(likely, np.array([0]), np.array([200]), np.full((1, 2), 0.5))
    grid = np.linspace(0.001, 0.999, 999)
    best = max(float(np.log(likely @ np.array([g, 1 - g])).sum()) for g in grid)
    assert chance[0] >= best - 0.01 and abs(share.sum() - 1) < 1e-9
