"""Document quality by Bradley-Terry ranking of labelled pairs.

Each pair of a good and a bad training document says that the good one wins; the score of a
document is linear in its features, and logistic loss on feature differences fits the weights.
A threshold at the quantile of training scores that the share of bad documents gives, and a
scale, turn scores into 0 to 1.

The features describe the whole text: how often each triple of character shapes occurs, and
sizes, repetition and line statistics. The fit sees at most SAMPLE labelled rows; all
documents are scored.

Defined cases: null text is empty; an empty text has a score like any other. With no labelled
training pair every score is 0.5. Repeated rows get a row each; a null id counts as held out.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import gathered
from lendscope.llm.labelled import sample
from lendscope.llm.shared import PIECE, held_out, owners, text_bytes, word_hashes

SAMPLE = 10_000
PAIRS_EACH, STEPS, RATE, DECAY = 40, 250, 0.05, 1e-3
#: Bytes of text and rows whose features are told at once (some 30 MB of features).
SLICE, SLICE_ROWS = 2_000_000, 1_000

#: Shapes: line ends, other blanks, small and capital letters, digits, single marks, rest.
SHAPES = 14
SHAPE = np.full(256, 12, np.int64)
SHAPE[[10, 13]] = 0
SHAPE[[9, 11, 12, 32]] = 1
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58] = 2, 3, 4
for _place, _marks in enumerate((".", ",;:", "!?", "|", "\"'()-", "#$%&*@", "<>/\\_=+{}[]"), 5):
    SHAPE[[ord(m) for m in _marks]] = _place
SHAPE[128:] = 13
PLAIN = 11


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of PLAIN + SHAPES ** 3 features; shapes are counted in pieces of PIECE bytes."""
    n = len(off) - 1
    size = np.diff(off)
    found = np.zeros((n, SHAPES**3), np.int64)
    shapes = np.zeros((n, SHAPES), np.int64)
    lines = np.ones(n, np.int64)
    for a in range(0, len(raw), PIECE):
        shape = SHAPE[raw[a : a + PIECE + 2]]
        m = min(PIECE, len(raw) - a)
        first, doc = owners(off, a, a + len(shape))
        rows = int(doc[-1]) + 1
        own = slice(first, first + rows)
        triple = (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:]
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        found[own] += np.bincount(doc[inside] * SHAPES**3 + triple[inside], minlength=rows * SHAPES**3).reshape(rows, -1)
        shapes[own] += np.bincount(doc[:m] * SHAPES + shape[:m], minlength=rows * SHAPES).reshape(rows, -1)
        lines[own] += np.bincount(doc[:m][raw[a : a + m] == 10], minlength=rows)
    safe = np.maximum(size, 1)
    out = np.zeros((n, PLAIN + SHAPES**3), np.float32)
    out[:, PLAIN:] = np.sqrt(found / safe[:, None])
    words, sizes = word_hashes(raw, off)
    out[:, 0] = np.log1p(size)
    out[:, 1] = np.log1p(sizes)
    out[:, 2] = np.log1p(size / np.maximum(sizes, 1))
    out[:, 3] = np.log1p(size / lines)
    for j, wanted in enumerate(((3,), (4,), (5, 6, 7), (8, 9, 10, 11)), 4):
        out[:, j] = shapes[:, wanted].sum(axis=1) / safe
    at = 0
    for i, m in enumerate(sizes.tolist()):
        own = words[at : at + m]
        at += m
        if m:
            _, times = np.unique(own, return_counts=True)
            out[i, 8] = len(times) / m
            out[i, 9] = times.max() / m
            out[i, 10] = np.sqrt((own[1:] == own[:-1]).mean()) if m > 1 else 0
    return out


class Model:
    """Weights by pairs of good and bad rows of x (which is scaled in place), a threshold and a scale."""

    def __init__(self, x: np.ndarray, label: np.ndarray, bad_share: float):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + np.float32(1e-2)
        x -= self.mean
        x /= self.spread
        z = x
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        rng = np.random.default_rng(5)
        lower = np.repeat(bad, PAIRS_EACH)
        upper = rng.choice(good, len(lower))
        w = np.zeros(x.shape[1], np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            s = z @ w
            pull = 1 / (1 + np.exp(np.clip(s[upper] - s[lower], -30, 30))) / len(lower)
            by_doc = np.bincount(upper, pull, len(x)) - np.bincount(lower, pull, len(x))
            slope = DECAY * w - by_doc.astype(np.float32) @ z
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope * slope
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.w = w
        s = z @ w
        self.cut = float(np.quantile(s, bad_share))
        odds = lambda scale: np.log1p(np.exp(-np.clip((s - self.cut) * scale * np.where(label == 1, 1, -1), -30, 30))).mean()
        self.scale = min((0.1, 0.2, 0.5, 1.0, 2.0, 4.0), key=odds)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.spread) @ self.w
        return 1 / (1 + np.exp(-np.clip((s - self.cut) * self.scale, -30, 30)))


def described(rows, *also: str):
    import pyarrow as pa

    def run(batches):
        for table in gathered(batches, most=SLICE, rows=SLICE_ROWS):
            x = features(*text_bytes(table["text"]))
            yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x], pa.binary())} | {c: table[c].combine_chunks() for c in also})

    return rows.mapInArrow(run, "x binary" + "".join(f", {c} int" for c in also))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, remainder: int = 1) -> Model | None:
    found = described(sample(docs, labels, "quality", {None: SAMPLE}, mod, remainder).select("text", "label"), "label").toPandas()
    label = found["label"].to_numpy()
    if not (label == 1).any() or not (label == 0).any():
        return None
    x = np.empty((len(label), PLAIN + SHAPES**3), np.float32)
    for i, row in enumerate(found.pop("x")):
        x[i] = np.frombuffer(row, np.float32)
    return Model(x, label, float((label == 0).mean()))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for table in gathered(batches, most=SLICE, rows=SLICE_ROWS):
            score = np.full(len(table), 0.5) if model is None else model.score(features(*text_bytes(table["text"]))).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks().cast(pa.int64()), "score": pa.array(score)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, remainder: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, learnt from rows whose remainder differs."""
    scored = score_documents(docs, fit(docs, labels, mod, remainder))
    return scored.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
