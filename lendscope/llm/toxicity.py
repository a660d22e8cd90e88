"""Toxicity of documents after noisy-channel deobfuscation.

A word with digits or marks among its letters, a letter repeated, or letters spaced one by one
is read as the output of a noisy channel. Its characters span a lattice: a look-alike stands for
the letters of LOOKS, a mark may be noise or part words, a run of a letter may stand for one or
two, a gap between spaced letters is nothing or parts words. Viterbi decoding under a character
model of the corpus (letter triples of plain words) restores the likeliest letters. Other words
have one path only and stay as they are.

The score reads restored words: each word weighs as its strongest feature (the word itself or
its first three to six letters), by a lower confidence bound of the feature's odds in toxic
against clean labelled documents; a logistic model over the strongest words of a document
gives 0 to 1. The character model counts all documents; the classifier is fitted on at most
SAMPLE labelled rows of each label value.

Defined cases: null text is empty; an empty text has the score of a document without any toxic
word. Without labelled rows of both values every score is 0. Repeated rows get a row each; a
null id counts as held out. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import gathered
from lendscope.llm.labelled import sample
from lendscope.llm.shared import SPACE, held_out, shared_dir, stored, text_bytes

SAMPLE = {1: 4_000, 0: 12_000}
LEAST_DOCS = 5
PREFIXES = (3, 4, 5, 6)
#: Width of the confidence bound, in standard errors.
CAUTION = 2.5
SLICE = 2_000_000
#: Words whose weight a task remembers.
REMEMBERED = 400_000

#: Letters that a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (negative log probabilities) of the channel.
SWAP, NOISE, DIGIT_NOISE, PART, DOUBLE, BREAK = 0.5, 2.0, 6.0, 5.0, 1.0, 2.0
#: Cost at most of a lone letter as a word, such as a, I or u; letters of a spaced word at most; and how much more than the likeliest reading of a spaced run another may cost.
LONE, LONGEST, NEAR = 6.0, 32, 12.0

#: Letters of the character model: 0 a word's edge, 1 to 26, 27 any other letter.
LETTERS = 28
EDGE = ".,;:!?\"'()[]{}<>"
DRESSED = re.compile(r"([^\w\s])\1{2,}")
RUN = re.compile(r"([^\W\d_])\1")
SPACED = re.compile(r"(?<!\S)(?:[^\W_][\s.\-_*]{1,2}){2,}[^\W_](?!\S)")
GAP = re.compile(r"[\s.\-_*]+")


def kind(c: str) -> int:
    n = ord(c) - 96
    return n if 1 <= n <= 26 else 27


def letter_counts(docs: DataFrame) -> DataFrame:
    """slot, n: letter triples in the words of all of docs (text), edges apart."""

    def count(batches):
        import pyarrow as pa

        table = np.full(256, -1, np.int64)
        table[97:123] = table[65:91] = np.arange(1, 27)
        table[128:192] = 0  # what follows in a character of several bytes
        table[192:] = 27
        total = np.zeros(LETTERS**3, np.int64)
        for rows in gathered(batches, most=SLICE):
            raw, off = text_bytes(rows["text"])
            if len(raw) == 0:
                continue
            code = table[raw]
            first = np.zeros(len(raw) + 1, bool)
            first[off] = True
            first = first[:-1]
            code[(code == -1) | SPACE[raw]] = -1
            keep = ~((raw >= 128) & (raw < 192))
            code, first = code[keep], first[keep]
            blank = code < 0
            line = np.zeros(2 * len(code) + 4, np.int64)  # each letter, and an edge wherever words part
            step = 1 + (first & ~blank)
            at = np.cumsum(step) + 1
            line[at] = np.where(blank, 0, code)
            line = line[: at[-1] + 3]
            here = line[2:]
            real = (here > 0) | (line[1:-1] > 0)
            two = np.where(line[1:-1] > 0, line[:-2], 0)
            total += np.bincount(((two * LETTERS + line[1:-1]) * LETTERS + here)[real], minlength=LETTERS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some), "n": pa.array(total[some])})

    return docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def letter_costs(counts: DataFrame) -> np.ndarray:
    """Cost of a letter after two others, mixed with its costs after one and none; at most
    LETTERS**3 counts reach the driver."""
    rows = counts.toPandas()
    n = np.zeros(LETTERS**3)
    n[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy()
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    one = n.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = n.sum(axis=0)
    two = (two + 50 * one) / (two.sum(axis=1, keepdims=True) + 50)
    three = (n + 50 * two[None]) / (n.sum(axis=2, keepdims=True) + 50)
    return -np.log(three)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each step the strings that it may stand for, with their costs."""
    steps, i = [], 0
    while i < len(word):
        c, j = word[i], i + 1
        while j < len(word) and word[j] == c:
            j += 1
        letters = c if c.isalpha() else LOOKS.get(c, "")
        price = 0.0 if c.isalpha() else SWAP
        options = [(x, price) for x in letters]
        if j - i > 1:
            options += [(x * 2, price + (DOUBLE if j - i > 2 else 0.0)) for x in letters]
            if c.isalpha() and j - i == 2:
                options = [(c * 2, 0.0), (c, 2 * DOUBLE)]
        if not c.isalpha():
            options += [("", (DIGIT_NOISE if c.isdigit() else NOISE) * (j - i)), (" ", PART)]
        steps.append(options)
        i = j
    return steps


def follow(ways: dict, options: list[tuple[str, float]], costs: np.ndarray) -> dict:
    """The cheapest way to each pair of last letters, one step on; ways hold a cost and a text."""
    after: dict[tuple[int, int], tuple[float, str]] = {}
    for (a, b), (cost, text) in ways.items():
        for string, price in options:
            x, y, total = a, b, cost + price
            for c in string:
                k = 0 if c == " " else kind(c)
                if k == 0 and y == 0:
                    continue
                total += costs[x, y, k]
                x, y = (0, 0) if k == 0 else (y, k)
            if (x, y) not in after or total < after[x, y][0]:
                after[x, y] = (total, text + string)
    return after


def ending(ways: dict, costs: np.ndarray) -> tuple[float, str]:
    return min((cost + (costs[a, b, 0] if b else 0.0), text) for (a, b), (cost, text) in ways.items())


def restore(word: str, costs: np.ndarray) -> str:
    """The likeliest reading of a word."""
    ways = {(0, 0): (0.0, "")}
    for options in lattice(word):
        ways = follow(ways, options, costs)
    return ending(ways, costs)[1]


def spaced_words(run: str, costs: np.ndarray) -> list[tuple[float, str]]:
    """Words of the readings of a run of spaced letters, and by how much the reading exceeds the
    likeliest one, up to NEAR. A blank between letters is nothing or parts words, two rather part
    them. Words meet at edges only, so each of up to LONGEST letters is decoded once."""
    letters = [lattice(c) for c in run if c != " "]
    gaps = [len(g) for g in re.findall(" +", run)]
    part = [0.0, *(BREAK if g == 1 else 0.0 for g in gaps)]
    join = [0.0, *(0.0 if g == 1 else 2 * BREAK for g in gaps)]
    n = len(letters)
    words = []  # start, end, cost, text
    for i in range(n):
        ways, price = {(0, 0): (0.0, "")}, part[i]
        for j in range(i, min(n, i + LONGEST)):
            price += join[j] if j > i else 0.0
            ways = follow(ways, letters[j][0], costs)
            cost, text = ending(ways, costs)
            words.append((i, j + 1, min(cost, LONE if i == j else cost) + price, text))
    before, after = [0.0] + [np.inf] * n, [np.inf] * n + [0.0]
    for i, j, cost, _ in words:
        before[j] = min(before[j], before[i] + cost)
    for i, j, cost, _ in reversed(words):
        after[i] = min(after[i], cost + after[j])
    ranked = [(before[i] + cost + after[j] - before[n], text) for i, j, cost, text in words]
    return [(more, w) for more, text in ranked if more <= NEAR for w in text.split()]


def readings(word: str, costs: np.ndarray) -> list[str]:
    """Words to score for a word of a lowered text: itself without edges, and restored words."""
    bare = DRESSED.sub("", word).strip(EDGE)
    if bare.isalpha() and not RUN.search(bare):
        return [bare]
    marks = word.strip(".,;:?\"'")
    if not any(c.isalpha() for c in marks) and not any(c in LOOKS for c in marks):
        return [bare]
    return [bare, *restore(bare, costs).split(), *(restore(marks, costs).split() if marks != bare else [])]


def words_of(text: str) -> set[str]:
    """Distinct words of a text, lowered, with letters that stand one by one put together, and also
    with a blank at each gap, two at a gap of two."""
    low = text.lower()
    found = set(low.split())
    if any(len(w) > 2 and not w.isalpha() for w in found) or sum(len(w.strip(EDGE)) == 1 for w in found) >= 2:
        for m in SPACED.finditer(low):
            found.add("".join(c for c in m[0] if c.isalnum()))
            found.add(GAP.sub(lambda g: " " * min(len(g[0]), 2), m[0]))
    return found


def word_features(word: str, prefixes: tuple[int, ...] = PREFIXES) -> list[str]:
    return [f"{word[:n]}*" for n in prefixes if len(word) >= n] + [f"={word}"]


def features_of(word: str, costs: np.ndarray) -> list[str]:
    """Features of all readings of a word of words_of. In spaced letters a less likely reading has none
    of the short beginnings, which other words have inside."""
    if " " in word:
        return [f for more, w in spaced_words(word, costs) for f in word_features(w, PREFIXES if more < 1e-6 else PREFIXES[2:])]
    return [f for w in readings(word, costs) for f in word_features(w)]


class Weights:
    """Weight of a word by its strongest feature."""

    def __init__(self, weights: dict[str, float], costs: np.ndarray):
        self.weights, self.costs = weights, costs
        self.known: dict[str, float] = {}

    def of(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = max((self.weights.get(f, 0.0) for f in features_of(word, self.costs)), default=0.0)
            self.known[word] = got
        return got

    def document(self, text: str) -> list[float]:
        """Its strongest and second strongest words, and how many strong ones it has."""
        strong = sorted((x for x in map(self.of, words_of(text)) if x > 0), reverse=True)
        first = strong[0] if strong else 0.0
        return [first, strong[1] if len(strong) > 1 else 0.0, float(np.log1p(sum(x >= 2 for x in strong))), first * first / 4]


def feature_documents(docs: DataFrame, costs: np.ndarray, only: set[str] | None) -> DataFrame:
    """feature, n: how many documents of docs have it; of all features or only those named."""

    def run(batches):
        import pyarrow as pa

        total: dict[str, int] = {}
        known: dict[str, list[str]] = {}
        for rows in gathered(batches, most=SLICE):
            for text in rows["text"].to_pylist():
                own: set[str] = set()
                for word in words_of(text or ""):
                    got = known.get(word)
                    if got is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        got = [f for f in features_of(word, costs) if only is None or f in only]
                        known[word] = got
                    own.update(got)
                for f in own:
                    total[f] = total.get(f, 0) + 1
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return docs.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


class Model:
    """Weights of words and of the document's strongest words."""

    def __init__(self, weights: dict[str, float], costs: np.ndarray):
        self.weights, self.costs = weights, costs
        self.line = np.zeros(5)

    def fit_line(self, x: np.ndarray, label: np.ndarray) -> None:
        z = np.column_stack([np.ones(len(x)), x])
        w = np.zeros(z.shape[1])
        for _ in range(50):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - label) + 1e-2 * w
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), slope)
        self.line = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.line, -30, 30)))


def described(docs: DataFrame, weights: dict[str, float], costs: np.ndarray, also: str, kind_: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        tool = Weights(weights, costs)
        for rows in gathered(batches, most=SLICE):
            x = [tool.document(t or "") for t in rows["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({also: rows[also].combine_chunks(), "x": pa.array(x, pa.list_(pa.float64()))})

    return docs.select(also, "text").mapInArrow(run, f"{also} {kind_}, x array<double>")


def feature_weights(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Lower bounds of log odds, of features where they are above zero."""
    out = {}
    for feature, t in toxic.items():
        c = clean.get(feature, 0) * n_toxic / n_clean
        n, z = t + c, CAUTION
        p = t / n
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if low > 0.5:
            out[feature] = float(np.log(low / (1 - low)))
    return telling(out)


def telling(weights: dict[str, float]) -> dict[str, float]:
    """weights less each first few letters that tell less than some longer feature does: they
    owe their weight to that one, and begin clean words as well."""
    best: dict[str, float] = {}
    for feature, weight in weights.items():
        word = feature[1:] if feature[0] == "=" else feature[:-1]
        for n in PREFIXES:
            if n < len(word) or n == len(word) and feature[0] == "=":
                best[word[:n]] = max(best.get(word[:n], 0.0), weight)
    return {f: w for f, w in weights.items() if f[0] == "=" or w >= best.get(f[:-1], 0.0)}


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2) -> Model | None:
    spark = docs.sparkSession
    costs = letter_costs(letter_counts(docs.select(F.coalesce("text", F.lit("")).alias("text"))))
    given = stored(sample(docs, labels, "toxic", SAMPLE, mod, remainder), f"{shared_dir(spark)}/sample")
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    counted = lambda rows: {r["feature"]: r["n"] for r in rows.toLocalIterator()}  # noqa: E731  features of a bounded sample
    toxic = counted(feature_documents(given.where("label = 1"), costs, None).where(F.col("n") >= LEAST_DOCS))
    clean = counted(feature_documents(given.where("label = 0"), costs, set(toxic)))
    model = Model(feature_weights(toxic, clean, sizes[1], sizes[0]), costs)
    found = described(given, model.weights, costs, "label", "int").toPandas()
    model.fit_line(np.array(found["x"].tolist()), found["label"].to_numpy(float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, learnt from rows whose remainder differs."""
    model = fit(docs, labels, mod, remainder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        tool = model and Weights(model.weights, model.costs)
        for table in gathered(batches, most=SLICE):
            if model is None:
                score = np.zeros(len(table))
            else:
                score = model.score(np.array([tool.document(t) for t in table["text"].to_pylist()]))
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks().cast(pa.int64()), "score": pa.array(score)})

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
