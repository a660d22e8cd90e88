"""Languages of documents as a mixture, by expectation-maximisation over words.

A language model is the smoothed frequency of letter triples inside words (triples are hashed
to GRAMS slots, fewer where so many languages are known that MODEL_CELLS would be passed). Each
word of a document comes from one language; expectation-maximisation finds the proportions that
make the document's words likeliest. Sets of the leading one, two, ... languages, SET_SIZE at
most, compete by their likelihood less half the logarithm of the word count for each language
after the first. With more than AT_ONCE languages a document's mixture is sought among the
AT_ONCE whose models give its whole text the highest likelihood.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if
no training row has a language. Ties go to the first language by name. Repeated rows get a row
each; a null id counts as held out. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import gathered
from lendscope.llm.shared import PIECE, held_out, owners, shared_dir, stored, text_bytes

GRAMS = 1 << 16
SMOOTHING = 0.5
#: Languages that a document's set may hold, and that a mixture is sought among.
SET_SIZE, AT_ONCE = 4, 32
#: Slots times languages of a model at most; it is sent to the driver and to all tasks.
MODEL_CELLS = 1 << 22
ROUNDS, CHANGE = 30, 1e-3
SLICE = 1_000_000
#: Words that are worked on at once.
PIECE_WORDS = 1 << 18
UNKNOWN = "und"

#: 0 apart from letters, 1 to 26 for ASCII letters of either case, then bytes from 128 on.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)
LATIN = (CLASS > 0) & (CLASS < 27)


def letters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, and of the bytes before and after it in its text."""
    kind = CLASS[raw]
    if len(raw) > 1:  # capital Latin-1 letters
        fold = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        kind[fold] = CLASS[raw[fold] + 0x20]
    left, right = np.zeros_like(kind), np.zeros_like(kind)
    left[1:], right[:-1] = kind[:-1], kind[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    left[inner] = 0
    right[inner - 1] = 0
    return kind, left, right


def grams(kind: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Of letters(): for each letter byte the slot of the triple around it, its place, and whether a word starts
    there; a piece of PIECE bytes at a time."""
    for a in range(0, len(kind), PIECE):
        own = slice(a, a + PIECE)
        at = np.flatnonzero(kind[own])
        before = left[own][at]
        code = (before.astype(np.int64) * 155 + kind[own][at]) * 155 + right[own][at]
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        yield slot.astype(np.int64), at + a, before == 0


def word_chances(raw: np.ndarray, off: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of each word by each language (words x languages; the best one's is 1), and words of each text."""
    shrink = GRAMS // len(model)
    around = letters(raw, off)
    starts = np.flatnonzero((around[0] > 0) & (around[1] == 0))
    words = np.diff(np.searchsorted(starts, off))
    likely, n = np.zeros((len(starts), model.shape[1])), 0
    del starts
    for slot, at, new in grams(*around):
        if len(at) == 0:
            continue
        cuts = np.flatnonzero(new)
        if not new[0]:  # the rest of a word that the last piece began
            cuts = np.concatenate([np.zeros(1, np.int64), cuts])
        own = np.add.reduceat(model[slot // shrink], cuts, axis=0)
        if not new[0]:
            likely[n - 1] += own[0]
            own = own[1:]
        likely[n : n + len(own)] = own
        n += len(own)
    for a in range(0, len(likely), PIECE_WORDS):
        part = likely[a : a + PIECE_WORDS]
        part -= part.max(axis=1, keepdims=True)
        np.exp(part, out=part)
    return likely, words


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, slot, n over all of docs (lang, text)."""

    def count(batches):
        import pyarrow as pa

        def rows(name, slots, n):
            return pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(slots), pa.string()), "slot": pa.array(slots), "n": pa.array(n)})

        sums: dict[str, np.ndarray] = {}
        for table in gathered(batches, most=SLICE):
            raw, off = text_bytes(table["text"])
            names, number = np.unique(np.array(table["lang"].to_pylist()), return_inverse=True)
            for slot, at, _ in grams(*letters(raw, off)):
                if len(at) == 0:
                    continue
                first, own = owners(off, at[0], at[-1] + 1)
                codes = number[first + own[at - at[0]]] * GRAMS + slot
                if len(names) > AT_ONCE:  # too many for tables: what occurs
                    codes, n = np.unique(codes, return_counts=True)
                    cuts = np.searchsorted(codes, np.arange(len(names) + 1) * GRAMS)
                    yield from (rows(name, codes[a:b] % GRAMS, n[a:b]) for name, a, b in zip(names.tolist(), cuts[:-1], cuts[1:], strict=True))
                    continue
                found = np.bincount(codes, minlength=len(names) * GRAMS).reshape(len(names), GRAMS)
                for name, own in zip(names.tolist(), found, strict=True):
                    sums[name] = sums.get(name, 0) + own
            while len(sums) > AT_ONCE:
                name, own = sums.popitem()
                yield rows(name, np.flatnonzero(own), own[np.flatnonzero(own)])
        for name, own in sums.items():
            yield rows(name, np.flatnonzero(own), own[np.flatnonzero(own)])

    return docs.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names, and log probabilities (slots x names), from docs (lang, text)."""
    counts = gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"))
    counts = stored(counts, f"{shared_dir(docs.sparkSession)}/grams")
    languages = counts.select("lang").distinct().count()
    shift = 0
    while shift < 10 and (GRAMS >> shift) * languages > MODEL_CELLS:
        shift += 1
    counts = counts.groupBy("lang", F.shiftright("slot", shift).alias("slot")).agg(F.sum("n").alias("n")).toPandas()
    names, slots = sorted(counts["lang"].unique()), GRAMS >> shift
    table = np.zeros((slots, len(names)))
    table[counts["slot"].to_numpy(np.int64), np.searchsorted(names, counts["lang"].to_numpy())] = counts["n"].to_numpy()
    return names, np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * slots)).astype(np.float32)


def _weighed(likely: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray):
    """likely times the share of each word's document, where documents start in it, and which they are; in pieces."""
    for a in range(0, len(likely), PIECE_WORDS):
        b = min(a + PIECE_WORDS, len(likely))
        first, last = np.searchsorted(starts, [a, b - 1], side="right") - 1
        of = slice(first, last + 1)
        begin = np.maximum(starts[of], a)
        held = np.minimum(starts[of] + sizes[of], b) - begin
        yield likely[a:b] * np.repeat(share[of], held, axis=0), begin - a, of


def mixture(likely: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document (from share on), and log likelihoods, for word likelihoods
    (words x languages) of documents that start and have sizes (one at least) as told."""
    for _ in range(ROUNDS):
        after = np.zeros_like(share)
        for part, begin, of in _weighed(likely, starts, sizes, share):
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            after[of] += np.add.reduceat(part, begin, axis=0)
        after /= sizes[:, None]
        moved = np.abs(after - share).max()
        share = after
        if moved < CHANGE:
            break
    chance = np.zeros(len(sizes))
    for part, begin, of in _weighed(likely, starts, sizes, share):
        chance[of] += np.add.reduceat(np.log(np.maximum(part.sum(axis=1), 1e-300)), begin)
    return share, chance


def mixtures(raw: np.ndarray, off: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Proportions of the chosen language set of each text (texts x languages); zeros without letters."""
    if model.shape[1] > AT_ONCE:
        out = np.zeros((len(off) - 1, model.shape[1]))
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            own = np.array([0, b - a])
            times = sum((np.bincount(slot // (GRAMS // len(model)), minlength=len(model)) for slot, _, _ in grams(*letters(raw[a:b], own))), np.zeros(len(model)))
            some = np.sort(np.argsort(-(times.astype(np.float32) @ model), kind="stable")[:AT_ONCE])
            out[i, some] = mixtures(raw[a:b], own, model[:, some])[0]
        return out
    out = np.zeros((len(off) - 1, model.shape[1]))
    if model.shape[1] == 0:
        return out
    likely, words = word_chances(raw, off, model)
    own = np.flatnonzero(words > 0)
    if len(own) == 0:
        return out
    sizes = words[own]
    begin = np.cumsum(sizes) - sizes
    n = model.shape[1]
    share, _ = mixture(likely, begin, sizes, np.full((len(own), n), 1 / n))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    best[np.arange(len(own)), order[:, 0]] = 1
    # A second language that no whole word is owed to can't pay for itself.
    open_ = np.flatnonzero(np.take_along_axis(share, order[:, 1:2], axis=1)[:, 0] * sizes >= 1) if n > 1 else np.zeros(0, int)
    if len(open_):
        part, size = likely, sizes[open_]
        if len(open_) < len(own):
            part = np.concatenate([likely[a : a + b] for a, b in zip(begin[open_].tolist(), size.tolist(), strict=True)])
        top = np.full(len(open_), -np.inf)
        for k in range(1, min(SET_SIZE, n) + 1):
            mask = np.zeros((len(open_), n))
            np.put_along_axis(mask, order[open_, :k], 1.0, axis=1)
            first = np.maximum(share[open_], 1e-6) * mask
            found, chance = mixture(part, np.cumsum(size) - size, size, first / first.sum(axis=1, keepdims=True))
            value = chance - 0.5 * (k - 1) * np.log(size)
            better = value > top
            top[better] = value[better]
            best[open_[better]] = found[better]
    out[own] = best
    return out


def shares(texts, model: np.ndarray) -> np.ndarray:
    """mixtures() of an Arrow column; zeros, too, where all bytes from 128 on are signs and no letters."""
    raw, off = text_bytes(texts)
    share = mixtures(raw, off, model)
    for i in np.flatnonzero(share.sum(axis=1) > 0).tolist():
        if not LATIN[raw[off[i] : off[i + 1]]].any() and not any(map(str.isalpha, texts[i].as_py())):
            share[i] = 0
    return share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages, shares of each row of docs (doc_id, text)."""
    names, table = model

    def run(batches):
        import pyarrow as pa

        for rows in gathered(batches, most=SLICE):
            share = shares(rows["text"], table)
            known = share.sum(axis=1) > 0
            first = share.argmax(axis=1) if names else np.zeros(len(share), int)
            sets = [np.flatnonzero(s).tolist() for s in share]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows["doc_id"].combine_chunks().cast(pa.int64()),
                    "lang_pred": pa.array([names[f] if k else UNKNOWN for f, k in zip(first.tolist(), known.tolist(), strict=True)], pa.string()),
                    "score": pa.array(np.minimum(share.max(axis=1, initial=0), 1.0)),
                    "languages": pa.array([[names[j] for j in s] for s in sets], pa.list_(pa.string())),
                    "shares": pa.array([share[i, s].tolist() for i, s in enumerate(sets)], pa.list_(pa.float64())),
                }
            )

    schema = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def language_mix(docs: DataFrame, mod: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out and identify()'s columns, learnt from rows whose remainder differs."""
    held = held_out(F.col("doc_id"), mod, remainder)
    found = identify(docs, fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages", "shares")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs whose leading language holds at least that share; those that are `und` go."""
    names, table = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))

    def run(batches):
        import pyarrow as pa

        for rows in gathered(batches, most=SLICE):
            keep = shares(rows["text"], table).max(axis=1, initial=0) >= least
            yield from rows.filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(run, docs.schema)
