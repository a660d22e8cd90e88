"""Katz backoff over word pairs.

Tokens are words (white space apart, A-Z lowered) and one end mark a text; the first token's
context is a begin mark. Words are known by 64-bit hashes. The model over V+1 types (the
training types and one unknown type):

- P(w) = d(c) c / N for a trained word; what the discounts d leave is the unknown type's.
- P(w|v) = d(c(vw)) c(vw) / c(v) where the pair was trained, else b(v) P(w), where
  b(v) = (1 - sum of the former over v's followers) / (1 - sum of P over v's followers),
  so each context sums to one exactly. For an untrained context P(w|v) = P(w).

d is Good-Turing's discount for counts up to 5, from the counts of counts of the whole
training text; where those counts are too few or not falling, absolute discounting by
n1/(n1+2 n2) takes its place. Where nothing would be left, one is added to the denominator.

Counts cover all training rows. They are kept in tables partitioned by key: words by hash,
pairs by the hash of their first word, and a first word's followers over several parts in
proportion to its count, so that none grows with the corpus. Blocks of documents ask for what
they need and score their own texts. Blocks are made three times and must be the same each time
(a scan of files or a stored table gives them so): answers carry the sum of the keys that were
asked for, and a difference raises. Storing the blocks would pass the disk that is allowed.

Defined cases: null text is empty, an empty text is the end mark alone. A null id counts as
held out. With no training rows every token is unknown, with probability one. Repeated rows
count and are scored each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import blocks, counts_in, counts_out, from_bytes, part_of, planes, rising, unplanes, unrising
from lendscope.llm.shared import MIX1, give_back, giving_back, held_out, mix64, shared_dir, stored, text_bytes, word_hashes

END, BEGIN = np.uint64(0xE5D0E5D0E5D0E5D1), np.uint64(0xB361B361B361B363)
#: Counts above this keep their full weight.
LAST_DISCOUNTED = 5
#: Bytes of text in a block, and how many are hashed at once.
BLOCK_BYTES, SLICE = 9_000_000, 1_000_000
#: Parts of each table per shuffle partition at least, and bytes of text that a part is asked about at most.
SPREAD, PART_BYTES = 2, 40_000_000

ASKED = "part int, block long, payload array<binary>"
ANSWERED = "kind string, block long, part int, payload array<binary>, stats array<long>"


class Discounts:
    """d(c) for c up to LAST_DISCOUNTED, from counts of counts (index 1 on; the last one is for
    LAST_DISCOUNTED + 1)."""

    def __init__(self, of_counts: list[int]):
        n, k = of_counts, LAST_DISCOUNTED
        d = np.ones(k + 1)
        good = all(n[r] > 0 for r in range(1, k + 2))
        if good:
            cut = (k + 1) * n[k + 1] / n[1]
            d[1:] = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut < 1 else -1 for r in range(1, k + 1)]
        if not good or d[1:].min() <= 0 or d[1:].max() > 1:
            part = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] else 0.5
            d[1:] = [(r - part) / r for r in range(1, k + 1)]
        self.d = d

    def weight(self, counts: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.where(counts <= LAST_DISCOUNTED, self.d[np.minimum(counts, LAST_DISCOUNTED)], 1.0) * counts


class Unigrams:
    """P(w) by the word's count."""

    def __init__(self, total: int, types: int, of_counts: list[int]):
        self.total, self.types, self.discounts = total, types, Discounts(of_counts)
        left = sum((1 - self.discounts.d[r]) * r * of_counts[r] for r in range(1, LAST_DISCOUNTED + 1))
        extra = 0 if left > 0 or total == 0 else 1
        self.below = total + extra
        self.unknown = (left + extra) / self.below if self.below else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.weight(counts) / max(self.below, 1), self.unknown)


class Tokens:
    """Token stream of a block: hash, local number (index into distinct) and document of each."""

    def __init__(self, payload: bytes):
        table = from_bytes(payload)
        raw, off = text_bytes(table["text"])
        self.doc_id = table["doc_id"]
        self.held = np.asarray(table["held_out"].to_pylist(), bool)
        hashes, sizes = [], []
        start, n = 0, len(off) - 1
        while start < n:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + SLICE, side="right")) - 1)
            h, size = word_hashes(raw[off[start] : off[stop]], off[start : stop + 1] - off[start])
            hashes.append(h)
            sizes.append(size)
            start = stop
        words = np.concatenate(hashes)
        self.sizes = np.concatenate(sizes) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        stream = np.full(int(self.sizes.sum()), END, np.uint64)
        inner = np.ones(len(stream), bool)
        inner[self.starts + self.sizes - 1] = False
        stream[inner] = words
        self.distinct, self.local = np.unique(stream, return_inverse=True)
        self.train = np.repeat(~self.held, self.sizes)

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.local[self.train], minlength=len(self.distinct))

    def sections(self, parts: int):
        """(part, slice of distinct) for each part that has words of this block."""
        part = part_of(self.distinct, parts)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        return [(int(part[a]), slice(a, b)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) as local numbers, BEGIN being len(distinct); the pair of each
        token; training counts."""
        n = len(self.distinct)
        context = np.empty(len(self.local), np.int64)
        context[1:] = self.local[:-1]
        context[self.starts] = n
        distinct, pair = np.unique(context * n + self.local, return_inverse=True)
        return distinct // n, distinct % n, pair, np.bincount(pair[self.train], minlength=len(distinct))


DIFFERS = "a block differs from the one whose words were counted: docs must be repeatable, so store them first"


def mark(keys: np.ndarray) -> bytes:
    """Tells whether keys are those that were asked for."""
    return np.array([len(keys), mix64(keys).sum(dtype=np.uint64)], np.uint64).tobytes()


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, LAST_DISCOUNTED + 2), minlength=LAST_DISCOUNTED + 3)[: LAST_DISCOUNTED + 2].tolist()


def ask_words(parts: int):
    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                tokens = Tokens(row["payload"])
                counts = tokens.train_counts()
                for part, some in tokens.sections(parts):
                    yield _row(pa, part=part, block=row["block"], payload=[rising(tokens.distinct[some]), counts_in(counts[some])])
                del tokens
        give_back()

    return ask


def _row(pa, **values):
    kinds = {"part": pa.int32(), "block": pa.int64(), "payload": pa.list_(pa.binary()), "kind": pa.string(), "stats": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds[k]) for k, v in values.items()})


def answer_words(group):
    """Total count of each word that a block asked for; the part's sizes and counts of counts."""
    import pyarrow as pa

    asked = [(b, unrising(p[0]), counts_out(p[1])) for b, p in zip(group["block"].to_pylist(), group["payload"].to_pylist(), strict=True)]
    keys, place = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate([c for *_, c in asked]), minlength=len(keys)).astype(np.int64)
    part = group["part"][0].as_py()
    stats = [int(totals.sum()), int((totals > 0).sum()), *_of_counts(totals)]
    out = [_row(pa, kind="stats", block=-1, part=part, payload=[], stats=stats)]
    at = 0
    for block, own, _ in asked:
        out.append(_row(pa, kind="words", block=block, part=part, payload=[counts_in(totals[place[at : at + len(own)]]), mark(own)], stats=[]))
        at += len(own)
    return pa.Table.from_batches(out)


def known_counts(tokens: Tokens, parts: int, answers: dict) -> np.ndarray:
    """Training count of each of the block's distinct words."""
    found = np.zeros(len(tokens.distinct), np.int64)
    for part, some in tokens.sections(parts):
        got = answers.get(("words", part), (b"", b""))
        if got[1] != mark(tokens.distinct[some]):
            raise ValueError(DIFFERS)
        found[some] = counts_out(got[0])
    return found


class Contexts:
    """A block's trained contexts and pairs, dealt to the parts of the pair table."""

    def __init__(self, tokens: Tokens, counts: np.ndarray, parts: int, total: int):
        n = len(tokens.distinct)
        end = np.searchsorted(tokens.distinct, END)
        self.hashes = np.append(tokens.distinct, BEGIN)
        self.counts = np.append(counts, counts[end] if n else 0)
        self.first, self.second, self.pair, self.train = tokens.pairs()
        self.asked = (self.counts[self.first] > 0) & (self.counts[self.second] > 0)
        # A context's followers are dealt over as many parts as its share of the corpus asks for.
        share = np.minimum(1 + self.counts * (4 * parts) // max(total, 1), parts).astype(np.uint64)
        home = mix64(self.hashes ^ MIX1) % np.uint64(parts)
        v, w = self.first[self.asked], self.second[self.asked]
        part = (home[v] + mix64(self.hashes[w]) % share[v]) % np.uint64(parts)
        contexts = np.unique(self.first)
        contexts = contexts[self.counts[contexts] > 0]
        wide = share[contexts].astype(np.int64)
        self.context = np.repeat(contexts, wide)
        step = np.arange(len(self.context)) - np.repeat(np.cumsum(wide) - wide, wide)
        self.context_part = ((home[self.context] + step.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        self.pair_order = np.lexsort((self.hashes[w], self.hashes[v], part))
        self.pair_part = part.astype(np.int64)[self.pair_order]
        self.context_order = np.lexsort((self.hashes[self.context], self.context_part))
        self.v, self.w = v[self.pair_order], w[self.pair_order]
        self.t = self.train[self.asked][self.pair_order]
        self.context = self.context[self.context_order]
        self.context_part = self.context_part[self.context_order]

    def sections(self):
        """(part, slice of contexts, slice of pairs)."""
        for part in np.unique(self.context_part).tolist():
            yield (
                part,
                slice(*np.searchsorted(self.context_part, [part, part + 1]).tolist()),
                slice(*np.searchsorted(self.pair_part, [part, part + 1]).tolist()),
            )


def _answers(kinds, parts, payloads) -> dict:
    return {(k, p): x for k, p, x in zip(kinds.to_pylist(), parts.to_pylist(), payloads.to_pylist(), strict=True)}


def ask_pairs(word_parts: int, parts: int, total: int):
    def ask(rows, answered):
        import pyarrow as pa

        got = _answers(answered["kind"], answered["part"], answered["payload"])
        out = []
        for block, payload in zip(rows["block"].to_pylist(), rows["payload"].to_pylist(), strict=True):
            tokens = Tokens(payload)
            counts = known_counts(tokens, word_parts, got)
            own = Contexts(tokens, counts, parts, total)
            for part, contexts, pairs in own.sections():
                followers = np.bincount(np.searchsorted(own.hashes[own.context[contexts]], own.hashes[own.v[pairs]]), minlength=contexts.stop - contexts.start)
                packed = [
                    rising(own.hashes[own.context[contexts]]), counts_in(followers), planes(own.hashes[own.w[pairs]]),
                    counts_in(counts[own.w[pairs]]), counts_in(own.t[pairs]),
                ]
                out.append(_row(pa, part=part, block=block, payload=packed))
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("payload", pa.list_(pa.binary()))])
        return pa.Table.from_batches(out, schema)

    return ask


def answer_pairs(unigrams: Unigrams):
    def answer(group):
        """Total count of each pair asked for; for each context asked for, how many of its
        followers here have each count up to LAST_DISCOUNTED, the sum of larger counts, and the
        sum of P over the followers."""
        import pyarrow as pa

        asked = []
        for block, p in zip(group["block"].to_pylist(), group["payload"].to_pylist(), strict=True):
            asked.append((block, unrising(p[0]), counts_out(p[1]), unplanes(p[2], np.uint64), counts_out(p[3]), counts_out(p[4])))
        contexts, of_entry = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
        of_pair = np.repeat(of_entry, np.concatenate([x[2] for x in asked]))
        with np.errstate(over="ignore"):
            key = mix64(contexts[of_pair] * MIX1 + np.concatenate([x[3] for x in asked]))
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([x[5] for x in asked]), minlength=len(first)).astype(np.int64)
        real = totals > 0
        r, v = totals[real], of_pair[first][real]
        p = unigrams.p(np.concatenate([x[4] for x in asked])[first][real])
        size = len(contexts)
        few = [np.bincount(v, weights=r == i, minlength=size).astype(np.int64) for i in range(1, LAST_DISCOUNTED + 1)]
        many = np.bincount(v, weights=np.where(r > LAST_DISCOUNTED, r, 0), minlength=size).astype(np.int64)
        backed = np.bincount(v, weights=p, minlength=size)
        part = group["part"][0].as_py()
        out = [_row(pa, kind="stats", block=-1, part=part, payload=[], stats=[int(r.sum()), len(r), *_of_counts(r)])]
        at_pair = at_entry = 0
        for block, entries, followers, words, *_ in asked:
            n = int(followers.sum())
            own = of_entry[at_entry : at_entry + len(entries)]
            payload = [counts_in(totals[place[at_pair : at_pair + n]]), *(counts_in(x[own]) for x in (*few, many)), planes(backed[own]), mark(entries), mark(words)]
            out.append(_row(pa, kind="pairs", block=block, part=part, payload=payload, stats=[]))
            at_pair += n
            at_entry += len(entries)
        return pa.Table.from_batches(out)

    return answer


def score_block(tokens: Tokens, counts: np.ndarray, own: Contexts, unigrams: Unigrams, pairs: Discounts, answers: dict):
    """log10 probability of each token."""
    few = np.zeros((LAST_DISCOUNTED, len(own.hashes)))
    many, backed = np.zeros(len(own.hashes)), np.zeros(len(own.hashes))
    totals = np.zeros(len(own.v), np.int64)
    for part, contexts, some in own.sections():
        got = answers.get(("pairs", part), [b"", b""])
        if got[-2] != mark(own.hashes[own.context[contexts]]) or got[-1] != mark(own.hashes[own.w[some]]):
            raise ValueError(DIFFERS)
        totals[some] = counts_out(got[0])
        for i in range(LAST_DISCOUNTED):
            np.add.at(few[i], own.context[contexts], counts_out(got[1 + i]))
        np.add.at(many, own.context[contexts], counts_out(got[1 + LAST_DISCOUNTED]))
        np.add.at(backed, own.context[contexts], unplanes(got[2 + LAST_DISCOUNTED], np.float64))
    rank = np.arange(1, LAST_DISCOUNTED + 1)
    seen = few.T @ (pairs.d[1:] * rank) + many
    followed = few.T @ rank + many
    below = np.where(followed - seen > 0, followed, followed + 1)
    below = np.maximum(below, 1)
    back = (1 - seen / below) / np.maximum(1 - backed, 1e-300)
    lower = unigrams.p(counts)
    p = np.where(own.counts[own.first] > 0, back[own.first], 1.0) * lower[own.second]
    trained = np.zeros(len(own.first), np.int64)
    trained[np.flatnonzero(own.asked)[own.pair_order]] = totals
    p = np.where(trained > 0, pairs.weight(trained) / below[own.first], p)
    return np.log10(p)[own.pair]


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(word_parts: int, parts: int, unigrams: Unigrams, pairs: Discounts):
    def run(rows, answered):
        import pyarrow as pa

        got = _answers(answered["kind"], answered["part"], answered["payload"])
        out = []
        total, types = unigrams.total, unigrams.types
        for payload in rows["payload"].to_pylist():
            tokens = Tokens(payload)
            counts = known_counts(tokens, word_parts, got)
            own = Contexts(tokens, counts, parts, total)
            each = score_block(tokens, counts, own, unigrams, pairs, got)
            base = np.log10((counts + 0.1) / (total + 0.1 * (types + 1)))[tokens.local]
            known = (counts > 0)[tokens.local]
            out.append(pa.table({
                "doc_id": tokens.doc_id.cast(pa.int64()), "held_out": pa.array(tokens.held),
                "n_tokens": pa.array(tokens.sizes, pa.int64()), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), tokens.starts)),
                "train_tokens": pa.array(np.full(len(tokens.sizes), total, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, tokens.starts)), "score": pa.array(np.add.reduceat(each, tokens.starts)),
            }))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _sums(answers: DataFrame, n: int) -> list[int]:
    """Sums of the parts' statistics, a fixed number of values."""
    row = answers.where("kind = 'stats'").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in row]


def score_documents(docs: DataFrame, mod: int = 10, remainder: int = 0) -> DataFrame:
    """SCORES of each row of docs (doc_id, text), learnt from rows whose remainder differs."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    packed = blocks(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
            held_out(F.col("doc_id"), mod, remainder).alias("held_out"),
        ),
        BLOCK_BYTES,
    )
    n_stats = LAST_DISCOUNTED + 4
    words = packed.mapInArrow(ask_words(parts), ASKED).groupBy("part").applyInArrow(giving_back(answer_words), ANSWERED)
    words = stored(words, f"{place}/words")
    total, types, *of_counts = _sums(words, n_stats)
    unigrams = Unigrams(total, types, of_counts)
    known = words.where("kind = 'words'").select("kind", "block", "part", "payload")
    asked = packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(giving_back(ask_pairs(parts, parts, total)), ASKED)
    pairs = stored(asked.groupBy("part").applyInArrow(giving_back(answer_pairs(unigrams)), ANSWERED), f"{place}/pairs")
    _, _, *of_counts = _sums(pairs, n_stats)
    answers = known.unionByName(pairs.where("kind = 'pairs'").select("kind", "block", "part", "payload"))
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        giving_back(score(parts, parts, unigrams, Discounts(of_counts))), SCORES
    )
