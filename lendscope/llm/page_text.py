"""Main text of pages: declared articles, and host suffix arrays for boilerplate that nothing declares.

Pages are read into blocks (page_blocks). All text outside declared articles and main parts goes into a
token stream a page, elements as tokens too; the streams of a host's pages stand one after another, and
their suffixes are sorted by their first LONG tokens. An interval of that array whose suffixes come from
distinct pages is a long repeated substring, and what lies in one is covered. (Whether a token lies in a
repeat of LONG or more tokens doesn't depend on the order within an interval, so nothing is sorted deeper.)
Boilerplate that is covered goes; unique runs stay, unless their markup declares them to be no content or
the page has a declared article beside them. An article is kept whole, though other pages have the same.
Both are told by words, not by blocks, so a notice and a text that share a block are parted.

At scale: a task sorts the suffixes of the pages of one block, host by host, and an interval leaves it
once, however many pages have it; intervals meet by key, so a host with a third of all pages, or a footer
that all of them have, is spread over all tasks. Each block gets back how often its own intervals occur.
Blocks are told twice, once for the arrays and once for the texts, and must be equal both times (a scan of
files or a stored table gives that); a difference is told by the sum of keys and raises.

A run counts as boilerplate where it stands on at least SHARE of the host's pages, two at least; pages of
equal text are one page here, so copies don't make each other boilerplate. Where COVERED of a block's tokens
are covered, only its unique runs stay (those with fewer than LONG uncovered words between two covered runs are
dates or names in the boilerplate, and go), and a covered run ends where fewer than HALF of the pages of the
block's most frequent one agree. Other blocks lose runs that stand on at least HALF of the host's pages, and
keep all else: a passage that some pages quote is no boilerplate, and a word beside it that a few pages have by
chance isn't either. If nothing unique is left of a page without a declared article, it stays whole. Where
classes name content, the rest of the page goes only if the named elements have at least as many unique words;
a logo named "main" doesn't outdo the text beside it.

Defined cases: null html has no text; null url or one without a host is of the host "". Repeated rows give
a row each. A page of any length is read whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import counts_in, counts_out, numbered, planes, rising, unplanes, unrising
from lendscope.llm.page_blocks import MAIN, NAMED, PLAIN, content_level, page_blocks
from lendscope.llm.shared import MULT, expand, giving_back, mix64, shared_dir, squeeze, stored

#: Tokens of a long substring.
LONG = 12
#: Share of a host's pages that boilerplate stands on, and of a block's tokens that is covered, at least.
SHARE, COVERED = 0.05, 0.8
#: Share of a host's pages that boilerplate in a block of other text stands on, and of a covered block's most frequent run's pages, at least.
HALF = 0.5
#: Bytes of html in a block.
BLOCK_BYTES = 4_000_000
#: Parts of the interval table per shuffle partition.
SPREAD = 2

HOST = re.compile(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


def host_of(url) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class Tokens:
    """64-bit values of tokens, hosts and texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def value(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            import xxhash

            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[token] = xxhash.xxh3_64_intdigest(token)
        return found


class PageStreams:
    """The pages of a block: their blocks of text, token streams and hosts.

    tokens holds all streams in turn; begins and sizes tell each page's part. of_block gives the number of
    each token's block in the page; page and host identify equal texts and equal hosts.
    """

    def __init__(self, table):
        import xxhash

        self.page_id, self.url = table["page_id"], table["url"]
        self.blocks, tokens, of_block, sizes, page, host = [], [], [], [], [], []
        of = Tokens()
        for url, html in zip(table["url"], table["html"], strict=True):
            own = page_blocks(html.as_py() or "")
            self.blocks.append(own)
            before, outside = len(tokens), True
            whole = xxhash.xxh3_64()
            for i, (text, level, chrome, kind) in enumerate(own):
                whole.update(text.encode())
                whole.update(b"\n")
                if level >= MAIN and not chrome:
                    if outside:  # one token stands for the article
                        tokens.append(of.value("<article>"))
                        of_block.append(i)
                    outside = False
                    continue
                outside = True
                words = [f"<{kind}>", *text.split(" ")]
                tokens.extend(map(of.value, words))
                of_block.extend([i] * len(words))
            sizes.append(len(tokens) - before)
            page.append(whole.intdigest())
            host.append(xxhash.xxh3_64_intdigest(host_of(url.as_py())))
        self.tokens, self.of_block = np.array(tokens, np.uint64), np.array(of_block, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.page, self.host = np.array(page, np.uint64), np.array(host, np.uint64)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, page number and key of each suffix of at least LONG tokens; the key is that of its
        first LONG tokens and its host."""
        ends = np.cumsum(self.sizes)
        of_page = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.flatnonzero(np.arange(len(self.tokens)) + LONG <= np.repeat(ends, self.sizes))
        of_page = of_page[place]
        key = mix64(self.host)[of_page]
        with np.errstate(over="ignore"):
            for i in range(LONG):
                key = mix64(key * MULT + self.tokens[place + i])
        return place, of_page, key


class Intervals:
    """The suffix array of a block's streams in intervals of equal keys: keys (rising), how many distinct
    pages have each, least and largest of these, and the interval of each suffix (place)."""

    def __init__(self, streams: PageStreams):
        self.place, of_page, key = streams.suffixes()
        order = np.lexsort((streams.page[of_page], key))
        sorted_key, sorted_page = key[order], streams.page[of_page[order]]
        first = np.diff(sorted_key, prepend=np.uint64(0)) != 0
        if len(first):
            first[0] = True
        another = first.copy()
        another[1:] |= sorted_page[1:] != sorted_page[:-1]
        starts = np.flatnonzero(first)
        self.keys, self.low = sorted_key[starts], sorted_page[starts]
        self.high = sorted_page[np.append(starts[1:], len(order)) - 1] if len(starts) else sorted_page
        self.pages = np.add.reduceat(another.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        self.interval = np.zeros(len(order), np.int64)
        self.interval[order] = np.cumsum(first) - 1
        self.mark = int(self.keys.sum(dtype=np.uint64).view(np.int64)) if len(starts) else 0


ASKED = "part int, block long, mark long, lists array<binary>, hosts array<long>, pages array<long>"


def ask(parts: int, size: int):
    """The intervals of each block by part of their keys (part 0 tells the block's hosts too)."""

    def run(batches):
        import pyarrow as pa

        for number, table in numbered(batches, "html", size):
            streams = PageStreams(table)
            own = Intervals(streams)
            both, at = np.unique(np.stack((streams.host, streams.page)), axis=1), own.keys >> np.uint64(32)
            hosts, pages = np.unique(both[0], return_counts=True)
            part = (at * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a == b and p:
                    continue
                several = own.pages[a:b] > 1
                lists = [rising(own.keys[a:b]), planes(own.low[a:b]), counts_in(own.pages[a:b]), planes(own.high[a:b][several])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([p], pa.int32()),
                        "block": pa.array([number], pa.int64()),
                        "mark": pa.array([own.mark], pa.int64()),
                        "lists": pa.array([lists], pa.list_(pa.binary())),
                        "hosts": pa.array([hosts.view(np.int64).tolist() if p == 0 else []], pa.list_(pa.int64())),
                        "pages": pa.array([pages.tolist() if p == 0 else []], pa.list_(pa.int64())),
                    }
                )

    return run


def merge(group):
    """For each block of a part: on how many pages each of its intervals stands, 0 where on one text only."""
    import pyarrow as pa

    keys, low, high, pages = [], [], [], []
    for lists in group["lists"].to_pylist():
        n = counts_out(lists[2])
        least = unplanes(lists[1], np.uint64)
        most = least.copy()
        most[n > 1] = unplanes(lists[3], np.uint64)
        for to, x in ((keys, unrising(lists[0])), (low, least), (high, most), (pages, n)):
            to.append(x)
    sizes = [len(k) for k in keys]
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    total, least, most = np.zeros(len(every), np.int64), np.full(len(every), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(every), np.uint64)
    np.add.at(total, which, np.concatenate(pages))
    np.minimum.at(least, which, np.concatenate(low))
    np.maximum.at(most, which, np.concatenate(high))
    total[least == most] = 0
    found = np.split(total[which], np.cumsum(sizes)[:-1])
    return pa.table({"block": group["block"], "part": group["part"], "counts": pa.array([counts_in(x) for x in found], pa.binary())})


ROWS = "block long, mark long, page_id array<long>, url array<string>, payload binary, told array<binary>"


def describe(size: int):
    """What remains of each block: its pages' candidate texts, and what is needed to choose among them."""

    def run(batches):
        import pyarrow as pa

        for number, table in numbered(batches, "html", size):
            streams = PageStreams(table)
            own = Intervals(streams)
            # Texts that may be chosen only; of the others the words are counted.
            texts, levels, words, chosen, per_page = [], [], [], [], []
            for blocks in streams.blocks:
                top = content_level(blocks)
                least = top if top >= MAIN else PLAIN
                for text, level, chrome, _ in blocks:
                    good = not chrome and level >= least
                    chosen.append(good)
                    levels.append(level if good else 0)
                    words.append(text.count(" ") + 1)
                    if good:
                        texts.append(text)
                per_page.append(len(blocks))
            told = [
                counts_in(np.array(per_page, np.int64)), planes(np.array(chosen, np.uint8)), planes(np.array(levels, np.uint8)), counts_in(np.array(words, np.int64)),
                counts_in(streams.sizes), counts_in(streams.of_block), counts_in(own.place), counts_in(own.interval), planes(streams.host),
            ]
            lines = "\n".join(texts).encode()
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "mark": pa.array([own.mark], pa.int64()),
                    "page_id": pa.array([streams.page_id.to_pylist()], pa.list_(pa.int64())),
                    "url": pa.array([streams.url.to_pylist()], pa.list_(pa.string())),
                    "payload": pa.array([squeeze(lines)], pa.binary()),
                    "told": pa.array([told], pa.list_(pa.binary())),
                }
            )

    return run


def pages_of_tokens(n: np.ndarray, place: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each token, the pages of the most frequent interval that it lies in and that doesn't leave its block."""
    own = np.zeros(len(block), np.int64)
    inside = block[place] == block[place + LONG - 1] if len(place) else np.zeros(0, bool)
    own[place[inside]] = n[inside]
    most = own.copy()
    for i in range(1, LONG):
        np.maximum(most[i:], own[:-i], out=most[i:])
    return most


def unique_words(block: np.ndarray, covered: np.ndarray, most: np.ndarray, total: np.ndarray, mostly: np.ndarray) -> np.ndarray:
    """Which tokens are words that stay: the unique runs of each block. block, covered, most and total (pages of
    the host) are of tokens; mostly tells which blocks are covered as a whole."""
    top = np.zeros(len(mostly), np.int64)
    np.maximum.at(top, block, most)
    within = (most > 1) & (most >= np.where(mostly[block], HALF * top[block], HALF * total))
    word = np.diff(block, prepend=-1) == 0  # a block's first token is its element
    free = word & ~np.where(mostly[block], covered & (within | (top[block] == 0)), within)
    begins, ends = free.copy(), free.copy()
    begins[1:] &= ~free[:-1]
    ends[:-1] &= ~free[1:]
    run = np.cumsum(begins)[free] - 1
    uncovered = np.bincount(run, weights=~covered[free], minlength=int(begins.sum()))
    # At an end of its block: after the element, or before that of the next block.
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    outer = ~word[begins - 1] | ~np.append(word, False)[ends + 1]
    free[free] = (~mostly[block[begins]] | (uncovered >= LONG) | outer & (uncovered > 0))[run]
    return free


RESULT = "page_id long, url string, text string, n_chars long, n_repeated long, n_declared long"


def choose(rows, sides):
    """The texts of a block's pages, from what is told of them and how often their intervals stand on the host."""
    import pyarrow as pa

    row = rows.to_pylist()[0]
    answers = sorted((p, c) for p, c in zip(sides["part"].to_pylist(), sides["counts"].to_pylist(), strict=True) if c is not None)
    if any(m != row["mark"] for m in sides["mark"].to_pylist() if m is not None):
        raise ValueError("a block differs from the one whose suffixes were sorted: pages must be repeatable, so store them first")
    on_host = {h: n for hosts, pages in zip(sides["hosts"].to_pylist(), sides["totals"].to_pylist(), strict=True) for h, n in zip(hosts or [], pages or [], strict=True)}
    told = row["told"]
    per_page, sizes = counts_out(told[0]), counts_out(told[4])
    shown, levels, words = unplanes(told[1], np.uint8) == 1, unplanes(told[2], np.uint8), counts_out(told[3])
    of_block, place, interval = counts_out(told[5]), counts_out(told[6]), counts_out(told[7])
    total = np.array([on_host.get(h, 1) for h in unplanes(told[8], np.uint64).view(np.int64).tolist()], np.int64)
    counts = np.concatenate([np.zeros(0, np.int64), *(counts_out(c) for _, c in answers)])
    of_page = np.repeat(np.arange(len(sizes)), sizes)
    # Tokens that lie in a repeated interval, by differences at its ends.
    n = counts[interval] if len(place) else interval
    often = place[(n > 1) & (n >= SHARE * total[of_page[place]])] if len(place) else place
    covers = np.zeros(len(of_block) + 1, np.int64)
    np.add.at(covers, often, 1)
    np.add.at(covers, often + LONG, -1)
    covered = np.cumsum(covers[:-1]) > 0
    first_block = np.cumsum(per_page) - per_page
    block = first_block[of_page] + of_block if len(of_page) else of_block
    in_stream, hit = np.bincount(block, minlength=len(words)), np.bincount(block[covered], minlength=len(words))
    mostly = (in_stream > 0) & (hit >= COVERED * in_stream) & (levels < MAIN)
    stays = unique_words(block, covered, pages_of_tokens(n, place, block), total[of_page], mostly)
    left = np.where(levels < MAIN, np.bincount(block[stays], minlength=len(words)), words)
    page = np.repeat(np.arange(len(per_page)), per_page)
    sums = lambda mask, of: np.bincount(page[mask], weights=of[mask], minlength=len(per_page)).astype(np.int64)
    named, plain = shown & (levels == NAMED), shown & (levels == PLAIN)
    believed = (sums(named, words) > 0) & (sums(named, left) >= sums(plain, left))
    chosen = shown & ~(plain & believed[page])
    keep = chosen & (left > 0)
    alone = chosen & ~np.isin(page, page[keep])
    left[alone] = words[alone]
    keep |= alone  # a page of repeats only stays
    left[~keep] = 0
    lines = expand(row["payload"]).decode().split("\n")
    line = np.cumsum(shown) - 1
    begins = np.cumsum(in_stream) - in_stream + 1  # a block's first word in the stream
    texts = [[] for _ in per_page]
    for p, i, k in zip(page[keep].tolist(), line[keep].tolist(), np.flatnonzero(keep).tolist(), strict=True):
        if left[k] == words[k]:
            texts[p].append(lines[i])
        else:
            here = stays[begins[k] : begins[k] + words[k]].tolist()
            texts[p].append(" ".join(w for w, s in zip(lines[i].split(" "), here, strict=True) if s))
    texts = ["\n".join(t) for t in texts]
    return pa.table(
        {
            "page_id": pa.array(row["page_id"], pa.int64()),
            "url": pa.array(row["url"], pa.string()),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "n_repeated": pa.array(sums(keep | mostly, words - left)),
            "n_declared": pa.array(sums(~keep & ~mostly, words)),
        }
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """RESULT of each row of pages (page_id, url, html): its main text, and how many words went as repeated
    on the host and as declared by markup (or beside a declared article)."""
    spark = pages.sparkSession
    place = shared_dir(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = stored(rows.mapInArrow(ask(parts, BLOCK_BYTES), ASKED), f"{place}/asked")
    answers = asked.select("part", "block", "lists").groupBy("part").applyInArrow(giving_back(merge), "block long, part int, counts binary")
    hosts = asked.where("part = 0").select("block", "mark", F.explode(F.arrays_zip("hosts", "pages")).alias("of"))
    hosts = hosts.select("block", "mark", F.col("of.hosts").alias("host"), F.col("of.pages").alias("n"))
    totals = hosts.groupBy("host").agg(F.sum("n").alias("total"))
    of_block = hosts.join(totals, "host").groupBy("block").agg(
        F.first("mark").alias("mark"), F.collect_list("host").alias("hosts"), F.collect_list("total").alias("totals")
    )
    sides = answers.unionByName(of_block, allowMissingColumns=True).select("block", "part", "counts", "mark", "hosts", "totals")
    return rows.mapInArrow(describe(BLOCK_BYTES), ROWS).groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(giving_back(choose), RESULT)
