"""Page texts by token runs: boilerplate and text in one block, dates in boilerplate, shared passages, named elements."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from lendscope.llm import page_blocks, page_text

LONG, SHARE, COVERED, HALF = 12, 0.05, 0.8, 0.5


def prose(n, seed, words=400):
    return " ".join(f"v{k}" for k in np.random.default_rng(seed).integers(0, words, n)) + "."


TOP = "Welcome to our site, read the news of the day, find all offers and tell your friends about them."
END = "All rights reserved by the owner of this site and by nobody else at all, wherever it may be read by anybody."
QUOTE = "it was said by the minister that nobody had ever been told of any such plan at all"


def shared_block_pages():
    """Pages of one host, most with its notices in the block of the text, and their texts as they must come out."""
    pages, wanted = [], []
    for i in range(40):
        if i < 20:  # mostly text, which begins with a word that several pages have
            body = ("The " if i % 3 == 0 else "") + prose(150, i)
            page = f"<body><div>{TOP}<br><br>{body}<br>{END}</div></body>"
        elif i < 27:  # mostly notices
            body = ("A " if i % 3 == 0 else "") + prose(14, i)
            page = f"<body><div>{TOP} {END} {TOP}<br>{body}<br>{END} {TOP} {END}</div></body>"
        elif i < 30:  # and a short text
            body = prose(5, i)
            page = f"<body><div>{TOP} {END} {TOP}<br>{body}</div></body>"
        elif i < 33:  # a passage on three pages
            body = f"{prose(20, i)} {QUOTE} {prose(20, 100 + i)}"
            page = f"<div>{TOP}</div><p>{body}</p><div>{END}</div>"
        else:  # a date in a footer
            body = prose(30, i)
            page = f"<div>{TOP}</div><p>{body}</p><div>{TOP} Seen on day {i} of {2000 + i}. {END}</div>"
        pages.append((i, f"https://one.example.com/{i}", page))
        wanted.append(body)
    return pages, wanted


def runs(flags):
    """(start, stop) of the runs of true flags."""
    out, a = [], None
    for i, f in enumerate([*flags, False]):
        if f and a is None:
            a = i
        elif not f and a is not None:
            out.append((a, i))
            a = None
    return out


def plain_texts(pages):
    """Page by page, with sets of token runs."""
    rows, of_host, seen = [], defaultdict(set), defaultdict(set)
    for page_id, url, page in pages:
        host, blocks = page_text.host_of(url), page_blocks.page_blocks(page or "")
        stream, inside = [], False
        for i, (text, level, chrome, kind) in enumerate(blocks):
            declared = level >= 2 and not chrome
            if not declared:
                stream += [(w, i) for w in [f"<{kind}>", *text.split(" ")]]
            elif not inside:
                stream.append(("<article>", i))
            inside = declared
        whole = tuple(b[0] for b in blocks)
        rows.append((page_id, host, blocks, stream))
        of_host[host].add(whole)
        for a in range(len(stream) - LONG + 1):
            seen[host, tuple(w for w, _ in stream[a : a + LONG])].add(whole)
    out = {}
    for page_id, host, blocks, stream in rows:
        total, covered, most = len(of_host[host]), [False] * len(stream), [0] * len(stream)
        for a in range(len(stream) - LONG + 1):
            n = len(seen[host, tuple(w for w, _ in stream[a : a + LONG])])
            if n > 1 and n >= SHARE * total:
                covered[a : a + LONG] = [True] * LONG
            if n > 1 and stream[a][1] == stream[a + LONG - 1][1]:
                most[a : a + LONG] = [max(n, m) for m in most[a : a + LONG]]
        hit, size = Counter(b for (_, b), c in zip(stream, covered, strict=True) if c), Counter(b for _, b in stream)
        left = []
        for i, (text, level, chrome, _) in enumerate(blocks):
            words = text.split(" ")
            if level >= 2 and not chrome:
                left.append(words)
                continue
            at = next(t for t, (_, b) in enumerate(stream) if b == i) + 1
            mostly, top = hit[i] >= COVERED * size[i], max(most[at - 1 : at + len(words)])
            here, frequent = covered[at : at + len(words)], [m > 1 and m >= HALF * (top if mostly else total) for m in most[at : at + len(words)]]
            gone = [c and (f or top == 0) for c, f in zip(here, frequent, strict=True)] if mostly else frequent
            kept = []
            for a, b in runs([not g for g in gone]):
                fresh = sum(not c for c in here[a:b])
                if not mostly or fresh >= LONG or fresh and (a == 0 or b == len(words)):
                    kept += words[a:b]
            left.append(kept)
        levels = [-1 if b[2] else b[1] for b in blocks]
        least = max(levels, default=0) if max(levels, default=0) >= 2 else 0
        count = lambda x: sum(len(w) for w, v in zip(left, levels, strict=True) if v == x)
        if least == 0 and 1 in levels and count(1) >= count(0):
            least = 1
        chosen = [i for i, v in enumerate(levels) if v >= least]
        lines = [" ".join(left[i]) for i in chosen if left[i]] or [blocks[i][0] for i in chosen]
        out[page_id] = "\n".join(lines)
    return out


def texts(spark, pages, parts=5):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
    return {r["page_id"]: r for r in page_text.page_texts(df).collect()}


def test_notices_and_text_of_one_block_are_parted(spark, monkeypatch):
    monkeypatch.setattr(page_text, "BLOCK_BYTES", 3000)
    pages, wanted = shared_block_pages()
    found = texts(spark, pages)
    assert [found[i]["text"] for i in range(len(pages))] == wanted
    assert {i: r["text"] for i, r in found.items()} == plain_texts(pages)
    for i, _, page in pages:  # each word stays, or is counted once
        words = sum(len(b[0].split(" ")) for b in page_blocks.page_blocks(page))
        assert len(found[i]["text"].split()) + found[i]["n_repeated"] + found[i]["n_declared"] == words
        assert found[i]["n_chars"] == len(found[i]["text"])


def test_names_of_elements_do_not_outdo_unique_text(spark):
    first, second, short = prose(40, 1), prose(40, 6), prose(6, 2)
    pages = [
        (1, "https://a.example/1", f'<body><div id="main-logo">Acme</div><p>{first}</p></body>'),
        (2, "https://a.example/2", f'<body><div>{short}</div><div class="post-content"><p>{second}</p></div></body>'),
        (3, "https://a.example/3", f'<body><div class="content">{TOP}</div><p>{prose(20, 3)}</p></body>'),
        (4, "https://a.example/4", f'<body><div class="content">{TOP}</div><p>{prose(20, 4)}</p></body>'),
        (5, "https://a.example/5", f"<body><p>{prose(40, 7)}</p><article>{short}</article></body>"),
    ]
    found = texts(spark, pages, 2)
    assert found[1]["text"] == f"Acme\n{first}" and found[2]["text"] == second
    assert found[3]["text"] == prose(20, 3) and found[4]["text"] == prose(20, 4)  # what content is called, yet stands on both
    assert found[5]["text"] == short
    assert {i: r["text"] for i, r in found.items()} == plain_texts(pages)


def test_near_copies_without_long_unique_runs_stay_whole(spark):
    words = prose(60, 5).split()
    pages = [(i, f"https://b.example/{i}", f"<p>{' '.join([*words[:30], f'only{i}', *words[30:]])}</p>") for i in range(3)]
    found = texts(spark, pages, 2)
    assert all(found[i]["text"].split() == [*words[:30], f"only{i}", *words[30:]] for i in range(3))


@pytest.mark.parametrize("seed", range(3))
def test_mixed_pages_equal_plain_ones(spark, monkeypatch, seed):
    monkeypatch.setattr(page_text, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(seed)
    stock = [prose(int(n), 500 + k) for k, n in enumerate(rng.integers(4, 40, 8))]
    tags = ["<p>", "<div>", "<div class=content>", "<br>", " ", "<article>", "</article>", "<nav>", "</nav>"]
    pages = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 9))):
            tag = str(rng.choice(tags, p=[0.2, 0.2, 0.1, 0.15, 0.15, 0.03, 0.07, 0.05, 0.05]))
            own = stock[int(rng.integers(0, 8) ** 2 / 8)] if rng.random() < 0.6 else prose(int(rng.integers(1, 60)), int(rng.integers(1000, 10**6)))
            parts.append(tag + own)
        pages.append((i, f"https://{'a' if i % 4 else 'b'}.example/{i}", "".join(parts)))
    found = texts(spark, pages)
    assert {i: r["text"] for i, r in found.items()} == plain_texts(pages)
    for i, _, page in pages:
        words = sum(len(b[0].split(" ")) for b in page_blocks.page_blocks(page))
        assert len(found[i]["text"].split()) + found[i]["n_repeated"] + found[i]["n_declared"] == words
