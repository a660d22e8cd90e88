"""Lexical search, page texts and the filter audit: SQL, brute force, and odd tables."""

import html as references
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import filter_audit, lexical_search, page_blocks, page_text, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is was for that with on be are by it this from at or an".split()


def prose(n, seed=0, words=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n).tolist()) + "."


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_filter_audit"])
def test_query_equals_its_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


# ---- search ----------------------------------------------------------------------------


def told_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    lists = [(i, told_terms(t)) for i, t in docs]
    lists = [(i, t) for i, t in lists if t]
    n, total = len(lists), sum(len(t) for _, t in lists)
    df = Counter(w for _, t in lists for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in lists:
            tf, m = Counter(t), 25 + (75 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in told_terms(text) if tf[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_search_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BUCKET", 16)
    monkeypatch.setattr(lexical_search, "FOCUS", 3)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 200)  # several blocks of queries
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "C3"]
    docs = [(i, prose(5 + 7 * i % 90, i, vocabulary)) for i in range(300)]
    docs += [(300, None), (301, " .,"), (302, "w1 " * 50_000), (5, prose(5 + 35 % 90, 5, vocabulary)), (None, "w1 W1 w2"), (None, "w1 W1 w2"), (303, "w1 W1 w2")]
    docs += [(400 + i, "same words w1 w2 w3") for i in range(40)]  # ties beyond the k best
    items = [(1, "w1 w2 w2"), (2, "W3-w4,É naïve"), (3, None), (4, "unknown words only"), (5, "same words"), (5, "same words"), (6, prose(40, 9, vocabulary))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    for top in (3, 10):
        found = lexical_search.lexical_search(d, q, top)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items, top)
    assert lexical_search.lexical_search(d.limit(0), q).count() == 0
    assert lexical_search.lexical_search(d, q.limit(0)).count() == 0


def test_bounds_are_never_below_scores_and_let_most_go():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    terms = [np.sort(rng.choice(500, 40, replace=False)).astype(np.int32) for _ in range(400)]
    x = [rng.integers(1, 900_000, 40).astype(np.int32) for _ in terms]
    table = pa.table(
        {"doc_id": pa.array(range(400), pa.int64()), "length": pa.array([float(np.sqrt((v.astype(float) ** 2).sum())) for v in x]), "terms": pa.array(terms), "impacts": pa.array(x)}
    )
    weight = rng.integers(1, 9000, 500)
    known = [np.sort(rng.choice(500, n, replace=False)) for n in (1, 5, 30, 60)]
    asked = lexical_search.Queries(known, [np.ones(len(k), np.int64) for k in known], weight)
    bucket = lexical_search.Bucket(table)
    bounds = bucket.bounds(asked, np.arange(4))
    for q in range(4):
        exact = bucket.scores(np.arange(400), asked.terms[q], asked.weights[q], 500)
        assert (bounds[:, q] >= exact).all()
        if len(known[q]) <= 30:  # few or no coordinates beyond the focus
            assert (bounds[:, q] >= max(np.sort(exact)[-10], 1)).mean() < 0.7


# ---- pages -----------------------------------------------------------------------------


def test_blocks_follow_the_markup():
    page = (
        '<html><head><title>no</title></head><body class="no-sidebar"><header><h1>Site</h1></header><div class="wrap with-sidebar"><main><article><header><h1>T &amp; U&eacute;</h1></header>'
        "<p>One<br>two \n <b>th</b>ree<p>four<div class=cookie-notice>cookies</div><ul><li>a<li>b</ul><aside>x</aside><footer>by</footer></article>"
        "<section id=comments><article>c1</article></section></main><form>f<input></form><select><option>1</select></div><!-- x > y -->"
        '<script>if(a<b){"</p>"}</script>tail 1 < 2<p style="display: none">unseen</p></div></div></body>'
    )
    found = page_blocks.page_blocks(page)
    assert [b[0] for b in found if b[1] == page_blocks.ARTICLE and not b[2]] == ["T & Ué", "One two three", "four", "a", "b"]
    assert {b[0] for b in found if b[2]} == {"Site", "cookies", "x", "by", "c1", "f", "unseen"}
    assert ("tail 1 < 2", 0, False) in [b[:3] for b in found]


@pytest.mark.parametrize("page", ["", "<", "<a", "<p", "<!--", "<!-- <p>x", "</p></div>x", "<script>x", "<div " * 1000, "<p>" * 2000 + "x", "a &am", "<a \"'>b</a>", "İ<script>x</script>y"])
def test_odd_pages_are_read(page):
    page_blocks.page_blocks(page)


def plain_texts(pages, long, share, covered):
    """Page by page, with sets of token runs."""
    rows, of_host, runs = [], defaultdict(set), defaultdict(set)
    for page_id, url, page in pages:
        host, blocks = page_text.host_of(url), page_blocks.page_blocks(page or "")
        stream, inside = [], False
        for i, (text, level, chrome, kind) in enumerate(blocks):
            if level >= 2 and not chrome:
                stream += [] if inside else [("<article>", i)]
                inside = True
                continue
            inside = False
            stream += [(w, i) for w in [f"<{kind}>", *text.split(" ")]]
        whole = tuple(b[0] for b in blocks)
        rows.append((page_id, url, host, blocks, stream))
        of_host[host].add(whole)
        for a in range(len(stream) - long + 1):
            runs[host, tuple(w for w, _ in stream[a : a + long])].add(whole)
    out = []
    for page_id, url, host, blocks, stream in rows:
        inside = [False] * len(stream)
        for a in range(len(stream) - long + 1):
            n = len(runs[host, tuple(w for w, _ in stream[a : a + long])])
            if n > 1 and n >= share * len(of_host[host]):
                inside[a : a + long] = [True] * long
        size, hit = Counter(i for _, i in stream), Counter(i for (_, i), c in zip(stream, inside, strict=True) if c)
        repeated = [bool(size[i]) and hit[i] >= covered * size[i] and b[1] < 2 for i, b in enumerate(blocks)]
        top = page_blocks.content_level(blocks)
        chosen = [not b[2] and b[1] == top for b in blocks]
        keep = [c and not r for c, r in zip(chosen, repeated, strict=True)]
        keep = keep if any(keep) else chosen
        n = lambda some: sum(len(b[0].split(" ")) for b, s in zip(blocks, some, strict=True) if s)
        text = "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)
        out.append((page_id, url, text, len(text), n([r and not k for r, k in zip(repeated, keep, strict=True)]), n([not r and not k for r, k in zip(repeated, keep, strict=True)])))
    return sorted(out, key=str)


def undeclared_pages():
    """Pages of two hosts whose boilerplate and text no markup tells apart, and some that declare theirs."""
    notice, legal = prose(20, 101), "All rights reserved by the owner of this site and by nobody else at all."
    pages = []
    for i in range(60):
        host = "one.example.com" if i % 3 else "two.example.org"
        body = "".join(f"<p>{prose(15 + j, 1000 + 10 * i + j, [f'v{k}' for k in range(400)])}</p>" for j in range(3))
        pages.append((i, f"https://{host}/{i}", f"<html><body><div><p>{notice} {'x' if i % 3 else 'y'}</p></div>{body}<p>{legal}</p></body>"))
    pages.append((60, "https://one.example.com/copy", pages[1][2]))  # an exact copy
    pages.append((61, "https://one.example.com/only", f"<p>{notice} x</p><p>{legal}</p>"))  # nothing but repeats
    pages.append((62, "https://one.example.com/art", f"<p>{notice} x</p><article><h1>Title</h1><p>{legal}</p></article><p>after</p>"))
    pages += [(63, None, "<p>no host</p>"), (64, "https://u:p@one.example.com:80/", None), (64, "https://u:p@one.example.com:80/", None), (None, "x", "")]
    pages.append((65, "https://two.example.org/long", "<p>" + "long " * 400_000 + "</p>" + "<p>y</p>" * 5000))
    return pages


def test_page_texts_equal_plain_ones(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(page_text, "BLOCK_BYTES", 3000)
    pages = undeclared_pages()
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    df.repartition(6).write.parquet(f"{tmp_path}/pages")
    df = spark.read.parquet(f"{tmp_path}/pages")
    found = sorted(map(tuple, page_text.page_texts(df).collect()), key=str)
    assert found == plain_texts(pages, page_text.LONG, page_text.SHARE, page_text.COVERED)
    text = {r[0]: r[2] for r in found}
    assert "rights" not in text[3] and text[3].count("\n") == 2  # unique runs stay, in their order
    assert "rights" not in text[60] and text[61].count("\n") == 1  # copies lose no more, and a page of repeats loses nothing
    assert text[62].startswith("Title\nAll rights") and "after" not in text[62]
    assert len(text[65]) > 1_900_000 and text[None] == ""
    assert page_text.page_texts(df.limit(0)).count() == 0


def test_pages_of_the_tables_are_their_articles(spark):
    found = {r["page_id"]: r for r in page_text.page_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        lines = [" ".join(references.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert found[r["page_id"]]["text"] == "\n".join(x for x in lines if x)
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


def test_repeated_menus_are_found_on_their_host(spark):
    found = page_text.page_texts(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert found.agg(F.sum("n_repeated")).first()[0] > 0


# ---- audit -----------------------------------------------------------------------------


def plain_audit(docs, labels):
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    rows = []
    for i, t, source in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and low[text] < i,
        }
        of = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((source or "", fails, any(q == 1 for _, q, _ in of), any(x == 1 for _, _, x in of)))
    out = []
    for part in {r[0] for r in rows}:
        own, taken, here = [r for r in rows if r[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                fails = [r for r in own if r[1][f]]
                left = [r for r in left if not r[1][f]]
                taken[f] += len(gone)
                only = sum(1 for r in own if r[1][f] and sum(r[1].values()) == 1)
                here.append((f, (part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone))))
        out += [(*row, taken[f]) for f, row in here]
    return sorted(out)


def audit_rows():
    texts = [prose(60, 1), prose(60, 1), "Short", None, "", " \t\n", " two words ", prose(80, 2, [f"v{i}" for i in range(200)]), prose(70, 3).upper(), "a # b " * 30, "x" * 100_000]
    docs = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts * 3)]
    docs += [(None, prose(60, 1), "s1"), (None, "alone", ""), (2, "Short", "s1"), (2, "Short", "s2"), (90, "Short", "s2"), (90, "Short", "s2")]
    return docs, [(0, 1, 0), (1, 1, 1), (1, 0, None), (2, None, 1), (2, 1, None), (7, 1, 1), (None, 1, 1), (90, 1, 0)]


def test_audit_equals_a_plain_one(spark):
    docs, labels = audit_rows()
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, source string, part string, n int").repartition(5)
    of = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id int, quality int, toxic int, sha string")
    found = filter_audit.filter_audit(d, of)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, labels)
    assert filter_audit.filter_audit(d.limit(0), of).count() == 0
    assert filter_audit.filter_audit(d, of.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_gray_walk_keeps_every_subset():
    rng = np.random.default_rng(1)
    masks, sums = np.arange(32), rng.integers(0, 100, (32, 3))
    states = filter_audit.gray_states(masks, sums, 5)
    for subset in range(32):
        assert (states[subset] == sums[masks & subset == 0].sum(axis=0)).all()
