"""Decoding of character lattices against all of their paths."""

import itertools
import re

import numpy as np
import pytest

from lendscope.llm import toxicity

LETTERS = toxicity.LETTERS


@pytest.fixture(scope="module")
def costs():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 60, LETTERS**3)
    import pandas as pd

    class Counts:
        @staticmethod
        def toPandas():
            return pd.DataFrame({"slot": np.arange(LETTERS**3), "n": n})

    return toxicity.letter_costs(Counts)


def price(text, own, costs):
    """Cost of a path: its options' and its letters', a word's edge after each word."""
    x = y = 0
    total = own
    for c in text:
        k = 0 if c == " " else toxicity.kind(c)
        if k == 0 and y == 0:
            continue
        total += costs[x, y, k]
        x, y = (0, 0) if k == 0 else (y, k)
    return total + (costs[x, y, 0] if y else 0.0)


def all_paths(word, costs):
    for path in itertools.product(*toxicity.lattice(word)):
        yield price("".join(s for s, _ in path), sum(p for _, p in path), costs), "".join(s for s, _ in path)


@pytest.mark.parametrize("word", ["id10t", "b4dd", "s.t.u", "a$$", "h3ll0o", "l|!e", "xx", "4", "", "((c", "no-1", "éa5"])
def test_restore_finds_the_cheapest_path(word, costs):
    best = min(all_paths(word, costs))
    found = toxicity.restore(word, costs)
    assert any(abs(cost - best[0]) < 1e-9 and text == found for cost, text in all_paths(word, costs))


@pytest.mark.parametrize("run", ["a b", "b a d", "s 0 b", "a  b c", "l 1 e s", "x  y  z", "d u m b"])
def test_spaced_runs_find_the_cheapest_words(run, costs):
    """All ways to part the letters, each word at its cheapest path."""
    letters = [c for c in run if c != " "]
    gaps = [len(g) for g in re.findall(" +", run)]
    best = {}
    for parts in itertools.product([False, True], repeat=len(gaps)):
        cuts = [0, *(i + 1 for i, p in enumerate(parts) if p), len(letters)]
        total, words = 0.0, []
        for i, (g, p) in enumerate(zip(gaps, parts, strict=True)):
            total += (toxicity.BREAK if g == 1 else 0.0) if p else (0.0 if g == 1 else 2 * toxicity.BREAK)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            options = [toxicity.lattice(c)[0] for c in letters[a:b]]
            paths = [(price("".join(s for s, _ in path), sum(p for _, p in path), costs), "".join(s for s, _ in path)) for path in itertools.product(*options)]
            cost, text = min(paths)
            total += min(cost, toxicity.LONE) if b - a == 1 else cost
            words.append(text)
        for a, b, w in zip(cuts[:-1], cuts[1:], words, strict=True):
            best[a, b] = min(best.get((a, b), (np.inf, w)), (total, w))
    least = min(cost for cost, _ in best.values())
    wanted = sorted((round(cost - least, 6), w) for cost, text in best.values() if cost - least <= toxicity.NEAR for w in text.split())
    assert sorted((round(more, 6), w) for more, w in toxicity.spaced_words(run, costs)) == wanted
