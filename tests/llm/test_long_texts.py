"""Texts of many megabytes: bounded memory, the same results whatever the pieces; word hashes; folders of a run."""

import re
import subprocess
import sys
import threading

import numpy as np
import pyarrow as pa
import pytest

from lendscope.llm import language_mix, quality_rank, shared

MEASURE = """
import resource
import numpy as np, pyarrow as pa
from lendscope.llm import language_mix, quality_rank, shared
rng = np.random.default_rng(3)
part = rng.choice(np.frombuffer(b"abcdefghijklmnopqrst    ,.", np.uint8), 1_000_003).tobytes().decode()
text = pa.array([part * 32], pa.string())
model = np.log(rng.dirichlet(np.ones(language_mix.GRAMS), 4).T).astype(np.float32)
if {what!r} == "languages":
    assert abs(language_mix.shares(text, model).sum() - 1) < 1e-6
elif {what!r} == "quality":
    assert quality_rank.features(*shared.text_bytes(text)).shape == (1, quality_rank.PLAIN + quality_rank.SHAPES**3)
else:
    assert shared.word_hashes(*shared.text_bytes(text))[1][0] > 1_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("what", ["languages", "quality", "words"])
def test_a_text_of_32_megabytes_takes_bounded_memory(what):
    out = subprocess.run([sys.executable, "-c", MEASURE.format(what=what)], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 600


TEXTS = ["", "ab", "Cd ef", "  ", "x" * 5000 + " y", "tail\n", "the End", "É é ÀÉ x", "one\ttwo  three\n\nfour", "a b c " * 40]


def words_of(text):
    return [w.lower() for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_word_hashes_by_hand(monkeypatch, piece):
    monkeypatch.setattr(shared, "PIECE", piece)
    got, sizes = shared.word_hashes(*shared.text_bytes(pa.array(TEXTS)))
    expected = []
    for word in (w for t in TEXTS for w in words_of(t)):
        total = len(word) * int(shared.MIX2)
        for place, byte in enumerate(word):
            value = int(shared.BYTE_VALUES[byte]) * int(shared.place_values(np.array([place]))[0]) % 2**64
            total += value ^ value >> 32
        expected.append(total % 2**64)
    assert sizes.tolist() == [len(words_of(t)) for t in TEXTS]
    assert got.tolist() == shared.mix64(np.array(expected, np.uint64)).tolist()


def test_words_built_to_meet_under_powers_are_told_apart():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    pair = [word, word.translate(str.maketrans("ab", "ba"))]
    assert len(set(shared.word_hashes(*shared.text_bytes(pa.array(pair)))[0].tolist())) == 2


@pytest.mark.parametrize("piece", [3, 50, 1000])
def test_pieces_change_no_result(monkeypatch, piece):
    rng = np.random.default_rng(4)
    texts = pa.array([*TEXTS, *(" ".join(rng.choice(["the", "of", "und", "der", "los", "que"], n).tolist()) for n in (30, 200)), None])
    model = np.log(rng.dirichlet(np.full(language_mix.GRAMS, 0.1), 3).T + 1e-9).astype(np.float32)
    raw, off = shared.text_bytes(texts)
    whole, plain = language_mix.shares(texts, model), quality_rank.features(raw, off)
    for module in (language_mix, quality_rank, shared):
        monkeypatch.setattr(module, "PIECE", piece)
    monkeypatch.setattr(language_mix, "PIECE_WORDS", piece)
    assert np.allclose(language_mix.shares(texts, model), whole, atol=1e-4)
    assert (quality_rank.features(raw, off) == plain).all()


def test_features_by_hand():
    text = "The end. The End!\n12 | x"
    found = quality_rank.features(*shared.text_bytes(pa.array(["", text, None])))[1]
    words = words_of(text)
    plain = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(text) / len(words)), np.log1p(len(text) / 2), 3 / len(text), 2 / len(text), 2 / len(text), 1 / len(text), 6 / 7, 2 / 7, 0]
    assert np.allclose(found[: quality_rank.PLAIN], plain)
    shapes = quality_rank.SHAPE[np.frombuffer(text.encode(), np.uint8)]
    for k in range(quality_rank.SHAPES**3):
        triple = (k // quality_rank.SHAPES**2, k // quality_rank.SHAPES % quality_rank.SHAPES, k % quality_rank.SHAPES)
        times = sum(tuple(shapes[i : i + 3]) == triple for i in range(len(text) - 2))
        assert np.isclose(found[quality_rank.PLAIN + k], np.sqrt(times / len(text)))


def test_runs_in_two_threads_delete_their_own_folders(spark, tmp_path):
    before = len(shared.PLACES)
    inside, done = threading.Event(), threading.Event()
    kept = []

    def other():
        with shared.own_folders(spark):
            kept.append(shared.stored(spark.range(3), f"{shared.shared_dir(spark)}/t"))
            inside.set()
            assert done.wait(60)
            kept.append(kept[0].count())

    thread = threading.Thread(target=other)
    thread.start()
    assert inside.wait(60)
    with shared.own_folders(spark):
        mine = shared.shared_dir(spark)
        gone = shared.stored(spark.range(5), f"{mine}/t")
        assert gone.count() == 5
    shared.clear(spark)
    done.set()
    thread.join()
    assert kept[1] == 3 and len(shared.PLACES) <= before
    with pytest.raises(Exception):
        spark.read.parquet(f"{mine}/t")
