"""A block of words is counted within a bounded number of bytes a word, whatever is frequent."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quarrymill.llm import streams

WORDS = 400_000


@pytest.fixture(scope="module")
def block():
    rng, made = np.random.default_rng(3), streams._Block()
    words = [b"w%d" % min(k, WORDS // 8) for k in rng.zipf(1.3, WORDS)]
    for at in range(0, WORDS, 1000):
        made.add("en", words[at : at + 1000])
    made.add("en", [streams._END] * 2)
    return made, words


@pytest.mark.parametrize("way", ["single", "pairs", "triples", "phrases"])
def test_bytes_a_word(block, way):
    made, every = block[0], np.full(2**20 // 64, 2**64 - 1, np.uint64)
    given = {"single": (), "pairs": (every,), "triples": (every,), "phrases": (every, every)}[way]
    tracemalloc.start()
    getattr(made, way)(*given)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * WORDS


def test_phrases_are_those_of_the_words(block):
    made, words = block
    every = np.full(2**20 // 64, 2**64 - 1, np.uint64)
    grams, counts = made.phrases(every, every)
    got = {tuple(made.words[k] for k in g if k): n for *g, n in zip(*grams, counts.tolist(), strict=True)}
    assert got == Counter(zip(words, words[1:], strict=False)) | Counter(zip(words, words[1:], words[2:], strict=False))
