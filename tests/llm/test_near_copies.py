"""The near-duplicate stage against brute force over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from rippleflow.llm import _kernel as K
from rippleflow.llm import near_copies


def made(seed):
    """Families of texts whose similarities lie around 0.8, a large one, and short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "a b", "A  b", "a b c", "one two three four five"]
    for size in [2] * 25 + [5] * 8 + [60]:
        base = [word() for _ in range(r.randint(60, 160))] + (passage if r.random() < 0.3 else [])
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[r.randint(0, 4) :]))
    r.shuffle(texts)
    return texts


def brute(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_is_brute_force_at_four_fifths(spark, seed):
    texts = made(seed)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(brute(texts)))


def test_components_are_those_of_brute_force(spark):
    texts = made(3)
    near = near_copies.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    assert {r.doc_id: r.component_id for r in near.collect()} == dict(enumerate(brute(texts)))


def test_keys_are_met_as_often_as_they_should():
    """Sets of similarity s share a band with probability s ** ROWS."""
    r = np.random.default_rng(3)
    for s in (0.5, 0.8):
        n, met = 200, 0.0
        for _ in range(60):
            both = round(2 * n * s / (1 + s))
            own = r.integers(0, 1 << 62, 2 * n - both, dtype=np.int64).astype(np.uint64)
            a, b = own[:n], np.concatenate([own[:both], own[n:]])
            rows = np.repeat([0, 1], n)
            k = near_copies.bands(rows, near_copies._mix(np.concatenate([a, b])), 2)
            met += (k[0] == k[1]).mean() / 60
        assert abs(met - s**near_copies.ROWS) < 0.03
    assert (1 - 0.8**near_copies.ROWS) ** near_copies.BANDS < 2e-7


def test_shingles_are_distinct_and_empty_texts_have_one():
    data = np.frombuffer(b"a b c d e f g a b c d e", np.uint8)
    rows, h = near_copies.shingles(np.array([0, len(data), len(data)]), data)
    assert K.per_row(rows, 2).tolist() == [7, 1] and len(set(h.tolist())) == 8
