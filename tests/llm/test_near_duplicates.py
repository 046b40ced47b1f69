"""The pipeline's near duplicates against Jaccard indexes of five-word shingles, all pairs."""

import itertools
import random

import numpy as np

import corpus_pipeline
from loomfield.llm import simhash


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def made(seed):
    """Texts with copies some of whose shingles are exchanged, at Jaccard indexes from about 0.6 on."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(120)]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5):
            copy = list(words)
            for at in rng.sample(range(5, 115), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


def classes(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    return root


def test_near_duplicates_are_those_of_jaccard(spark, small):
    texts = made(5)
    want = classes(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()}
    assert kept == set(want) and 25 < len(kept) < len(texts)


def test_crowded_keys_lose_none(spark):
    texts = made(6)[:60]
    hashed = [simhash.shingles(t) for t in texts]
    want = classes(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8])
    assert simhash.alike(hashed) == want
    sets = spark.createDataFrame([(i, h.view(np.int64).tolist()) for i, h in enumerate(hashed)], "u long, shingles array<long>")
    keys = spark.createDataFrame([(i, 1) for i in range(len(texts))], "u long, k long")
    for block in (4096, 7):
        assert classes(len(texts), [(r.a, r.b) for r in simhash.alike_links(sets, keys, 0.8, block).collect()]) == want


def test_work_hardly_grows():
    """Asks and distances of a row among ten times as many values: the segments widen as the tables fill up."""
    works = [simhash.work(10**e, 4, simhash.fitting(10**e, 4)) for e in range(4, 12)]
    print([round(w) for w in works])
    assert works[-1] < 150 * works[0] and max(b / a for a, b in zip(works, works[1:], strict=False)) < 8


def test_every_number_of_segments_finds_the_same(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(40)]
    values = {v ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for v in base for _ in range(4)}
    frame = spark.createDataFrame([(v,) for v in values], "f long")
    names = {v: i for i, v in enumerate(sorted(values))}
    want = classes(len(values), [(names[a], names[b]) for a, b in itertools.combinations(sorted(values), 2) if (a ^ b).bit_count() <= 4])
    for count in (2, 3, 5):
        assert classes(len(values), [(names[r.a], names[r.b]) for r in simhash.near_links(frame, 4, count).collect()]) == want
