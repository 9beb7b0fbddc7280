import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from vigil.llm import similar
from vigil.llm.fingerprints import shingle_hashes


def kept_by(texts, least):
    """Indices of the texts that stay, by exact similarity of all pairs."""
    sets = [set(shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and (len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) if sets[i] | sets[j] else True):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in range(len(texts)) if find(i) == i}


def made(seed):
    """Texts whose shingles are shared to between 0.5 and 1 with another's, in groups and chains."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(rng.choice((base, out[-1].split())))
            for _ in range(rng.randrange(1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("bucket", [200, 3])
def test_stage_catches_all_similar_and_nothing_else(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    texts = made(bucket)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.dedupe_documents(spark, docs, sf).collect()}
    assert got == kept_by(texts, 0.8)


def test_pairs_beyond_the_radius_and_below_the_similarity(spark, sf):
    rng = random.Random(1)
    far = near = None
    while far is None or near is None:
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        copy = list(base)
        for _ in range(rng.randrange(2, 12)):
            copy[rng.randrange(len(copy))] = "new"
        a, b = " ".join(base), " ".join(copy)
        share = similar.similarity(*(np.unique(shingle_hashes(x.encode(), 5)) for x in (a, b)))
        bits = (brute.fingerprint(a, 5) ^ brute.fingerprint(b, 5)).bit_count()
        if share >= 0.8 and bits > 8:
            far = (a, b)
        if share < 0.75 and bits <= 8:
            near = (a, b)
    docs = spark.createDataFrame(list(enumerate([*far, *near])), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.dedupe_documents(spark, docs, sf).collect()} == {0, 2, 3}


def test_bands_catch_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    found = collections.Counter()
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        found[bool((similar.bands(np.unique(pool[:90])) == similar.bands(np.unique(pool[10:]))).any())] += 1
    assert found[False] <= 1
