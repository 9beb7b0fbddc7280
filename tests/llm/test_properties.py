"""Properties of the parts that need no Spark."""

import collections
import io

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from vigil.llm import fingerprints, packing, quality_rules, simple8b, vantage, warc
from vigil.llm.bpe import PairIndexBPE
from vigil.llm.tokenize import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, CODER = Encoder(PATH), PairIndexBPE(PATH)
TEXTS = st.lists(st.text(st.sampled_from("ab AB1.,'!\n\t\r\x1c\x85\xa0é中😀<|endoftext|>"), max_size=40), max_size=6)


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_both_encoders_agree_with_the_library(texts):
    ids, sizes = ENCODER.encode(texts)
    stops = np.cumsum(sizes)
    for text, stop, n, own in zip(texts, stops, sizes, CODER.encode(texts)):
        want = brute.ids_of(text)
        assert ids[stop - n : stop].tolist() == want == own
        assert CODER.decode(own) == brute.TOKENIZER.decode(want, skip_special_tokens=False)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000), max_size=3000), max_size=3))
def test_token_file_round_trip(groups):
    file = io.BytesIO()
    writer = simple8b.Writer(file)
    for i, ids in enumerate(groups):
        writer.add(np.array([i]), np.array([False]), np.array([len(ids)]), np.array(ids, np.uint64))
    writer.close()
    file.seek(0)
    assert [ids.tolist() for _, _, _, ids in simple8b.read(file)] == groups


@settings(deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_packing_fits_and_meets_its_bound(lengths):
    lengths = np.array(lengths)
    bins, offsets, fills = packing.best_fit_decreasing(lengths, 100)
    assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(fills)
    assert fills.max() <= 100
    for b in range(len(fills)):
        at = 0
        for o, n in sorted((o, n) for o, n, x in zip(offsets, lengths, bins) if x == b):
            assert o == at
            at += n


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4))
def test_repeated_windows(docs):
    codes = np.array([ord(w) for d in docs for w in d], np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = np.bincount(owner, quality_rules.repeated_window_words(codes, owner, 8), len(docs)).tolist() if len(docs) else []
    assert got == [brute.base_counts(" ".join(d))["n_repeat_words"] for d in docs]


@given(st.binary(max_size=500), st.integers(1, 64))
def test_chunks_join_again(payload, size):
    rows = list(warc.chunk_rows(payload, size))
    assert b"".join(r[1] for r in rows) == payload and [r[4] for r in rows].count(True) == 1 and rows[-1][4]


@settings(deadline=None, max_examples=50)
@given(st.text(max_size=80), st.integers(1, 5))
def test_fingerprint(text, width):
    assert fingerprints.majority(fingerprints.shingle_hashes(text.encode(), width)) == brute.fingerprint(text, width)


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 6))
def test_tree_search_is_exact_at_factor_one(seed, n, k):
    rng = np.random.default_rng(seed)
    every = rng.integers(0, 4, (n, 3)).astype(float)
    points, point = np.unique(every, axis=0, return_inverse=True)
    nodes, order = vantage.build(points)
    shard = vantage.Shard(np.arange(n), point.reshape(-1), points, nodes, order)
    best, found = shard.search(every[:5], np.arange(min(5, n)), k, 1.0)
    for q in range(min(5, n)):
        want = sorted((float(np.sqrt(((every[q] - every[j]) ** 2).sum())), j) for j in range(n) if j != q)[:k]
        assert [(d, i) for d, i in zip(best[q].tolist(), found[q].tolist()) if np.isfinite(d)] == want


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for radius in (0, 1, 3, 5, 8):
        for total in (100, 10**6, 10**9):
            chosen = fingerprints.plan(sample, total, radius)
            assert sum(t for _, t in chosen) >= radius - len(chosen) + 1
            bits = collections.Counter(b for g, _ in chosen for b in g)
            assert len(bits) == 64 and set(bits.values()) == {1}
