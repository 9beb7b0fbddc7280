import collections

import numpy as np
import public_tokenizers

from tests.llm import brute
from vigil.llm import bpe, fingerprints, packing, quality_rules, queries, simple8b, token_files
from vigil.llm.components import connected

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_rules_counts(spark, sf, odd, empty, work):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, sf).collect()}
    for i, text in texts(spark, sf):
        want = brute.base_counts(text)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i].base_failed and got[i].kept)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = quality_rules.judge(odd, work).collect()
    key = lambda c: (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], c["base_failed"])
    assert sorted(map(key, found)) == sorted(key(brute.base_counts(t)) for _, t in rows)
    assert quality_rules.judge(empty, work).count() == 0


def test_rules_weigh_votes():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.7, 0.55, 0.8])
    right = rng.random((4000, 5)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((4000, 5)) < 0.8)
    prior, table = quality_rules.fit(votes, np.ones(4000))
    good = quality_rules.posterior(votes, prior, table) >= 0.5
    assert abs(prior - 0.8) < 0.05 and (good == truth).mean() > 0.9
    learned = table[1, :, 2] / (table[1, :, 0] + table[1, :, 2])
    assert (np.abs(learned - accuracy) < 0.08).all()


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 7000):
        for most in (1, 50_000, 2**59, 2**63):
            ids = rng.integers(0, most, n, dtype=np.uint64, endpoint=True)
            ids[::11] = rng.integers(0, 2**63, len(ids[::11]), dtype=np.uint64)
            words, first = simple8b.encode(ids)
            assert (simple8b.decode(words, first, n) == ids).all()


def check_token_files(rows, found):
    want = collections.Counter((i, len(x := [*brute.ids_of(t), 2]), brute.crc_of(x)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    before = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_files(spark, sf, odd, empty, work):
    check_token_files(texts(spark, sf), queries.op3_token_files(spark, sf).collect())
    check_token_files([(r.doc_id, r.text) for r in odd.collect()], token_files.read_token_files(token_files.write_token_files(odd, PATH, 2, work)).collect())
    assert token_files.read_token_files(token_files.write_token_files(empty, PATH, 2, work)).count() == 0


def check_packing(rows, found, capacity):
    by_text = collections.Counter()
    for _, t in rows:
        ids = [*brute.ids_of(t), 2]
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            by_text[(p, a, b - a, brute.crc_of(ids[a:b]))] += 1
    assert collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in found) == by_text
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, sf, odd, empty, work, monkeypatch):
    found = queries.op4_packing(spark, sf).collect()
    n = check_packing(texts(spark, sf), found, 1024)
    assert n <= 1.02 * sum(r.length for r in found) / 1024 + 1
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(rows, packing.pack(odd, PATH, 2, 1024, work).collect(), 1024)
    assert packing.pack(empty, PATH, 2, 1024, work).count() == 0
    # many small partitions, so that those with gaps exchange pieces
    monkeypatch.setattr(packing, "PARTITION_PIECES", 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = packing.pack(docs, PATH, 2, 1024, work).collect()
    assert check_packing(texts(spark, sf), again, 1024) <= 1.02 * n + 1


def test_packing_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 65, rng.integers(1, 60))
        _, _, fills = packing.best_fit_decreasing(lengths, 64)
        bound = packing.lower_bound(np.bincount(lengths, minlength=65), 64)
        assert -(-lengths.sum() // 64) <= bound <= len(fills)
    assert packing.lower_bound(np.bincount([34] * 7, minlength=65), 64) == 7


def test_bpe(spark, sf, odd, empty):
    for rows, found in ((texts(spark, sf), queries.op5_bpe(spark, sf)), ([(r.doc_id, r.text) for r in odd.collect()], bpe.encode_and_decode(odd, PATH))):
        want = collections.Counter((i, *brute.digests(t)) for i, t in rows)
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == want
    assert bpe.encode_and_decode(empty, PATH).count() == 0


def check_simhash(rows, found, width, radius):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute.fingerprint(t, width) for _, t in rows]
    named = brute.components(prints, radius)
    want = collections.Counter((i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, named))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want


def test_simhash(spark, sf, odd, empty, work, monkeypatch):
    check_simhash(texts(spark, sf), queries.op8_simhash(spark, sf).collect(), 3, 3)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_simhash(rows, fingerprints.near_duplicates(odd, 3, 3, work).collect(), 3, 3)
    assert fingerprints.near_duplicates(empty, 3, 3, work).count() == 0
    monkeypatch.setattr(fingerprints, "BUCKET", 3)
    check_simhash(texts(spark, sf), queries.op8_simhash(spark, sf).collect(), 3, 3)


def test_links_connect_all_that_is_near(spark, work, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres, *(centres[rng.integers(0, 3, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(2)), centres[:9] ^ np.uint64(0xE000000000000001)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").cache()
    for bucket, radius in ((1000, 3), (20, 3), (1000, 5)):
        monkeypatch.setattr(fingerprints, "BUCKET", bucket)
        roots = {r.node: r.root for r in connected(fingerprints.links(table, radius, work).distinct(), work).collect()}
        got = collections.defaultdict(set)
        for x in fps.view(np.int64).tolist():
            got[roots.get(x, x)].add(x)
        want = collections.defaultdict(set)
        for x, c in zip(fps.view(np.int64).tolist(), brute.components(fps, radius)):
            want[c].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark, work):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001)]
    roots = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long"), work).collect()}
    assert set(roots.values()) == {0, 1000, 5000} and roots[200] == 0 and roots[1299] == 1000
