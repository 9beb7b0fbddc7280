"""Hot keys, clashing names, odd rows, and learned parts against plain versions."""

import collections
import math

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm import brute
from vigil.llm import fingerprints, line_runs, packing, quality_classifier, quality_rules, queries, token_files
from vigil.llm.shared import Workspace, workspaces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equal_rows_are_dealt_evenly(spark, work, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 50)
    docs = spark.createDataFrame([(7, "one and the same text")] * 300, "doc_id long, text string")
    found = packing.pack(docs, PATH, 2, 64, work).collect()
    sizes = collections.Counter(r.sequence_id >> 32 for r in found)
    assert len(found) == 300 and max(sizes.values()) < 100
    n = len(brute.ids_of("one and the same text")) + 1
    assert len({r.sequence_id for r in found}) <= -(-300 // (64 // n)) + 2
    assert all(r.partition_bound <= r.partition_bins and r.certified == (r.partition_bound == r.partition_bins) for r in found)


def test_equal_rows_go_to_several_files(spark, work):
    docs = spark.range(4000).selectExpr("5L AS doc_id", "repeat('same words ', 20) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs, PATH, 2, work)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and max(r.documents for r in manifest.collect()) < 3000
    found = token_files.read_token_files(manifest).collect()
    assert len(found) == 4000 and len({r.start for r in found}) == 4000 and len({r.ids_crc32 for r in found}) == 1


NAMES = ["_score", "score", "row", "fp", "node", "bands", "doc", "tie", "runs", "new", "pattern", "quality", "accepted", "n_words", "measured_text", "carried_0", "n_lines", "n_deleted", "_row", "_fp", "_doc", "_tie", "_new", "_runs", "a b.c"]


def test_columns_of_any_name_pass_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    wide = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in NAMES))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = {r.doc_id: r.text for r in stage(spark, docs, sf).collect()}
        found = stage(spark, wide, sf)
        assert found.columns == wide.columns
        rows = found.collect()
        assert {r.doc_id: r.text for r in rows} == plain
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert line_runs.remove_repeated_runs(wide, Workspace(spark)).columns == [*(c for c in wide.columns if c not in ("n_lines", "n_deleted")), "n_lines", "n_deleted"]
    assert fingerprints.one_of_each(wide, 5, 3, Workspace(spark)).columns == wide.columns


def test_stages_on_odd_rows(spark, sf, odd):
    lined = corpus_pipeline.dedupe_lines(spark, odd, sf).collect()
    # of the two equal long texts the later one goes, as do later copies of other texts of eight words; nulls stay
    assert collections.Counter(r.doc_id for r in lined) == collections.Counter([1, 2, 3, None, None, 4, 6, 6, 7, 8, 9, 10])
    assert {r.text for r in lined if r.doc_id in (2, None)} == {None, "the end of it"}
    deduped = corpus_pipeline.dedupe_documents(spark, odd, sf).collect()
    assert collections.Counter(r.doc_id for r in deduped) == collections.Counter([1, 2, None, 4, 6, 8, 10])
    ruled = corpus_pipeline.apply_rules(spark, odd, sf)
    assert set(ruled.columns) == set(odd.columns) and ruled.where("doc_id = 10").count() == 0


def test_workspaces_leave_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    made = []
    with workspaces():
        work = Workspace(spark)
        made.append(work.root.removeprefix("file://"))
        n = line_runs.without_repeated_runs(docs, work).count()
    import os

    assert n > 0 and not os.path.exists(made[0])


def plain_kept(rows):
    """The posterior of each document by expectation-maximisation over documents, vote by vote."""
    votes = [tuple(v) for v in rows]
    n, rules = len(votes), len(votes[0])
    held = [quality_rules.BAD, quality_rules.GOOD]
    share, table = quality_rules.SHARE, [[list(held[c]) for _ in range(rules)] for c in range(2)]
    for _ in range(500):
        good = [posterior(v, share, table) for v in votes]
        weights = [w * n for w in quality_rules.WEIGHTS]
        new_share = (sum(good) + quality_rules.SHARE * sum(weights)) / (n + sum(weights))
        new = []
        for c in range(2):
            new.append([])
            for r in range(rules):
                counts = [weights[c] * held[c][x] for x in range(3)]
                for v, g in zip(votes, good):
                    counts[v[r] + 1] += g if c else 1 - g
                new[-1].append([x / sum(counts) for x in counts])
        moved = max([abs(new_share - share), *(abs(a - b) for c in range(2) for r in range(rules) for a, b in zip(new[c][r], table[c][r]))])
        share, table = new_share, new
        if moved < 1e-12:
            break
    return [posterior(v, share, table) for v in votes]


def posterior(vote, share, table):
    logs = [math.log(p) + sum(math.log(table[c][r][v + 1]) for r, v in enumerate(vote)) for c, p in enumerate((1 - share, share))]
    return 1 / (1 + math.exp(max(-500, min(500, logs[0] - logs[1]))))


def test_posteriors_against_a_plain_version(spark, sf, work):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = quality_rules.measure(docs.select("doc_id", F.col("text").alias("measured_text")))
    rows = measured.select("doc_id", *(v().alias(f"v{i}") for i, v in enumerate(quality_rules.RULES.values()))).collect()
    want = dict(zip((r[0] for r in rows), plain_kept([r[1:] for r in rows])))
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, p in want.items():
        assert got[i].quality == pytest.approx(p, abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and p >= quality_rules.LEAST)


def plain_log_odds(text, part):
    """What a text's features add, feature by feature."""
    words = text.encode().split()
    if not words:
        return 0.0
    buckets, sizes, hashes, shapes = quality_classifier.word_features(words)
    total = float(np.mean([part[b] for b in buckets]))
    if len(words) > 1:
        pairs, kinds = [], []
        for i in range(len(words) - 1):
            a, b = quality_classifier.pair_buckets(hashes[i : i + 2], shapes[i : i + 2])
            pairs.append(part[a[0]])
            kinds.append(part[b[0]])
        total += float(np.mean(pairs)) + float(np.mean(kinds))
    return total


def test_scores_against_a_plain_version(spark, sf):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    part = rng.normal(size=quality_classifier.ALL)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()[:60]] + ["", " ", "one", "the the the", "É é\x1cx"]
    got = quality_classifier.Words(part).log_odds(pa.array([*texts, None]))
    assert np.allclose(got, [*(plain_log_odds(t, part) for t in texts), 0.0])
    for text in texts:
        b, c = quality_classifier.counted(text.encode())
        assert np.isclose(part[b] @ quality_classifier.shares(b, c) if len(b) else 0.0, plain_log_odds(text, part), atol=1e-4)


def test_training_step_is_the_gradient(monkeypatch):
    """One step of one batch against numerical slopes of the loss."""
    monkeypatch.setattr(quality_classifier, "EPOCHS", 1)
    monkeypatch.setattr(quality_classifier, "BATCH", 100)
    texts = [(1, b"good words here"), (0, b"bad bad bad"), (1, b"more good text"), (0, b"bad text")]
    docs = [(q, *quality_classifier.counted(t)) for q, t in texts]
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 1 / quality_classifier.DIM, (quality_classifier.ALL, quality_classifier.DIM)).astype(np.float32).astype(float)
    means = np.stack([quality_classifier.shares(b, c) @ vectors[b] for _, b, c in docs])
    labels = np.array([q for q, _ in texts])

    def loss(layer):
        scores = means @ layer.T
        return -np.mean([s[q] - np.log(np.exp(s).sum()) for s, q in zip(scores, labels)])

    slope = np.zeros((2, quality_classifier.DIM))
    for i in np.ndindex(*slope.shape):
        step = np.zeros_like(slope)
        step[i] = 1e-5
        slope[i] = (loss(step) - loss(-step)) / 2e-5
    # from a layer of zeros, the vectors' own slopes are zero and the layer moves against its slope
    layer = -quality_classifier.RATE * slope / np.sqrt(1e-6 + (slope**2).mean())
    part, _ = quality_classifier.train(docs)
    assert np.allclose(part, vectors @ (layer[1] - layer[0]), atol=2e-3)


def test_trained_scores_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, 0), (6, 5, 0), (4, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(odd, labels).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(round(r.score, 9))
    assert by[2] == by[3] == by[7] and len(by[6]) == 1 and by[4] == by[5]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality_classifier.LEAST) for r in rows)
    alone = quality_classifier.classify(odd, labels.where("quality = 1")).collect()
    assert len({r.score for r in alone}) == 1
