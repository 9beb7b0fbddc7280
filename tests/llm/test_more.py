import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm import brute
from vigil.llm import fingerprints, licences, line_runs, quality_classifier, quality_rules, queries, vantage, warc


def check_warc(rows, found):
    holder = {}
    for page, html in rows:
        key = html or ""
        holder[key] = max(holder.get(key, (-1, None)), (-1 if page is None else page, page))
    want, used = collections.Counter(), set()
    for page, html in rows:
        raw, key = (html or "").encode(), html or ""
        response = holder[key][1] == page and key not in used
        if response:
            used.add(key)
        want[(page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else holder[key][1])] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want


def test_warc(spark, sf, work):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    check_warc([(r.page_id, r.html) for r in pages.collect()], queries.op2_warc(spark, sf).collect())
    rows = [(1, "a", None), (2, "http://x/ y\n", "same"), (3, None, "same"), (None, "u", "same"), (4, "u", ""), (5, "u", None), (6, "u", "é" * 700_000), (7, "u", "é" * 700_000), (8, "u", "once"), (8, "u", "once")]
    odd = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    check_warc([(r[0], r[2]) for r in rows], warc.round_trip(odd, work).collect())
    assert warc.round_trip(odd.limit(0), work).count() == 0


def test_warc_equals_its_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = db.execute(queries.oracle_sql()["op2_warc"])
    names = [d[0] for d in want.description]
    found = queries.op2_warc(spark, sf)
    assert set(found.columns) == set(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())


def test_warc_chunks_carry_digests():
    payload = bytes(range(256)) * 50
    rows = list(warc.chunk_rows(payload, 1000))
    assert b"".join(r[1] for r in rows) == payload and [r[4] for r in rows] == [False] * 12 + [True]
    assert all(r[3] == warc.base32(hashlib.sha1(payload[: r[2]]).digest()) for r in rows)


def plain_nearest(rows, k, every):
    """Every row is a candidate but the query's own; rows that repeat an id are queries of their own."""
    rows = [(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            away = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))
            for rank, (d, j) in enumerate(away[:k], 1):
                yield i, rank, j, d


def check_nearest(found, want):
    found, want = sorted(map(tuple, found)), sorted(want)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert np.allclose([f[3] for f in found], [w[3] for w in want], rtol=1e-12)


def test_nearest(spark, sf, work, monkeypatch):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = list(plain_nearest([(r.vec_id, r.embedding) for r in vectors.collect()], 10, 100))
    check_nearest(queries.op6_vantage_trees(spark, sf).collect(), want)
    monkeypatch.setattr(vantage, "SHARD", 60)
    monkeypatch.setattr(vantage, "QUERY_BLOCK", 2)
    check_nearest(vantage.nearest(vectors, work, factor=1.0).collect(), want)
    # a larger factor leaves out more and still finds most
    near = {(q, v) for q, _, v, _ in vantage.nearest(vectors, work, factor=1.5).collect()}
    assert len(near & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_leaves_are_left_out(spark, work, monkeypatch):
    """Vectors in far-off clusters: results are exact and a query meets few of the shards."""
    monkeypatch.setattr(vantage, "SHARD", 100)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) + 100 * (i % 12 == np.arange(12))[:4] + 50 * (i % 12)).tolist()) for i in range(2400)] + [(5000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []
    searched = vantage._searched
    monkeypatch.setattr(vantage, "_searched", lambda asked, *rest: (met.append(asked.count()), searched(asked, *rest))[1])
    check_nearest(vantage.nearest(table, work).collect(), list(plain_nearest(rows, 10, 100)))
    assert met[0] == 29 and met[1] < 0.4 * 29 * 28


def test_crowded_leaves_are_split_into_shells(spark, work, monkeypatch):
    """Few leaves and many vectors, some of them equal: results are exact and a query meets few of the shards."""
    monkeypatch.setattr(vantage, "SHARD", 50)
    monkeypatch.setattr(vantage, "TOP_LEAVES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.uniform(0, 1000, 3)).tolist()) for i in range(2500)] + [(5000 + i, [1.0, 2.0, 3.0]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met, write = {}, work.table

    def kept(df, name):
        found = write(df, name)
        met.setdefault(name, []).append(found.count())
        return found

    monkeypatch.setattr(work, "table", kept)
    check_nearest(vantage.nearest(table, work).collect(), list(plain_nearest(rows, 10, 100)))
    assert met["shards"][0] >= 50 and met["pairs"][0] == 29 and met["pairs"][1] < 0.5 * 29 * met["shards"][0]


def test_nearest_odd_rows(spark, work, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0]) for i in range(150)] + [(200 + i, rng.integers(0, 3, 2).astype(float).tolist()) for i in range(120)]
    rows += [(400, None), (401, []), (402, [0.0, 0.0]), (403, [1.0, None]), (404, [float("nan"), 1.0]), (None, [1.0, 1.0]), (500, [1.0, 2.0, 3.0]), (501, [1.0, 2.0, 4.0]), (200, rows[150][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, shard int")
    check_nearest(vantage.nearest(table, work).collect(), list(plain_nearest(rows, 10, 100)))
    assert vantage.nearest(table.limit(0), work).count() == 0


def plain_runs(docs, least_words):
    """The lines to remove, straight from the definition: runs of enough words with an earlier copy."""
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64))
    docs = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))
    lines = [line_runs.lines_of(t or "") for _, t in docs]
    words = [[len(s.encode().split()) for s in x] for x in lines]
    seen, gone = set(), [set() for _ in docs]
    places = [(d, s, e) for d, x in enumerate(lines) for s in range(len(x)) for e in range(s + 1, len(x) + 1) if sum(words[d][s:e]) >= least_words]
    for d, s, e in sorted(places, key=lambda p: (p[0], p[1], p[2])):
        run = tuple(lines[d][s:e])
        if run in seen:
            gone[d] |= set(range(s, e))
        seen.add(run)
    return {(i, t): [s for n, s in enumerate(x) if n not in g] for (i, t), x, g in zip(docs, lines, gone)}, {(i, t): (len(x), len(g)) for (i, t), x, g in zip(docs, lines, gone)}


def check_runs(spark, docs, least_words, work):
    table = spark.createDataFrame([(i, t, "s", 7) for i, t in docs], "doc_id long, text string, doc string, n_lines int")
    found = line_runs.remove_repeated_runs(table.withColumn("before", table.text), work, least_words).collect()
    kept, counts = plain_runs(docs, least_words)
    assert len(found) == len(docs)
    for r in found:
        assert counts[(r.doc_id, r.before)] == (r.n_lines, r.n_deleted)
        assert line_runs.lines_of(r.text or "") == kept[(r.doc_id, r.before)]


def test_line_runs(spark, work):
    rng = np.random.default_rng(4)
    pool = ["a", "b b", "c c c", "d d d d d", "e e e e e e e e e", "f f", "g", ""]
    docs = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 12)))) for i in range(60)]
    docs += [(100, "x x x x\nx x x x\nx x x x\nx x x x"), (101, None), (102, ""), (None, docs[3][1]), (None, docs[4][1]), (7, docs[7][1])]
    check_runs(spark, docs, 8, work)
    check_runs(spark, docs, 1, work)
    check_runs(spark, docs, 14, work)


def test_line_runs_on_documents(spark, sf, work, odd, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text.split("\n")) < 40]
    check_runs(spark, docs, 8, work)
    found = line_runs.remove_repeated_runs(odd, work).collect()
    assert len(found) == odd.count()
    assert line_runs.remove_repeated_runs(empty, work).count() == 0


def test_licences(spark, sf, odd, empty):
    texts = [(1, "Some text here.\nReleased under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "This work is licensed under the Frobnicate Terms, edition nine."), (6, "All rights reserved.\nLicensed under the Apache License, Version 2.0."), (7, "word of the day and the version of it " * 3000)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, families int")).collect()}
    assert [got[i].families for i in range(1, 8)] == ["MIT", "CC-BY-NC", "", "", "", "Apache-2.0,proprietary", ""]
    assert got[5].n_unknown == 1 and got[1].n_paragraphs == 3 and got[3].n_paragraphs == 0
    known = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "proprietary"}
    found = {r.doc_id: r.families for r in queries.op9_licences(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert found[r.doc_id] == ",".join(sorted({f for t, f in known.items() if t in r.text.split("\n")}))
    assert licences.scan(odd).count() == odd.count() and licences.scan(empty).count() == 0


def test_quality_classifier_holds_out(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op10_quality_classifier(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    labels = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in labels]) >= 0.95
    assert all(r.predicted for q, r in labels if q == 1)


def test_quality_classifier_odd_rows(spark, odd, empty, work):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, 0), (6, 5, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(odd, labels).count() == odd.count()
    assert quality_classifier.classify(odd, labels.limit(0)).where("score is null").count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
    assert set(quality_classifier.accept(odd, labels).columns) == set(odd.columns)


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        out.append(docs.collect())
    return out


def test_pipeline_stages(spark, sf, stages):
    before, classified, ruled, lined, deduped, packed = stages
    scores = {r.doc_id: r.predicted for r in queries.op10_quality_classifier(spark, sf).collect()}
    assert sorted(r.doc_id for r in classified) == sorted(r.doc_id for r in before if scores[r.doc_id])
    # the stage goes by the posterior alone, so that short clean documents stay
    verdict = {r.doc_id: r.quality >= quality_rules.LEAST for r in quality_rules.judge(spark.createDataFrame(classified), work_of(spark)).collect()}
    assert sorted(map(tuple, ruled)) == sorted(tuple(r) for r in classified if verdict[r.doc_id])
    kept, _ = plain_runs([(r.doc_id, r.text) for r in ruled], line_runs.LEAST_WORDS)
    want = {i: lines for (i, _), lines in kept.items() if lines}
    assert {r.doc_id: line_runs.lines_of(r.text) for r in lined} == want
    prints = [brute.fingerprint(r.text, corpus_pipeline.WIDTH) for r in sorted(lined, key=lambda r: r.doc_id)]
    named = brute.components(prints, corpus_pipeline.RADIUS)
    ids = sorted(r.doc_id for r in lined)
    assert sorted(r.doc_id for r in deduped) == [i for n, i in enumerate(ids) if named[n] == n]
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in deduped)
    assert {tuple(r.asDict()) for part in stages[:-1] for r in part[:1]} == {("doc_id", "text", "lang", "source", "n_chars")}


def work_of(spark):
    from vigil.llm.shared import Workspace

    return Workspace(spark)


def test_pipeline_runs_and_takes_odd_rows(spark, sf, odd, empty, stages):
    assert corpus_pipeline.run(spark, sf).count() == len(stages[-1])
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf)
            assert found.count() <= docs.count() + 200
            if stage is not corpus_pipeline.pack:
                assert found.columns == docs.columns
    copies = fingerprints.one_of_each(odd, 5, 3, work_of(spark)).collect()
    assert sum(r.text is not None and r.text.startswith("xxx") for r in copies) == 1
