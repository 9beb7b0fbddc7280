"""Hand cases and properties of single operators."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions import computed
from vigil.operators import changes, lineage, mapping, observables, parsing, profiling, threat, vectors
from vigil.plans.model import Attribute, Entity, Filter, Metric, Model, Relationship, SemanticQuery, validate
from vigil.plans.semantic import resolve_time, run


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


LINES = [
    (1, '{"a": {"b": [1, "x", null]}, "ok": true, "n": -1.5}'),
    (2, "name,age\nalice,30"),
    (3, "Jan  1 00:00:00 host1 sshd[99]: failed user=root from='a b'"),
    (4, "2024-01-01T00:00:00+02:00 h2 cron: done"),
    (5, 'a=1 b="two words" c=\'x\' a=2'),
    (6, "nothing to see"),
    (7, ""),
    (8, "[1, 2]"),
    (9, "{broken a=1"),
    (10, 'h1,,"q, ""z"""\n1,2'),
    (11, "only,header"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "id long, raw string")


def test_log_formats(lines):
    got = dict(values(lines.select("id", parsing.detect_log_format("raw").alias("f")), "id", "f"))
    assert got == {1: "json", 2: "csv", 3: "syslog", 4: "syslog", 5: "kv", 6: "json", 7: "json", 8: "json", 9: "kv", 10: "json", 11: "json"}


def test_flatten_json(lines):
    got = values(parsing.flatten_json(lines.where("id IN (1, 8, 9)"), "id", "raw"), "id", "path", "value", "type")
    assert got == sorted([(1, "a.b", '[1,"x",null]', "array"), (1, "a.b[0]", "1", "number"), (1, "a.b[1]", "x", "string"), (1, "a.b[2]", "null", "null"), (1, "ok", "true", "boolean"), (1, "n", "-1.5", "number"), (8, "root", "[1,2]", "array"), (8, "[0]", "1", "number"), (8, "[1]", "2", "number")])


def test_parse_syslog(lines):
    got = values(parsing.parse_syslog(lines.where("id IN (3, 4, 6, 7)"), "id", "raw"), "id", "path", "value", "type")
    assert (3, "timestamp", "Jan  1 00:00:00", "string") in got and (3, "pid", "99", "number") in got and (3, "message.user", "root", "string") in got and (3, "message.from", "a b", "string") in got
    assert [x[1:] for x in got if x[0] == 4] == [("hostname", "h2", "string"), ("message", "done", "string"), ("process", "cron", "string"), ("timestamp", "2024-01-01T00:00:00+02:00", "string")]
    assert [x[1:] for x in got if x[0] == 6] == [("raw", "nothing to see", "string")] and not [x for x in got if x[0] == 7]


def test_parse_kv_and_csv(lines):
    assert values(parsing.parse_kv(lines.where("id = 5"), "id", "raw"), "position", "path", "value", "type") == [(0, "a", "1", "number"), (1, "b", "two words", "string"), (2, "c", "x", "string"), (3, "a", "2", "number")]
    got = values(parsing.parse_csv(lines.where("id IN (2, 10, 11)"), "id", "raw"), "id", "position", "path", "value", "type")
    assert got == [(2, 0, "name", "alice", "string"), (2, 1, "age", "30", "number"), (10, 0, "h1", "1", "number"), (10, 1, "column_1", "2", "number"), (10, 2, 'q, "z"', "", "null"), (11, 0, "only", "", "string"), (11, 1, "header", "", "string")]


def test_computed_fields(spark):
    df = spark.createDataFrame([("aEb.c1",), ("",), (None,), ("1234a",), ("a.b.c.d",)], "h string")
    got = df.select(computed.vowel_count("h").alias("v"), computed.subdomain_depth("h").alias("d"), computed.is_numeric_heavy("h").alias("n"), F.round(computed.shannon_entropy("h"), 4).alias("e")).collect()
    assert [r.v for r in got] == [2, 0, None, 1, 1] and [r.d for r in got] == [0, -1, None, -1, 2] and [r.n for r in got] == [False, False, False, True, False]
    assert got[0].e == 2.585 and got[1].e is None
    assert df.limit(1).select(computed.host_suffixes("h")).first()[0] == ["aEb.c1", "c1"]


def test_feed_join_plans_no_nested_loop(spark):
    events = spark.createDataFrame([("u1", "a.evil.com"), ("u2", "evil.com"), ("u3", "notevil.com"), ("u4", None)], "uid string, host string")
    feed = spark.createDataFrame([("evil.com", "domain", 1), ("com", "ip", 2), ("a.evil.com", "domain", 3)], "indicator string, indicator_type string, confidence int")
    found = threat.ioc_lookup(events, feed, "domain", ["host"])
    assert values(found.fillna(0), "uid", "confidence") == [("u1", 1), ("u1", 3), ("u2", 1), ("u3", 0), ("u4", 0)]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_observables_are_unique_and_flagged(spark):
    events = spark.createDataFrame([("e1", 4003, datetime(2024, 1, 1), "10.0.0.1", "x", [("10.0.0.1", 2), (None, 2)])], "metadata_uid string, class_uid int, time timestamp_ntz, ip string, note string, obs array<struct<value: string, type_id: int>>")
    got = observables.extract_observables(events, {2: ("IP Address", ("ip", "note"))}).collect()
    assert len({r.observable_id for r in got}) == 2
    fields = spark.createDataFrame([("description", "x", "string"), ("src.ip", "x", "string"), ("a.v", "aa-bb-cc-dd-ee-ff", "string"), ("a.n", "1.1.1.1", "number"), ("machine", "d41d8cd98f00b204e9800998ecf8427e", "string"), ("file_hash", "http://x", "string")], "path string, value string, type string")
    assert values(observables.flag_observables(fields), "path", "observable_type", "confidence", "matched_by") == [("a.v", "mac", "Medium", "value"), ("file_hash", "hash", "High", "both"), ("machine", "hash", "Medium", "value"), ("src.ip", "ip", "High", "name")]
    text = spark.createDataFrame([(1, "mail a.b@c.org, see http://x.y/z?q=1 at 10.1.2.3 or 1.2.3.4.5 d41d8cd98f00b204e9800998ecf8427e")], "id int, text string")
    assert values(observables.scan_text_observables(text, "id", "text"), "observable_type", "value") == [("email", "a.b@c.org"), ("hash", "d41d8cd98f00b204e9800998ecf8427e"), ("ip", "10.1.2.3"), ("url", "http://x.y/z?q=1")]


def test_model_is_checked_before_any_job():
    model = Model.from_dict({"entities": [{"name": "e", "attributes": [{"name": "a"}, {"name": "m", "dimension": False}]}], "metrics": [{"name": "n", "entity": "e"}, {"name": "x", "entity": "e", "formula": "y"}, {"name": "y", "entity": "e", "formula": "x"}]})
    for q, what in (
        (SemanticQuery("z", ("a",)), "no entity"),
        (SemanticQuery("e"), "at least one"),
        (SemanticQuery("e", ("b",)), "no attribute"),
        (SemanticQuery("e", ("a",), group_by=("m",)), "not a dimension"),
        (SemanticQuery("e", ("a",), filters=(Filter("a", "~"),)), "no operator"),
        (SemanticQuery("e", metrics=("x",)), "circle"),
        (SemanticQuery("e", metrics=("q",)), "no metric"),
        (SemanticQuery("e", ("a",), time_granularity="year"), "no granularity"),
        (SemanticQuery("e", metrics=("n",), path="hot"), "hot path"),
    ):
        with pytest.raises(ValueError, match=what):
            validate(q, model)
    twice = Entity("e", (Attribute("a"),), (Relationship("r", "t", "x"), Relationship("s", "t", "y")))
    with pytest.raises(ValueError, match="aliases"):
        validate(SemanticQuery("e", ("a",)), Model.of([twice, Entity("t", ())], []))


def test_relative_times():
    now = datetime(2024, 5, 1)
    assert resolve_time("now", now) == now and resolve_time("-7d", now) == datetime(2024, 4, 24) and resolve_time("-90m", now) == datetime(2024, 4, 30, 22, 30)
    assert resolve_time("soon", now) is None and resolve_time("2024-01-01", now) == datetime(2024, 1, 1)


def test_filters_are_values_not_sql(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "a string")
    model = Model.of([Entity("e", (Attribute("a"),))], [])
    got = run(SemanticQuery("e", ("a",), filters=(Filter("a", "=", "x' OR '1'='1"),)), model, lambda n: df)
    assert values(got, "a") == [("x' OR '1'='1",)]


def test_mapping_threshold_and_casts(spark):
    df = spark.createDataFrame([(" A ", "7", "x")], "s string, n string, bad string")
    specs = [mapping.Spec("s", "user.name", "trim"), mapping.Spec("n", "user.n", "cast:BigInt"), mapping.Spec("bad", "v", "cast:Double"), mapping.Spec("s", "low", "lower", 0.2)]
    row = mapping.apply_mapping(df, specs, 3002, 3, keep_raw=True).first()
    assert row.user.name == "A" and row.user.n == 7 and row.v is None and row.class_uid == 3002 and "low" not in row.asDict() and '"s":" A "' in row._raw_event
    with pytest.raises(ValueError, match="threshold"):
        mapping.apply_mapping(df, specs[3:], 1, 1)
    with pytest.raises(ValueError, match="no transformation"):
        mapping.apply_mapping(df, [mapping.Spec("s", "t", "reverse")], 1, 1)


def test_statistics_of_an_empty_table(spark):
    got = profiling.column_statistics(spark.createDataFrame([], "a long, b string"), "t").collect()
    assert [(r.column_name, r.total_count, r.null_rate, r.cardinality) for r in got] == [("a", 0, 0.0, 0.0), ("b", 0, 0.0, 0.0)]


def test_connected_nodes(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("c", "b", "x"), ("c", "d", "y"), ("d", "a", "z")], "source string, target string, edge_type string")
    assert values(lineage.connected_nodes(edges, ["a"], 2, ["x", "y"]), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert values(lineage.connected_nodes(edges, ["a"], 5), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]


def test_diff_and_merge(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", 1)], "k int, v string, n int")
    assert values(changes.snapshot_diff(old, new, ["k"], ["v", "n"]), "k", "change", "reason") == [(2, "modified", "v,n"), (3, "removed", ""), (4, "added", "")]
    assert values(changes.merge_newest(old.fillna(0), new.fillna(0), ["k"], "n"), "k", "v") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError, match="repeats"):
        changes.assert_unique(old.unionAll(old), ["k"])


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id long, vector array<float>")
    got = values(vectors.cosine_topk(df, df, 2, 2), "query_id", "rank", "id", "score")
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (4, 1, 4, 1.0), (4, 2, 1, 0.0)]
    assert vectors.cosine_topk(df, df, 0, 2).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.cosine_topk(df, df, 1, 3).collect()
    texts = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "t string").select(vectors.hash_embedding("t", 16).alias("v")).collect()
    assert texts[0].v == texts[1].v != texts[2].v and texts[3].v is None and texts[4].v is None
    assert abs(sum(x * x for x in texts[0].v) - 1) < 1e-5


def test_boosts_follow_the_order_of_steps(spark):
    confirmed = spark.createDataFrame([(1, "f", "t"), (2, "f", "t"), (3, "g", "u"), (4, "f", "t")], "step long, field string, target string")
    near = spark.createDataFrame([("g", "t", 0.8), ("f", "w", 0.4), ("f", "t", 0.9)], "field string, id string, score double")
    got = {t: round(b, 6) for t, b in values(vectors.learn_boosts(confirmed, near), "target", "boost")}
    assert got == {"t": 0.5, "u": 0.2}


def test_coverage_names_its_gaps(spark):
    paths = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "path string")
    mappings = spark.createDataFrame([("c", "High"), ("y", "High"), ("x", "Low")], "target string, confidence string")
    found = profiling.mapping_coverage(paths, mappings).first()
    assert (found.unmapped_paths, found.unobserved_targets) == (["a", "b"], ["x", "y"])
    assert [round(x, 6) for x in found[:3]] == [33.333333, 66.666667, 66.666667]
    assert profiling.mapping_coverage(paths.limit(0), mappings.limit(0)).first()[:] == (0.0, 0.0, 0.0, [], [])


def test_semantic_search_gives_what_all_pairs_give(spark):
    texts = spark.createDataFrame([(i, f"text {i % 7}" if i % 3 else f"own {i}") for i in range(60)] + [(90, None), (91, "")], "id long, text string")
    asked = texts.where("id % 4 <> 0")
    embed = lambda df: df.where(F.length("text") > 0).select("id", vectors.hash_embedding("text", 16).alias("vector"))
    shape = lambda df: values(df.withColumn("score", F.round("score", 6)), "query_id", "rank", "id", "score")
    want = shape(vectors.cosine_topk(embed(asked), embed(texts), 4, 16, but_own=True))
    assert shape(vectors.semantic_search(asked, texts, 4, 16, but_own=True)) == want
    near = vectors.semantic_search(asked, texts, 4, 16, but_own=True, min_score=0.99999)
    assert shape(near) == [r for r in want if r[3] >= 0.99999] != []
    shuffled = [x for x in near._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert shuffled and not any("vector" in x for x in shuffled)


def test_near_cells_lose_no_pair(spark):
    """Vectors of a few coordinates, so that many lie near each other."""
    texts = spark.range(3000).selectExpr("id", "'t' || id AS text")
    want = vectors.semantic_search(texts.where("id < 100"), texts, 3000, 3, min_score=0.99)
    want = {(r.query_id, r.id): round(r.score, 9) for r in want.collect() if r.score >= 0.9999}
    got = {(r.query_id, r.id): round(r.score, 9) for r in vectors.semantic_search(texts.where("id < 100"), texts, 3000, 3, min_score=0.9999).collect()}
    assert got == want and len(want) > 110


def test_block_scores_are_held_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 5)).round(1), np.repeat(rng.normal(size=(40, 5)).round(1), 2, axis=0)
    y[7] = 0
    a, b = (pd.DataFrame({"id": range(len(v)), "vector": list(v)}) for v in (x, y))
    seen = []
    monkeypatch.setattr(vectors, "PAIRS", 400)
    monkeypatch.setattr(np, "partition", lambda v, *p, f=np.partition, **o: (seen.append(v.size), f(v, *p, **o))[1])
    got = vectors.best_of_blocks(3, True)(a, b)
    score = np.divide((x[:, None] * y[None]).sum(2), (n := np.sqrt((x**2).sum(1))[:, None] * np.sqrt((y**2).sum(1))), out=np.zeros(n.shape), where=n > 0)
    want = [(i, j, round(score[i, j], 9)) for i in range(30) for j in sorted((j for j in range(80) if j != i), key=lambda j: (-score[i, j].round(12), j))[:3]]
    assert [(r.query_id, r.id, round(r.score, 9)) for r in got.itertuples()] == want
    assert seen and max(seen) <= 400
