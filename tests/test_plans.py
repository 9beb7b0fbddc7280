"""What plans read, and cases by hand that one query over the tables doesn't show."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigil.operators import hunting, observables, parsing, vectors
from vigil.plans import binding
from vigil.plans.model import Attribute, Entity, Filter, Metric, Model, Relationship, SemanticQuery
from vigil.plans.semantic import formula_column, run
from vigil.sources.events import shared_folder, stream_files, write_events
from vigil.streaming import streams

EVENTS = Entity("e", tuple(Attribute(n) for n in ("metadata_uid", "severity_id", "query_type", "time", "source_ip")))
MODEL = Model.of([EVENTS], [Metric("n", "e")])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def by_day(spark, sf):
    path = shared_folder(spark, "by-day")
    write_events(binding.dns(spark, sf), path)
    return spark.read.parquet(path)


def test_time_ranges_reach_the_folders(by_day):
    asked = SemanticQuery("e", select=("metadata_uid",), time_range=("2024-01-05", "2024-01-07T12:00:00"))
    found = run(asked, MODEL, lambda name: by_day)
    text = plan(found)
    assert "event_date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() == by_day.where("time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 12:00:00'").count() > 0
    recent = hunting.recent(by_day, datetime(2024, 1, 20), 30)
    assert "event_date" in plan(recent).split("PartitionFilters: [")[1].split("]")[0]
    assert recent.count() == by_day.where("time >= TIMESTAMP '2024-01-18 18:00:00'").count()


@pytest.mark.parametrize("values, pushed", [([1, "3"], True), (["01", 3], False), (["x"], False)])
def test_lists_reach_the_scan(by_day, values, pushed):
    found = run(SemanticQuery("e", select=("metadata_uid",), filters=(Filter("severity_id", "in", values),)), MODEL, lambda name: by_day)
    assert ("In(severity_id" in plan(found) or "EqualTo(severity_id" in plan(found)) == pushed
    assert found.count() == by_day.where(F.col("severity_id").cast("string").isin([str(v) for v in values])).count()


@pytest.mark.parametrize("formula, want", [("a / b + c", 1.75), ("c + a / b", 1.75), ("a / b / c", 0.75), ("a + b / c - -a", 10.0), ("(a + b) * c", 7.0), ("a / zero + c", None), ("a - b / (zero / b)", None), ("2 * a", 6.0)])
def test_formulas(spark, formula, want):
    row = spark.createDataFrame([(3, 4, 1, 0)], "a long, b long, c long, zero long")
    assert row.select(formula_column(formula).cast("double").alias("x")).first().x == want


def test_formulas_are_arithmetic_only():
    for text in ("a +", "f(a)", "a if b else c", "a ** 2"):
        with pytest.raises(ValueError):
            formula_column(text)


def test_last_values_and_fan_out(spark):
    rows = [("a", "x", 1, 10.0), ("a", "x", 2, 20.0), ("a", "y", 1, 5.0), ("b", "x", 3, None), ("b", "x", 1, 7.0), (None, "z", 1, None)]
    table = spark.createDataFrame(rows, "site string, account string, time int, balance double")
    entity = Entity("t", tuple(Attribute(n) for n in ("site", "account", "time", "balance")), relationships=(Relationship("many", "o", "t.site = o.s", many_to_many=True),))
    other = Entity("o", (Attribute("s"),))
    model = Model.of([entity, other], [Metric("balance_sum", "t", "sum", "balance", not_summed_over=("time",), series=("account",)), Metric("n", "t")])
    bind = {"t": table, "o": spark.createDataFrame([("a",), ("a",)], "s string")}.__getitem__
    got = run(SemanticQuery("t", metrics=("balance_sum", "n"), group_by=("site",), relationships=()), model, bind).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 25.0, 3), ("b", 7.0, 2), (None, None, 1)], key=str)
    assert run(SemanticQuery("t", metrics=("balance_sum",), relationships=()), model, bind).first()[0] == 25.0
    with pytest.warns(UserWarning, match="many to many"):
        assert run(SemanticQuery("t", metrics=("n",), group_by=("site",)), model, bind).where("site = 'a'").first().n == 6
    with pytest.raises(ValueError):
        run(SemanticQuery("t", metrics=("bad",)), Model.of([entity, other], [Metric("bad", "t", "avg", "balance", not_summed_over=("time",))]), bind)


def test_paths_through_arrays(spark):
    schema = "metadata_uid string, class_uid int, time timestamp, a array<struct<b: array<string>, c: struct<d: int>>>"
    events = spark.createDataFrame([("u", 1, None, [(["p", None, "q"], (5,)), (None, None)]), ("v", 1, None, None), ("w", 1, None, [])], schema)
    found = observables.extract_observables(events, {7: ("T", ("a.b", "a.c.d", "a.x", "nothing"))})
    assert sorted((r.observable_id, r.value) for r in found.collect()) == [("u_a[0].b[0]", "p"), ("u_a[0].b[2]", "q"), ("u_a[0].c.d", "5")]
    assert observables.extract_observables(events).count() == 0


def test_dictionary_kinds(spark):
    fields = spark.createDataFrame([("r", 1, "file.hash.value", "h", "hash_t"), ("r", 1, "user[0].name", "n", "string_t"), ("s", 2, "x", "y", "int_t"), ("s", 2, "z", None, "int_t")], "record string, class_uid int, path string, value string, attr_type string")
    entries = [("object", "hash", None, 8), ("type", "string_t", None, 4), ("class", "2", None, 9), ("attribute", "value", 2, 1), ("object", "user", 2, 5)]
    found = observables.extract_from_dictionary(fields, spark.createDataFrame(entries, "kind string, key string, class_uid int, type_id int"))
    assert sorted((r.path, r.type_id) for r in found.collect()) == [("file.hash.value", 8), ("user[0].name", 4), ("x", 9)]


def test_flatten_reads_once_and_keeps_every_leaf(spark, by_day):
    rows = [(1, '{"a": {"b": [1, {"c": null}, []]}, "d": {}}'), (2, "[true, \"x\"]"), (3, "7"), (4, "no"), (5, '{"a": {"b": {"c": {"d": {"e": 1}}}}}'), (6, None)]
    found = parsing.flatten_json(spark.createDataFrame(rows, "key int, value string"), "key", "value", 3)
    got = sorted((r.key, r.path, r.value, r.type) for r in found.collect())
    assert got == sorted([(1, "a.b", '[1,{"c":null},[]]', "array"), (1, "a.b[0]", "1", "number"), (1, "a.b[1]", '{"c":null}', "object"), (1, "a.b[2]", "[]", "array"), (2, "root", '[true,"x"]', "array"), (2, "[0]", "true", "boolean"), (2, "[1]", "x", "string"), (3, "root", "7", "number"), (5, "a.b.c", '{"d":{"e":1}}', "object")])
    assert plan(parsing.flatten_json(by_day.select("metadata_uid", F.to_json(F.struct("time", "source_ip")).alias("raw")), "metadata_uid", "raw", 4)).count("FileScan") == 1


def test_boosts_fold_in_stretches(spark, monkeypatch):
    confirmed = spark.createDataFrame([(i, i % 3, i % 5) for i in range(60)], "step long, field long, target long")
    near = spark.createDataFrame([(f, (f + 1) % 5, 0.5 + 0.1 * f) for f in range(3)] + [(0, 4, 0.4)], "field long, id long, score double")
    want: dict[int, float] = {}
    steps = sorted([(s, 0.5, 0.2, t) for s, _, t in confirmed.collect()] + [(s, 0.3, 0.1 * score, i) for s, f, t in confirmed.collect() for g, i, score in near.collect() if g == f and score >= 0.5 and i != t])
    for _, cap, add, target in steps:
        want[target] = min(want.get(target, 0.0) + add, cap)
    for stretch in (1000, 7, 2):
        monkeypatch.setattr(vectors, "STRETCH", stretch)
        got = {r.target: r.boost for r in vectors.learn_boosts(confirmed, near).collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_texts_hold_hosts_and_long_addresses(spark):
    text = "see www.example.com, 2001:0db8:0000:0000:0000:ff00:0042:8329 and 10.0.0.1; mail a@b.example.org"
    found = observables.scan_text_observables(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert {(r.observable_type, r.value) for r in found.collect()} == {("hostname", "www.example.com"), ("ip", "2001:0db8:0000:0000:0000:ff00:0042:8329"), ("ip", "10.0.0.1"), ("email", "a@b.example.org")}


def test_beacons_count_late_rows_and_repeated_triggers(spark):
    schema = "source_ip string, query_hostname string, time timestamp"
    base = datetime(2024, 1, 1, 23, 30).timestamp()
    times = [base + 60 * i for i in range(90)]
    path = shared_folder(spark, "late")
    for n, part in enumerate((times[40:70], times[:40:2], times[1:40:2], times[70:])):
        spark.createDataFrame([("ip", "host", datetime.fromtimestamp(t)) for t in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        streams.stream_beaconing(stream_files(spark, f"{path}/in", schema), f"{path}/table", f"{path}/state").awaitTermination()
    found = streams.beacons(spark, f"{path}/table", 10, 0.2).collect()
    assert [(r.beacon_count, r.avg_interval, r.interval_stddev) for r in found] == [(89, 60.0, 0.0)]


def test_dictionary_types_come_once_without_dealing_the_fields(spark):
    fields = spark.createDataFrame([("r", 1, "a.ip", "v"), ("s", None, "a.ip", "v"), ("s", 1, "a.ip", None), ("t", 1, "b", "v")], "record string, class_uid int, path string, value string")
    entries = [("object", "a", None, 2), ("attribute", "ip", None, 2), ("path", "a.ip", 1, 3)]
    found = observables.extract_from_dictionary(fields, spark.createDataFrame(entries, "kind string, key string, class_uid int, type_id int"))
    assert sorted((r.record, r.class_uid or 0, r.type_id) for r in found.collect()) == [("r", 1, 2), ("r", 1, 3), ("s", 0, 2)]
    dealt = [x for x in plan(found).split("== Initial Plan ==")[0].split("\n") if "Exchange hashpartitioning" in x]
    assert not any("value" in x or "record" in x for x in dealt)
