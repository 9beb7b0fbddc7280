"""Roll-ups, logs, indexes, sketches, intervals, routing, terms, keyed state, CSV ranges and hash trees against plain versions."""

import csv
import io
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import catalogue, mapping, parsing, partitions, range_hash, sketches, terms, validity, vectors
from vigil.plans import binding, queries_semantic, routing
from vigil.plans.model import SemanticQuery, formula_names
from vigil.sources import csv_files, folders, indexed, logs
from vigil.sources.events import shared_folder, stream_files, write_events
from vigil.streaming import pairs, rollups, streams


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rollup_runs_merge_and_count_once(spark):
    rollup = rollups.Rollup(("key",), {"total": "v"})
    path, incoming = shared_folder(spark, "runs"), shared_folder(spark, "in")
    draw, want = random.Random(1), {}
    for i in range(18):
        rows = [(draw.choice("abcd"), draw.randrange(10), draw.choice((1, 1, -1))) for _ in range(20)]
        for k, v, s in rows:
            n, t = want.get(k, (0, 0))
            want[k] = (n + s, t + s * v)
        spark.createDataFrame(rows, "key string, v long, sign int").coalesce(1).write.mode("append").parquet(incoming)
    stream = stream_files(spark, incoming, "key string, v long, sign int", maxFilesPerTrigger="1")
    rollups.stream_rollup(stream, rollup, path, f"{path}-state", "sign").awaitTermination()
    read = lambda: {r.key: (r.event_count, r.total) for r in rollups.read_rollup(spark, path, rollup).collect()}
    want = {k: x for k, x in want.items() if x != (0, 0)}
    assert read() == want
    found = rollups.runs(spark, path)
    assert (0, 15) in found and len(rollups.current(found)) <= 4 and len(found) <= 8
    # a trigger that is repeated after its run was merged doesn't count again
    again = rollups.partial(spark.createDataFrame([("a", 5, 1)], "key string, v long, sign int"), rollup, F.col("sign"))
    again.write.parquet(f"{path}/{3:012d}-{3:012d}")
    assert read() == want


def test_log_slices_and_growth(spark):
    folder = shared_folder(spark, "log")
    for i in range(3):
        assert logs.append(spark.range(100 * i, 100 * i + 100).selectExpr("id % 5 AS key", "id AS value"), folder, 2, 16) == 100
    ends = {p: s[-1][0] + s[-1][1] for p, s in logs.segments(folder).items()}
    assert sum(ends.values()) == 300
    reader = logs.LogReader({"path": folder, "consumer": "c", "max_per_trigger": "37"})
    start, got = reader.initialOffset(), []
    for turn in range(20):
        if turn == 2:  # a new process knows only what was handed out
            reader = logs.LogReader({"path": folder, "consumer": "c", "max_per_trigger": "37"})
        end = reader.latestOffset()
        assert all(end[p] - start.get(p, 0) <= 37 for p in end)
        for part in reader.partitions(start, end):
            got += [r for b in reader.read(part) for r in zip(b.column("partition").to_pylist(), b.column("offset").to_pylist(), b.column("value").to_pylist(), strict=True)]
        start = end
    assert sorted(v for _, _, v in got) == sorted(str(i) for i in range(300))
    assert sorted((p, o) for p, o, _ in got) == [(p, o) for p, n in sorted(ends.items()) for o in range(n)]
    with pytest.raises(ValueError):
        logs.LogSource({"path": folder, "max_per_trigger": "3"}).streamReader(None)


def test_lookups_open_few_files(spark):
    observed = queries_semantic.observables(spark, "/root/testdata/sf0.01")
    path = shared_folder(spark, "indexed")
    indexed.write_indexed(observed, path, 400)
    total, whole = indexed.bytes_of(spark, path), observed.count()
    assert spark.read.parquet(f"{path}/data").count() == whole
    asked = {"uids": {"uids": ["ev-77", "ev-500"]}, "values": {"values": ["192.0.2.17"]}, "times": {"start": datetime(2024, 1, 10), "stop": datetime(2024, 1, 10, 12)}, "none": {"values": ["nothing"]}}
    where = {"uids": "event_uid IN ('ev-77', 'ev-500')", "values": "value = '192.0.2.17'", "times": "event_time >= '2024-01-10' AND event_time < '2024-01-10 12:00:00'", "none": "false"}
    for name, most in (("uids", 0.3), ("values", 0.6), ("times", 0.6), ("none", 0.3)):
        ask = lambda n=name: indexed.look_up(spark, path, **asked[n])
        assert sorted(r.observable_id for r in ask().collect()) == sorted(r.observable_id for r in observed.where(where[name]).collect())
        assert indexed.bytes_read(spark, ask) < most * total


def test_morton_codes_take_bits_in_turn(spark):
    rows = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int").withColumn("z", indexed.morton(F.col("a"), F.col("b"), 3)).collect()
    for r in rows:
        assert r.z == int("".join(x + y for x, y in zip(f"{r.a:03b}", f"{r.b:03b}", strict=True)), 2)


def test_sketches_are_near_and_read_new_days_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("part", F.col("doc_id") % 5)
    path = shared_folder(spark, "sketches")
    assert sketches.add_partitions(docs.where("part < 4"), ["text", "n_chars", "lang"], "part", path) == ["0", "1", "2", "3"]
    before = folders.sizes(spark, path)
    assert sketches.add_partitions(docs, ["text", "n_chars", "lang"], "part", path) == ["4"]
    assert before.items() <= folders.sizes(spark, path).items()
    for where, rows in ((None, docs), (F.col("partition").isin("1", "4"), docs.where("part IN (1, 4)"))):
        found = {r.column_name: r for r in sketches.merge(sketches.read_sketches(spark, path), where).collect()}
        exact = rows.agg(F.count_distinct("text").alias("d"), F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high")).first()
        assert abs(found["text"].distinct_count - exact.d) <= 0.05 * exact.d
        assert (found["n_chars"].total_count, found["n_chars"].min_number, found["n_chars"].max_number) == (exact.n, exact.low, exact.high)
        values = sorted(r.n_chars for r in rows.collect())
        for q, v in zip((0.25, 0.5, 0.75), found["n_chars"].quartiles, strict=True):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.03
        langs = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
        assert {e.item: e["count"] for e in found["lang"].frequent} == langs


def test_registry_reads_no_data(spark, sf):
    path = shared_folder(spark, "events")
    write_events(binding.dns(spark, sf), path)
    ask = lambda: partitions.registry(spark, path, "dns", ordered="k")
    rows = ask().collect()
    days = {r.d: r.n for r in binding.dns(spark, sf).groupBy(F.to_date("time").cast("string").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert {r.partition_key: r.row_count for r in rows} == days
    assert sum(r.size_bytes for r in rows) == partitions.listed_bytes(spark, path) and all(r.last_modified for r in rows)
    assert partitions.newest(spark, path, "k") == binding.dns(spark, sf).agg(F.max("k")).first()[0]
    with partitions.from_footers(spark):
        counted = spark.read.parquet(path).groupBy("event_date").agg(F.count("*"), F.max("k"))
        assert "BatchScan" in plan(counted) and "max(k)" in plan(counted).split("BatchScan")[1]


def test_blocks_cover_intervals(spark):
    draw = random.Random(4)
    spans = [(a, a + draw.randrange(0, 60)) for a in (draw.randrange(0, 200) for _ in range(80))] + [(0, validity.LAST), (5, 4), (validity.LAST, validity.LAST)]
    rows = spark.createDataFrame(spans, "a long, b long").withColumn("blocks", validity.dyadic_blocks(F.col("a"), F.col("b"))).collect()
    for r in rows:
        covered = [x for p in r.blocks if p["size"] < 12 for x in range(p.block << p["size"], (p.block + 1) << p["size"])]
        if r.b - r.a < 1000:
            assert sorted(covered) == list(range(r.a, r.b + 1))
        assert len(r.blocks) <= 2 * 33


def test_interval_plan_has_no_nested_loop(spark, sf):
    from vigil.plans import queries_threat

    found = validity.valid_lookup(binding.dns(spark, sf), queries_threat._valid_feed(spark, sf), "domain", ["query_hostname"])
    assert "NestedLoop" not in plan(found) and "CartesianProduct" not in plan(found)


def test_routing_takes_the_cheapest_rollup(spark, sf):
    model, stored = queries_semantic.MODEL, queries_semantic.stored_rollups(spark, sf)
    chosen = lambda q: (s := routing.choose(q, model, stored)) and s.spec.name
    ask = lambda **k: SemanticQuery("dns_event", **k)
    assert chosen(ask(metrics=("dns_query_count",))) == "by_region"
    assert chosen(ask(metrics=("dns_query_count",), group_by=("action",))) == "by_type_day"
    assert chosen(ask(metrics=("max_duration",), group_by=("action",))) == "by_client_hour"
    assert chosen(ask(metrics=("dns_query_count",), group_by=("action",), time_granularity="hour")) == "by_client_hour"
    assert chosen(ask(metrics=("dns_query_count",), group_by=("action",), time_granularity="minute")) is None
    assert chosen(ask(metrics=("dns_query_count",), group_by=("severity_id",))) is None
    assert chosen(ask(metrics=("dns_query_count",), time_range=("2024-01-02T00:30:00", None))) is None
    assert chosen(ask(metrics=("dns_query_count",), time_range=("-3d", None))) is None
    assert chosen(ask(metrics=("last_duration",))) is None
    query = ask(metrics=("nx_rate",), group_by=("action",), time_granularity="month")
    routed = routing.run_routed(query, model, queries_semantic._bind(spark, sf), stored)
    assert "by_type_day" in "".join(routed.inputFiles()) and "events.parquet" not in "".join(routed.inputFiles())
    with pytest.raises(ValueError):
        routing.build_rollup(routing.RollupSpec("x", "dns_event", ("action",), ("distinct_hosts",)), model, queries_semantic._bind(spark, sf))


def plain_score(a, b):
    common = next((i for i in range(min(len(a), len(b)), 0, -1) if a[:i] == b[:i]), 0)
    words = len(set(a.split()) & set(b.split()))
    return 100 if a in b or b in a else common * 10 if common >= 3 else words * 20 if words else None


def test_near_names_against_all_pairs(spark):
    draw = random.Random(7)
    made = lambda n: sorted({" ".join("".join(draw.choice("abc") for _ in range(draw.randrange(1, 6))) for _ in range(draw.randrange(1, 4))) for _ in range(n)})
    asked, names = made(60), made(60)
    df = terms.near_names(spark.createDataFrame([(x,) for x in [*asked, "", None]], "term string"), spark.createDataFrame([(x,) for x in [*names, ""]], "name string"))
    want = {(a, b, s) for a in asked for b in names if (s := plain_score(a, b)) is not None}
    assert {tuple(r) for r in df.collect()} == want
    assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)


def test_pair_state_equals_batch_and_stays_small(spark):
    streams.use_keyed_state(spark)
    draw, rows = random.Random(2), []
    for hour in range(24):
        for _ in range(12):
            rows.append((draw.choice(("1.1.1.1", "2.2.2.2", None)), "a.example", hour * 3600 + draw.randrange(3600), hour))
        if hour > 1:  # late by an hour
            rows.append(("1.1.1.1", "a.example", (hour - 1) * 3600 + draw.randrange(3600), hour))
    incoming, path = shared_folder(spark, "in"), shared_folder(spark, "pairs")
    schema = "source_ip string, query_hostname string, time timestamp"
    every = spark.createDataFrame(rows, "source_ip string, query_hostname string, s long, f int")
    for k in range(12):
        every.where(f"f DIV 2 = {k}").select("source_ip", "query_hostname", F.timestamp_seconds("s").alias("time")).coalesce(1).write.mode("append").parquet(incoming)
    stream = stream_files(spark, incoming, schema, maxFilesPerTrigger="1")
    streams.run_once(pairs.stream_pair_gaps(stream, "3 hours"), path, "update").count()
    got = {r.source_ip: (r.beacon_count, round(r.avg_interval, 6), round(r.interval_stddev, 6)) for r in pairs.beacons_of_state(spark, f"{path}/state", 5, 100.0).collect()}
    for ip in ("1.1.1.1", "2.2.2.2", None):
        at = sorted(s for i, _, s, _ in rows if i == ip)
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        mean = sum(gaps) / len(gaps)
        assert got[ip] == (len(gaps), round(mean, 6), round((sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) ** 0.5, 6))
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{path}/state")
    assert 0 < state.count() <= 3 * 6  # the hours that the delay leaves open, of 24


def test_beacon_tables_stay_small(spark):
    draw = random.Random(6)
    rows = [(draw.choice(("1.1.1.1", "2.2.2.2")), "a.example", draw.randrange(30 * 3600), i % 11) for i in range(400)]
    incoming, path = shared_folder(spark, "in"), shared_folder(spark, "beacons")
    every = spark.createDataFrame(rows, "source_ip string, query_hostname string, s long, f int")
    for k in range(11):
        every.where(f"f = {k}").select("source_ip", "query_hostname", F.timestamp_seconds("s").alias("time")).coalesce(1).write.mode("append").parquet(incoming)
    stream = stream_files(spark, incoming, "source_ip string, query_hostname string, time timestamp", maxFilesPerTrigger="1")
    streams.stream_beaconing(stream, path, f"{path}-state", compact=3).awaitTermination()
    assert folders.children(spark, f"{path}/whole") == ["upto=5", "upto=8"] and len(folders.children(spark, f"{path}/chunks")) <= 6
    got = {r.source_ip: (r.beacon_count, round(r.avg_interval, 6), round(r.interval_stddev, 6)) for r in streams.beacons(spark, path, 5, 100.0).collect()}
    for ip in ("1.1.1.1", "2.2.2.2"):
        at = sorted(s for i, _, s, _ in rows if i == ip)
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        mean = sum(gaps) / len(gaps)
        assert got[ip] == (len(gaps), round(mean, 6), round((sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) ** 0.5, 6))


def test_hunts_scan_once(spark, sf):
    from vigil.operators import hunting

    events, now = binding.dns(spark, sf), datetime(2024, 1, 30)
    for found in (hunting.fast_flux_detection(events, now, 720, 1), hunting.blocked_dns_by_host(events, now, 720, 1)):
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_latest_time_comes_from_the_last_day(spark, sf):
    from vigil.plans.semantic import newest

    path = shared_folder(spark, "by_day")
    write_events(binding.dns(spark, sf), path)
    events = spark.read.parquet(path)
    assert newest(events, F.col("time"), True) == newest(events, F.col("time"), False)
    assert newest(events.limit(0), F.col("time"), True) is None


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_csv_ranges_cut_between_records(size, tmp_path):
    draw = random.Random(size)
    cells = lambda: ["".join(draw.choice('ab",\n\n é') for _ in range(draw.randrange(6))) for _ in range(3)]
    rows = [cells() for _ in range(40)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    raw = out.getvalue().encode()
    path = tmp_path / "x.csv"
    path.write_bytes(raw)
    got = []
    for start in range(0, len(raw), size):
        inside = raw[:start].count(b'"') % 2 == 1
        got += list(csv_files.records(str(path), start, min(start + size, len(raw)), len(raw), inside))
    assert [next(csv.reader(io.StringIO(x.decode(), newline=""))) for _, x in got] == rows
    assert [p for p, _ in got] == sorted({p for p, _ in got})


def test_hash_trees_lead_to_the_rows_that_differ(spark):
    old = spark.range(20_000).selectExpr("CAST(id AS STRING) AS key", "id % 7 AS v")
    changed = {"17": "modified", "400": "removed", "x": "added"}
    new = old.where("key <> '400'").withColumn("v", F.when(F.col("key") == "17", 99).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("x", 1)], "key string, v long"))
    path = shared_folder(spark, "trees")
    for name, df in (("old", old), ("new", new), ("same", old)):
        range_hash.write_snapshot(df, f"{path}/{name}", "key", ["v"])
    assert {r.key: r.change for r in range_hash.snapshot_changes(spark, f"{path}/old", f"{path}/new", "key").collect()} == changed
    leaves = range_hash.differing_leaves(spark, f"{path}/old", f"{path}/new")
    assert 1 <= len(leaves) <= 3 and spark.read.parquet(f"{path}/new/rows").where(F.col("leaf").isin(leaves)).count() < 0.05 * 20_000
    assert range_hash.differing_leaves(spark, f"{path}/old", f"{path}/same") == []
    assert range_hash.snapshot_changes(spark, f"{path}/old", f"{path}/same", "key").count() == 0


def test_catalogue_recall_and_exactness(spark):
    draw = np.random.default_rng(5)
    middles = draw.normal(0, 1, (40, 16))
    rows = [(i, (middles[i % 40] + draw.normal(0, 0.4, 16)).tolist()) for i in range(3000)] + [(3000, [0.0] * 16), (3001, None)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = corpus.where("id % 50 = 0")
    path = shared_folder(spark, "catalogue")
    catalogue.build_index(corpus, path, 40)
    assert spark.read.parquet(f"{path}/lists").count() == 3001
    pairs_of = lambda df: {(r.query_id, r["rank"], r.id) for r in df.collect()}
    want = pairs_of(vectors.cosine_topk(asked, corpus.where("vector IS NOT NULL"), 5, 16))
    assert pairs_of(catalogue.search(asked, path, 5, probes=2, exact=True)) == want
    found = {(q, i) for q, _, i in pairs_of(catalogue.search(asked, path, 5, probes=4))}
    assert len(found & {(q, i) for q, _, i in want}) >= 0.9 * len(want)
    numbers, cells = catalogue.read_cells(spark, path)
    assert sum(sorted(cells.sizes)[-4:]) < 0.3 * 3001 and len(numbers) > 20  # what a search opens at most


def test_first_seen_with_a_time_to_live(spark):
    streams.use_keyed_state(spark)
    incoming = shared_folder(spark, "in")
    spark.sql("SELECT * FROM VALUES (NULL, TIMESTAMP'2024-01-02'), ('a', NULL), ('b', TIMESTAMP'2024-01-03'), ('b', TIMESTAMP'2024-01-01') AS t(k, time)").coalesce(1).write.parquet(incoming)
    got = []
    stream = streams.stream_first_seen(stream_files(spark, incoming, "k string, time timestamp"), "k", 3600)
    running = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", shared_folder(spark, "state")).start()
    for _ in range(240):
        if got or running.exception():
            break
        running.awaitTermination(0.25)
    running.stop()
    assert {r.key: r.first_seen.day for r in got} == {None: 2, "b": 1}


def test_conform_nested_rows(spark):
    df = spark.createDataFrame([(("u", None), [("1.1.1.1",), (None,)], 5), ((None, 2.5), [], 6), (None, None, 7)], "metadata struct<uid: string, n: double>, answers array<struct<rdata: string>>, plain int")
    good, bad = mapping.conform(df, [("metadata.uid", "string_t", "required", False), ("metadata.n", "long_t", "optional", False), ("answers[].rdata", "ip_t", "optional", False), ("plain", "float_t", "required", False), ("more.parts", "strange_t", "optional", True)])
    rows = good.collect()
    assert [(r.metadata.uid, r.metadata.n, [a.rdata for a in r.answers], r.plain, r.more) for r in rows] == [("u", None, ["1.1.1.1", None], 5.0, None)]
    assert sorted(r.missing for r in bad.collect()) == [["metadata.uid"], ["metadata.uid"]]
    assert good.schema["more"].dataType.simpleString() == "struct<parts:array<string>>"
    assert [r.missing for r in mapping.conform(df, [("answers[].rdata", "ip_t", "required", False)])[1].orderBy("missing").collect()] == [["answers[].rdata"]] * 2
    with pytest.raises(ValueError):
        mapping.conform(df, [("a", "string_t", "optional", False), ("a.b", "string_t", "optional", False)])


def test_small_mends(spark):
    assert formula_names("a * 1e3 + b_2") == ["a", "b_2"]
    with pytest.raises(ValueError):
        formula_names("a +")
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": {"g": [1, 2.0, 2.5, "]{"]}}}}}}}}'
    df = spark.createDataFrame([(1, deep), (2, "{}"), (3, "no json")], "id int, raw string")
    assert {(r.path, r.type) for r in parsing.flatten_json(df, "id", "raw", split_numbers=True).collect() if r.type != "array"} == {(f"a.b.c.d.e.f.g[{i}]", t) for i, t in enumerate(("integer", "integer", "float", "string"))}
    rows = {(r.row, r.path): (r.value, r.type) for r in parsing.parse_csv(spark.createDataFrame([(1, 'a,,c\n1,"x, ""y""",true\n2')], "id int, raw string"), "id", "raw").collect()}
    assert rows == {(0, "a"): ("1", "number"), (0, "column_1"): ('x, "y"', "string"), (0, "c"): ("true", "boolean"), (1, "a"): ("2", "number"), (1, "column_1"): ("", "null"), (1, "c"): ("", "null")}
    from vigil.operators import changes, observables

    old, new = spark.createDataFrame([("a", ["x"]), ("b", None)], "name string, dims array<string>"), spark.createDataFrame([("a", None), ("b", ["x"])], "name string, dims array<string>")
    assert {r.name: r.is_breaking for r in changes.breaking_changes(old, new, ["name"], ["dims"], []).collect()} == {"a": True, "b": False}
    text = spark.createDataFrame([(1, "see bad.Example.COM, 2001:db8::1 and fe80:1:2, not aa:bb:cc:dd:ee:ff")], "id int, text string")
    assert {(r.observable_type, r.value) for r in observables.scan_text_observables(text, "id", "text").collect()} == {("hostname", "bad.Example.COM"), ("ip", "2001:db8::1"), ("ip", "fe80:1:2"), ("mac", "aa:bb:cc:dd:ee:ff")}


def test_a_new_consumer_reads_a_long_log_to_its_end(spark, monkeypatch):
    from vigil.plans import queries_streams

    folder, path = shared_folder(spark, "log"), shared_folder(spark, "scanned")
    logs.append(spark.range(100).selectExpr("id % 5 AS key", "id AS value"), folder, 2, 16)
    monkeypatch.setattr(queries_streams, "LOG_RECORDS", 7)
    queries_streams._read_log(spark, folder, path)
    assert sorted(int(r.value) for r in spark.read.parquet(f"{path}/out").collect()) == list(range(100))


def test_csv_ranges_are_read_in_many_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(b"\n\na,b\n" + b"".join(b'%d,"x\ny"\n' % i for i in range(4000)))
    monkeypatch.setattr(csv_files, "TASK", 4_000)
    rows = csv_files.read_csv_records(spark, str(tmp_path), 1_000)
    used = rows.select("place", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) > 5 and max(r["count"] for r in used) < 2_500
    fields = csv_files.read_csv_fields(spark, str(tmp_path), 1_000)
    assert sorted((r.path, r["count"]) for r in fields.groupBy("path").count().collect()) == [("a", 4000), ("b", 4000)]
    assert fields._jdf.queryExecution().executedPlan().toString().count("SortAggregate") == 0


def test_arriving_files_grow_with_rows(spark, sf, monkeypatch):
    from vigil.plans import queries_streams

    monkeypatch.setattr(queries_streams, "FILE_ROWS", 30)
    stream = queries_streams.dns_stream(spark, sf, 1)
    folder = shared_folder(spark, "counted")
    found = streams.run_once(stream.select("metadata_uid"), folder)
    per = found.groupBy("trigger").count().collect()
    assert found.distinct().count() == 1000 and len(per) == 4
    assert queries_streams._files(binding.dns(spark, sf), 4) == 36


def test_uid_table_is_made_distinct_after_it_is_dealt(spark, sf, monkeypatch):
    seen, kind = [], type(spark.range(1))
    sort = kind.sortWithinPartitions

    def noted(df, *columns):
        if columns == ("uid_hash",):
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return sort(df, *columns)

    monkeypatch.setattr(kind, "sortWithinPartitions", noted)
    indexed.write_indexed(queries_semantic.observables(spark, sf), shared_folder(spark, "indexed"), 300)
    assert len(seen) == 1 and seen[0].index("Aggregate") < seen[0].index("RepartitionByExpression")


def test_rollup_stream_brings_all_rows_and_keeps_what_it_takes(spark, sf, monkeypatch):
    from vigil.plans import queries_streams

    kept, folder = [], []
    dedupe, files = streams.stream_dedupe, stream_files
    monkeypatch.setattr(streams, "stream_dedupe", lambda rows, *a: kept.append(rows.columns) or dedupe(rows, *a))
    monkeypatch.setattr(queries_streams, "stream_files", lambda session, path, *a, **k: folder.append(path) or files(session, path, *a, **k))
    monkeypatch.setattr(queries_streams, "FILE_ROWS", 200)
    found = {(r.source_ip, r.query_type, r.action): r.event_count for r in queries_streams.stream_hot_rollup(spark, sf).collect()}
    events = binding.dns(spark, sf)
    assert found == {(r.source_ip, r.query_type, r.action): r["count"] for r in events.where("k % 7 <> 3").groupBy("source_ip", "query_type", "action").count().collect()}
    # only the columns that the roll-up takes go through the state
    assert [sorted(c) for c in kept] == [sorted(["uid", "time", "sign", *queries_streams.ROLLUP.keys, "k", "severity_id"])] * 2
    # each event came whole and twice, the retracted ones once more; files are small and copies lie in different ones
    arrived = spark.read.parquet(folder[0]).withColumn("file", F.input_file_name())
    assert set(events.columns) <= set(arrived.columns)
    assert arrived.count() == 2 * events.count() + events.where("k % 7 = 3").count()
    assert max(r["count"] for r in arrived.groupBy("file").count().collect()) <= 2 * 200
    assert arrived.groupBy("uid").agg(F.count_distinct("file").alias("n")).where("n > 1").count() > 0


def test_arriving_files_are_even_and_small(spark, sf, monkeypatch):
    from vigil.plans import queries_streams

    monkeypatch.setattr(queries_streams, "FILE_ROWS", 100)
    folder = []
    files = stream_files
    monkeypatch.setattr(queries_streams, "stream_files", lambda session, path, *a, **k: folder.append(path) or files(session, path, *a, **k))
    queries_streams.dns_stream(spark, sf, 1)
    arrived = spark.read.parquet(folder[0])
    of_file = [r["count"] for r in arrived.groupBy(F.input_file_name()).count().collect()]
    assert sum(of_file) == binding.dns(spark, sf).count() and len(of_file) == 12 and max(of_file) <= 2 * 100
