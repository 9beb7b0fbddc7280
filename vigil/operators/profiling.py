"""Profiles of tables, partitions and mappings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.plans.semantic import timestamp

#: The schema types that each observed type agrees with.
COMPATIBLE = {
    "string": ("string_t", "hostname_t", "ip_t", "email_t", "url_t", "mac_t", "subnet_t", "path_t", "process_name_t", "username_t", "datetime_t"),
    "integer": ("integer_t", "long_t", "timestamp_t"),
    "float": ("float_t", "double_t"),
    "boolean": ("boolean_t",),
}


def column_statistics(df: DataFrame, table_name: str, columns: list[str] | None = None, sample_rate: float = 1.0, approx: bool = False) -> DataFrame:
    """A row for each column: distinct, null and total counts, bounds as texts, rates; one aggregation for all columns.

    Exact distinct counts of many columns expand the rows once a column; texts are hashed to 64 bits before that (two of
    ten million different texts get one hash with a chance of 3 in a million). ``approx`` avoids it on large tables.
    """
    columns = columns or df.columns
    sampled = df.sample(sample_rate, seed=0) if sample_rate < 1 else df
    distinct = F.approx_count_distinct if approx else F.count_distinct
    found = [F.count("*").alias("total")]
    texts = {n for n, t in df.dtypes if t == "string"}
    for i, c in enumerate(columns):
        # a null has a hash, so it is taken out first
        found += [distinct(F.when(F.col(c).isNotNull(), F.xxhash64(c)) if c in texts else F.col(c)).alias(f"d{i}"), F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = sampled.agg(*found)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("distinct_count"), (F.col("total") - F.col(f"n{i}")).alias("null_count"), F.col("total").alias("total_count"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")) for i, c in enumerate(columns)))
    share = lambda part: F.when(F.col("total_count") > 0, F.col(part) / F.col("total_count")).otherwise(0.0)
    out = one.select(F.explode(rows).alias("r")).select(F.lit(table_name).alias("table_name"), "r.*")
    return out.withColumns({"null_rate": share("null_count"), "cardinality": share("distinct_count"), "sample_rate": F.lit(float(sample_rate))})


def stale_statistics(stats: DataFrame, as_of: datetime, max_age: int = 86_400) -> DataFrame:
    """Tables whose newest statistics are older than ``max_age`` seconds."""
    newest = stats.groupBy("table_name").agg(F.max("collected_at").alias("collected_at"))
    return newest.where(F.col("collected_at") < timestamp(as_of - timedelta(seconds=max_age)))


def partition_metadata(df: DataFrame, table_name: str, time: str, granularity: str, bytes_of: Column | None = None) -> DataFrame:
    """Rows, bounds and size of each time partition that has rows; give ``bytes_of`` for the size of a row."""
    start = F.date_trunc(granularity, time).cast("timestamp_ntz")
    size = F.sum(bytes_of) if bytes_of is not None else F.lit(None).cast("long")
    found = df.groupBy(start.alias("start_time")).agg(F.count("*").alias("row_count"), size.cast("long").alias("size_bytes"), F.max(time).alias("last_modified"))
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[granularity]
    return found.select(F.lit(table_name).alias("table_name"), F.date_format("start_time", "yyyy-MM-dd'T'HH").alias("partition_key"), "start_time", F.expr(f"start_time + {step}").alias("end_time"), "row_count", "size_bytes", (F.col("row_count") == 0).alias("is_empty"), "last_modified")


def with_empty_partitions(meta: DataFrame, granularity: str) -> DataFrame:
    """Also the partitions without rows between the first and the last one."""
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[granularity]
    spans = meta.groupBy("table_name").agg(F.explode(F.expr(f"sequence(min(start_time), max(start_time), {step})")).alias("start_time"))
    full = spans.join(meta.drop("end_time", "is_empty", "partition_key"), ["table_name", "start_time"], "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    return full.select("table_name", F.date_format("start_time", "yyyy-MM-dd'T'HH").alias("partition_key"), "start_time", F.expr(f"start_time + {step}").alias("end_time"), "row_count", "size_bytes", (F.col("row_count") == 0).alias("is_empty"), "last_modified")


def partitions_in_range(meta: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window (window_id, s, e): the partitions that overlap [s, e) and their rows together.

    Windows and partitions are both put into days, so that they meet by equality; a pair counts on its first common day.
    """
    day = lambda lo, hi: F.explode(F.sequence(F.to_date(lo), F.to_date(hi)))
    parts = meta.withColumn("day", day("start_time", "end_time")).alias("p")
    asked = windows.withColumn("day", day("s", "e")).alias("w")
    both = asked.join(parts, "day").where("p.start_time < w.e AND p.end_time > w.s AND day = greatest(to_date(p.start_time), to_date(w.s))")
    return both.groupBy("window_id").agg(F.count("*").alias("n_partitions"), F.sum("row_count").alias("estimated_rows"))


def field_profile(fields: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Paths seen in flattened records: type, an example, the number of records and their share."""
    total = records.agg(F.count("*").alias("total"))  # one row
    found = fields.groupBy("path", "type").agg(F.min("value").alias("example"), F.count_distinct(key).alias("n_records"))
    return found.join(F.broadcast(total)).withColumn("presence_rate", F.col("n_records") / F.col("total")).drop("total")


def _met(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """(path, seen, mapped): every path that is seen in the data or the target of a mapping."""
    seen = paths.select("path").distinct().withColumn("seen", F.lit(True))
    targets = mappings.select(F.col("target").alias("path")).distinct().withColumn("mapped", F.lit(True))
    return seen.join(targets, "path", "full").select("path", F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce("mapped", F.lit(False)).alias("mapped"))


def mapping_coverage(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: percent of paths mapped and unmapped and of mappings never observed, with both lists of names in order;
    ``mapping_gaps`` has a row for each name."""
    unmapped, unobserved = F.col("seen") & ~F.col("mapped"), ~F.col("seen")
    names = lambda of: F.sort_array(F.collect_list(F.when(of, F.col("path"))))
    counts = _met(paths, mappings).agg(F.count_if("seen").alias("n_paths"), F.count_if("mapped").alias("n_mappings"), names(unmapped).alias("unmapped_paths"), names(unobserved).alias("unobserved_targets"))
    counts = counts.withColumns({"n_unmapped": F.size("unmapped_paths"), "n_unobserved": F.size("unobserved_targets")})
    percent = lambda part, of: F.coalesce(100 * F.try_divide(part, of), F.lit(0.0))
    return counts.select(percent(F.col("n_paths") - F.col("n_unmapped"), F.col("n_paths")).alias("percent_mapped"), percent(F.col("n_unmapped"), F.col("n_paths")).alias("percent_unmapped"), percent(F.col("n_unobserved"), F.col("n_mappings")).alias("percent_unobserved"), "unmapped_paths", "unobserved_targets")


def mapping_gaps(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """(path, gap): paths without a mapping (unmapped) and mappings' targets that no record has (unobserved)."""
    return _met(paths, mappings).where("NOT (seen AND mapped)").select("path", F.when(F.col("seen"), "unmapped").otherwise("unobserved").alias("gap"))


def mapping_verification(mappings: DataFrame, paths: DataFrame) -> DataFrame:
    seen = paths.select(F.col("path").alias("seen")).distinct()
    return mappings.select("target").distinct().join(seen, F.col("target") == F.col("seen"), "left").select("target", F.when(F.col("seen").isNotNull(), "Verified").otherwise("Unverified").alias("status"))


def type_mismatch(fields: DataFrame, dictionary: DataFrame, class_uid: int) -> DataFrame:
    """Observed types (path, type) that disagree with the class's dictionary; arrays agree with all, nulls and objects say nothing."""
    known = dictionary.where(F.col("class_uid") == class_uid).select("path", "attr_type")
    pairs = [f"{a}:{b}" for a, all_b in COMPATIBLE.items() for b in all_b]
    observed = fields.select("path", "type").distinct().where(~F.col("type").isin("null", "object", "array"))
    return observed.join(known, "path").where(~F.concat_ws(":", "type", "attr_type").isin(pairs)).select("path", F.col("type").alias("observed_type"), F.col("attr_type").alias("schema_type"))


def infer_dimensions(profile: DataFrame) -> DataFrame:
    """Class, priority and use as a dimension of each attribute of (name, attr_type, requirement, group, has_enum, observable_type_id)."""
    name, kind = F.col("name"), F.col("attr_type")
    identifier = name.rlike("(_uid|_id|_name)$") | name.isin("uid", "id", "name")
    stamp, observable, enum = kind.isin("timestamp_t", "datetime_t"), F.col("observable_type_id").isNotNull(), F.col("has_enum")
    required, recommended = F.col("requirement") == "required", F.col("requirement") == "recommended"
    primary, classification = F.coalesce(F.col("group") == "primary", F.lit(False)), F.coalesce(F.col("group") == "classification", F.lit(False))
    plain = kind != "object_t"
    dimension = F.when(enum, "categorical").when(stamp, "temporal").when(observable, "searchable").when(identifier, "identifier").when(kind.isin("integer_t", "long_t", "float_t", "double_t"), "numeric").otherwise("text")
    priority = F.when(required | primary, "high").when(recommended | classification, "medium").otherwise("low")
    reason = F.when(enum, "enum").when(required & plain, "required").when(primary & plain, "primary group").when(classification, "classification group").when(observable, "observable").when(stamp, "timestamp").when(identifier & (required | recommended), "identifier")
    return profile.select("name", dimension.alias("dimension_type"), priority.alias("priority"), reason.isNotNull().alias("is_dimension"), F.coalesce(reason, F.lit("no criterion met")).alias("reason"))


def attribute_tiers(paths: DataFrame, dictionary: DataFrame, mappings: DataFrame) -> DataFrame:
    """core: observed and required, recommended or mapped with high confidence; extended: otherwise observed; potential: only in the dictionary."""
    seen = paths.select("path").distinct().withColumn("seen", F.lit(True))
    known = dictionary.select("path", "requirement").distinct()
    sure = mappings.where(F.col("confidence") == "High").select(F.col("target").alias("path")).distinct().withColumn("sure", F.lit(True))
    tier = F.when(F.col("seen").isNull(), "potential").when(F.col("sure") | F.col("requirement").isin("required", "recommended"), "core").otherwise("extended")
    return seen.join(known, "path", "full").join(sure, "path", "left").select("path", tier.alias("tier"))


def value_pattern_check(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The share of values that match the pattern of each attribute; nulls don't count."""
    one = df.agg(*(F.avg(F.col(c).cast("string").rlike(p).cast("double")).alias(c) for c, p in patterns.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).alias("match_rate")) for c in patterns))).alias("r")).select("r.*")
