"""Statistics of columns as sketches, one set a partition, that are merged for any range of partitions.

For each partition and column a row holds counts, bounds, and three sketches of bounded size: of distinct values
(HyperLogLog), of quantiles (KLL, of numbers or text lengths) and of frequent values. All of them merge, so a new day
is read alone, and statistics of any days come from their rows without reading these days again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

from vigil.sources import folders

#: Buckets of the distinct sketch are 2 to this (1.04 over its root is the standard error); accuracy of the quantile
#: sketch; values that the frequency sketch tracks, a power of two.
HLL_BITS, KLL_K, TRACKED = 12, 200, 1024


def _number(c: Column, kind: DataType) -> Column:
    if isinstance(kind, NumericType):
        return c.cast("double")
    return F.length(c).cast("double") if isinstance(kind, StringType) else F.lit(None).cast("double")


def sketch(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(partition, column_name, counts, bounds, distinct, quantiles, frequent): a row for each value of ``by`` and column.

    One pass; sketches are built in the map tasks and merged, so a partition or value of any size is split. Numbers have
    bounds as numbers, other values as texts.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = {c: isinstance(kinds[c], NumericType) for c in columns}
    one = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), _number(F.col(c), kinds[c]).alias("number"), F.lit(numeric[c]).alias("numeric"))
    rows = df.select(F.col(by).cast("string").alias("partition"), F.explode(F.array(*map(one, columns))).alias("c")).select("partition", "c.*")
    plain = F.when(~F.col("numeric"), F.col("value"))
    counted = F.when(F.col("numeric"), F.col("number"))
    return rows.groupBy("partition", "column_name").agg(
        F.count("*").alias("total_count"),
        (F.count("*") - F.count("value")).alias("null_count"),
        F.min(counted).alias("min_number"),
        F.max(counted).alias("max_number"),
        F.min(plain).alias("min_text"),
        F.max(plain).alias("max_text"),
        F.hll_sketch_agg("value", HLL_BITS).alias("distinct"),
        F.kll_sketch_agg_double("number", KLL_K).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("frequent"),
    )


def add_partitions(df: DataFrame, columns: Sequence[str], by: str, path: str) -> list[str]:
    """Sketch the partitions of ``df`` that a table of sketches hasn't got, and only these; returns their names."""
    spark = df.sparkSession
    held = {n.split("=", 1)[1] for n in folders.children(spark, path) if n.startswith("partition=")}
    days = [r[0] for r in df.select(F.col(by).cast("string")).distinct().collect()]  # a name a partition
    new = sorted(d for d in days if d is not None and d not in held)
    if new:
        rows = sketch(df.where(F.col(by).cast("string").isin(new)), columns, by)
        rows.write.mode("append").partitionBy("partition").parquet(path)
    return new


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("inferSchema", "false").parquet(path).withColumn("partition", F.col("partition").cast("string"))


def merge(sketches: DataFrame, where: Column | None = None, top: int = 10) -> DataFrame:
    """(column_name, counts, bounds, distinct_count, quartiles, frequent) of all partitions that ``where`` chooses.

    ``frequent`` are at most ``top`` values with counts, most frequent first; a count is right as long as the column has no
    more values than the sketch tracks three quarters of, else it is near.
    """
    chosen = sketches.where(where) if where is not None else sketches
    quartiles = F.kll_sketch_get_quantile_double("q", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    one = chosen.groupBy("column_name").agg(
        F.sum("total_count").alias("total_count"),
        F.sum("null_count").alias("null_count"),
        *(f(f"{n}_{k}").alias(f"{n}_{k}") for k in ("number", "text") for n, f in (("min", F.min), ("max", F.max))),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"),
        F.kll_merge_agg_double("quantiles").alias("q"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {TRACKED}), {top})").alias("frequent"),
    )
    return one.withColumn("quartiles", F.when(F.kll_sketch_get_n_double("q") > 0, quartiles)).drop("q")
