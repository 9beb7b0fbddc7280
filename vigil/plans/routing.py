"""Stored roll-ups that answer semantic queries: the cheapest one whose dimensions and metrics cover a query is read.

A roll-up has rows for each combination of its dimensions and bucket of time, with mergeable parts of its metrics. Roll-ups
of an entity form a lattice by their dimensions and granularities; a query can be answered from every one above it. Of
these the one with the fewest rows is taken, without any job; if there is none, the query reads the events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Metric, Model, SemanticQuery, validate
from .semantic import Bind, aggregate, attribute_column, predicate, resolve_time, run, timestamp, with_formulas

#: The granularities whose buckets are made of whole buckets of each one.
INSIDE = {"minute": ("minute", "hour", "day", "week", "month"), "hour": ("hour", "day", "week", "month"), "day": ("day", "week", "month"), "week": ("week",), "month": ("month",)}


@dataclass(frozen=True)
class RollupSpec:
    """What a roll-up keeps: dimensions and metrics of an entity, by bucket of time if it has a granularity."""

    name: str
    entity: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]
    granularity: str | None = None


@dataclass(frozen=True)
class StoredRollup:
    """A roll-up's rows and their number."""

    spec: RollupSpec
    table: DataFrame
    n_rows: int


def parts_of(m: Metric) -> dict[str, Metric]:
    """The mergeable metrics that a metric is kept as: an average is a sum and a count, others are themselves."""
    if m.aggregation == "avg":
        return {f"{m.name}__sum": replace(m, aggregation="sum"), f"{m.name}__n": replace(m, aggregation="count")}
    return {m.name: m}


def build_rollup(spec: RollupSpec, model: Model, bind: Bind) -> DataFrame:
    """The rows of a roll-up from the entity's events."""
    entity = model.entity(spec.entity)
    df = bind(entity.name)
    keys = [attribute_column(entity.attribute(d)).alias(d) for d in spec.dimensions]
    bucket = [F.date_trunc(spec.granularity, F.col(entity.time_column)).cast("timestamp_ntz").alias("time_bucket")] if spec.granularity else []
    metrics = [model.metric(b) for m in spec.metrics for b in model.base_metrics(m)]
    for m in metrics:
        if m.aggregation == "count_distinct" or m.not_summed_over or m.hot:
            raise ValueError(f"{m.name} can't be put together from parts")
    parts = {n: p for m in metrics for n, p in parts_of(m).items()}
    return df.groupBy(*bucket, *keys).agg(*(aggregate(p).alias(n) for n, p in parts.items()))


def covers(spec: RollupSpec, query: SemanticQuery, model: Model) -> bool:
    """Whether a query can be answered from a roll-up: its attributes are dimensions, its metrics are kept or count
    distinct values of a dimension, and its times are bounds of the roll-up's buckets."""
    if query.path != "auto" or not query.metrics or spec.entity != query.entity or (query.relationships is None and model.entity(query.entity).relationships) or query.relationships:
        return False
    if not {*query.group_by, *query.select, *(f.attribute for f in query.filters)} <= set(spec.dimensions):
        return False
    kept = {b for m in spec.metrics for b in model.base_metrics(m)}
    for name in (b for m in query.metrics for b in model.base_metrics(m)):
        m = model.metric(name)
        if name not in kept and not _counts_dimension(m, spec, model):
            return False
    if query.time_granularity and query.time_granularity not in INSIDE.get(spec.granularity or "", ()):
        return False
    if query.time_range is None:
        return True
    if query.as_of is None and any(t and (t == "now" or t.startswith("-")) for t in query.time_range):
        return False  # what time it is, only the events say
    return spec.granularity is not None and all(_on_bound(t, spec.granularity, i) for i, t in enumerate(_bounds(query)))


def _counts_dimension(m: Metric, spec: RollupSpec, model: Model) -> bool:
    entity = model.entity(spec.entity)
    fields = {d: entity.attribute(d).expression or entity.attribute(d).field or d for d in spec.dimensions}
    return m.aggregation == "count_distinct" and m.filter is None and m.measure in fields.values()


def _bounds(query: SemanticQuery) -> list[datetime | None]:
    return [resolve_time(t, query.as_of) for t in query.time_range]


def _on_bound(at: datetime | None, granularity: str, is_stop: int) -> bool:
    """A start may lie on a bucket's first moment only. A stop counts itself, so it would have to lie on the last one, a
    microsecond before a bucket."""
    if at is None:
        return True
    micros = (at - datetime(1970, 1, 1)).total_seconds()
    whole = round(micros * 1_000_000) + (1 if is_stop else 0)
    if granularity in ("week", "month"):
        return False
    return whole % ({"minute": 60, "hour": 3600, "day": 86_400}[granularity] * 1_000_000) == 0


def choose(query: SemanticQuery, model: Model, stored: Sequence[StoredRollup]) -> StoredRollup | None:
    """The roll-up with the fewest rows that covers a query."""
    return min((s for s in stored if covers(s.spec, query, model)), key=lambda s: (s.n_rows, s.spec.name), default=None)


def _merged(m: Metric, spec: RollupSpec, model: Model) -> Column:
    kept = {b for name in spec.metrics for b in model.base_metrics(name)}
    if m.name not in kept:
        entity = model.entity(spec.entity)
        of = next(d for d in spec.dimensions if (entity.attribute(d).expression or entity.attribute(d).field or d) == m.measure)
        return F.count_distinct(of)
    match m.aggregation:
        case "avg":
            return F.try_divide(F.sum(f"{m.name}__sum"), F.sum(f"{m.name}__n"))
        case "min":
            return F.min(m.name)
        case "max":
            return F.max(m.name)
        case "count":
            return F.coalesce(F.sum(m.name), F.lit(0).cast("long"))
    return F.sum(m.name)


def run_routed(query: SemanticQuery, model: Model, bind: Bind, stored: Sequence[StoredRollup], observables: DataFrame | None = None) -> DataFrame:
    """A query's plan over the cheapest roll-up that covers it, else over the events."""
    validate(query, model)
    chosen = choose(query, model, stored)
    if chosen is None:
        return run(query, model, bind, observables)
    df = chosen.table
    for f in query.filters:
        df = df.where(predicate(F.col(f.attribute), f, df.schema[f.attribute].dataType))
    if query.time_range:
        start, stop = _bounds(query)
        df = df.where(F.col("time_bucket") >= timestamp(start)) if start else df
        df = df.where(F.col("time_bucket") <= timestamp(stop)) if stop else df
    bucket = [F.date_trunc(query.time_granularity, "time_bucket").cast("timestamp_ntz").alias("time_bucket")] if query.time_granularity else []
    keys = list(dict.fromkeys((*query.group_by, *query.select)))
    bases = dict.fromkeys(b for m in query.metrics for b in model.base_metrics(m))
    found = df.groupBy(*bucket, *keys).agg(*(_merged(model.metric(b), chosen.spec, model).alias(b) for b in bases))
    found = with_formulas(found, query, model).select(*(["time_bucket"] if bucket else []), *keys, *query.metrics)
    if query.order_by:
        found = found.orderBy(*(F.col(n).desc() if d.lower() == "desc" else F.col(n).asc() for n, d in query.order_by))
    found = found.offset(query.offset) if query.offset else found
    return found.limit(query.limit) if query.limit is not None else found
