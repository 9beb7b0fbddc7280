"""Semantic queries as DataFrame plans."""

from __future__ import annotations

import ast
import operator
import re
import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from .model import Attribute, Entity, Filter, Metric, Model, Relationship, SemanticQuery, formula_names, validate

Bind = Callable[[str], DataFrame]


def timestamp(at: datetime | str) -> Column:
    """A literal without time zone; texts are ISO."""
    at = datetime.fromisoformat(at) if isinstance(at, str) else at
    return F.expr(f"TIMESTAMP_NTZ '{at.replace(tzinfo=None).isoformat(sep=' ')}'")


def resolve_time(text: str | None, as_of: datetime | None) -> datetime | None:
    """now, -7d, -24h, -30m, -10s or an ISO time; anything else is no bound."""
    if text is None:
        return None
    if text == "now":
        return as_of
    if m := re.fullmatch(r"-(\d+)([dhms])", text):
        unit = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[m[2]]
        return as_of - timedelta(**{unit: int(m[1])}) if as_of else None
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None


def attribute_column(a: Attribute) -> Column:
    return F.expr(a.expression) if a.expression else F.col(a.field or a.name)


def predicate(column: Column, f: Filter, kind: DataType | None = None) -> Column:
    """One of the eleven predicates; list values are compared as texts.

    If the column's type is given and is a text or whole number, the values are cast instead of the column, so that
    the predicate reaches the scan.
    """
    v = f.value
    match f.operator:
        case "=":
            return column == v
        case "!=":
            return column != v
        case ">":
            return column > v
        case ">=":
            return column >= v
        case "<":
            return column < v
        case "<=":
            return column <= v
        case "in":
            return _among(column, v, kind)
        case "not in":
            return ~_among(column, v, kind)
        case "like":
            return column.like(v)
        case "is null":
            return column.isNull()
        case "is not null":
            return column.isNotNull()
    raise ValueError(f"no operator {f.operator!r}")


def _among(column: Column, values: list, kind: DataType | None) -> Column:
    texts = [str(x) for x in values]
    if isinstance(kind, StringType):
        return column.isin(texts)
    # a whole number's text has no sign of plus and no zeros before it, and it fits the column
    if isinstance(kind, IntegralType) and all(re.fullmatch("0|-?[1-9][0-9]{0,8}", x) for x in texts):
        return column.isin([int(x) for x in texts])
    return column.cast("string").isin(texts)


def aggregate(m: Metric, approx: bool = False) -> Column:
    """The aggregate column of a metric that has no formula."""
    value = F.lit(1) if m.measure == "*" else F.expr(m.measure)
    if m.filter:
        value = F.when(F.expr(m.filter), value)
    match m.aggregation:
        case "count":
            return F.count(value)
        case "count_distinct":
            return F.approx_count_distinct(value) if approx else F.count_distinct(value)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[m.aggregation](value)


def join_relationship(df: DataFrame, r: Relationship, bind: Bind, how: str = "inner") -> DataFrame:
    """Join a related entity under its alias."""
    return df.join(bind(r.target).alias(r.alias or r.target), F.expr(r.condition), how)


def entity_view(entity: Entity, events: DataFrame) -> DataFrame:
    """Base columns and visible attributes of the entity's classes; an attribute of no column is null.

    A dotted field that isn't a column is read from the JSON in ``raw_data``.
    """
    if entity.class_uids:
        events = events.where(F.col("class_uid").isin(list(entity.class_uids)))
    columns = []
    for a in entity.attributes:
        if not a.visible:
            continue
        if a.expression:
            column = F.expr(a.expression)
        elif a.field is None:
            column = F.col(a.name) if a.name in events.columns else F.lit(None).cast("string")
        elif a.field.split(".")[0] in events.columns:
            column = F.col(a.field)
        elif "raw_data" in events.columns:
            column = F.get_json_object("raw_data", f"$.{a.field}")
        else:
            column = F.lit(None).cast("string")
        columns.append(column.alias(a.name))
    named = {a.name for a in entity.attributes}
    return events.select(*(F.col(c) for c in events.columns if c not in named), *columns)


def run(query: SemanticQuery, model: Model, bind: Bind, observables: DataFrame | None = None) -> DataFrame:
    """The query's plan over the bound tables; names are checked before any job."""
    validate(query, model)
    bases = [b for m in query.metrics for b in model.base_metrics(m)]
    hot = query.path == "hot" or (query.path == "auto" and bool(bases) and all(model.metric(b).hot for b in bases))
    if hot:
        if observables is None:
            raise ValueError("the hot path needs the indicator table")
        return _finish(_hot(query, model, observables), query)
    entity = model.entity(query.entity)
    df = bind(entity.name).alias(entity.name)
    time = F.col(f"{entity.name}.{entity.time_column}")
    df = _in_range(df, time, query, entity.time_column == "time")
    for f in query.filters:
        column = _qualified(entity, f.attribute)
        df = df.where(predicate(column, f, df.select(column.alias("c")).schema["c"].dataType))
    for r in entity.relationships:
        if query.relationships is None or r.name in query.relationships:
            if r.many_to_many and query.metrics:
                warnings.warn(f"{r.name} joins many to many: metrics count a row once for each match", stacklevel=2)
            df = join_relationship(df, r, bind, "left")
    bucket = [F.date_trunc(query.time_granularity, time).cast("timestamp_ntz").alias("time_bucket")] if query.time_granularity else []
    if not query.metrics:
        names = list(dict.fromkeys((*query.select, *query.group_by)))
        df = df.select(*bucket, *(_qualified(entity, n).alias(n) for n in names))
        return _finish(df.distinct() if query.group_by else df, query)
    keys = list(dict.fromkeys((*query.group_by, *query.select)))
    groups = [*bucket, *(_qualified(entity, k).alias(k) for k in keys)]
    names = [*(["time_bucket"] if bucket else []), *keys]
    plain = [model.metric(b) for b in dict.fromkeys(bases) if not model.metric(b).not_summed_over]
    parts = [df.groupBy(*groups).agg(*(aggregate(m, query.approx).alias(m.name) for m in plain))] if plain else []
    parts += [_last_values(df, groups, names, entity, model.metric(b)) for b in dict.fromkeys(bases) if model.metric(b).not_summed_over]
    found = parts[0]
    for i, part in enumerate(parts[1:]):
        other = part.withColumnsRenamed({n: f"{n}_{i}" for n in names})
        same = [found[n].eqNullSafe(other[f"{n}_{i}"]) for n in names]
        found = (found.join(other, same) if same else found.crossJoin(other)).drop(*(f"{n}_{i}" for n in names))
    return _finish(with_formulas(found, query, model).select(*names, *query.metrics), query)


def _last_values(df: DataFrame, groups: list[Column], names: list[str], entity: Entity, m: Metric) -> DataFrame:
    """The sum of each series' last value: what may not be summed over time is taken at its latest."""
    value = F.expr(m.measure) if m.filter is None else F.when(F.expr(m.filter), F.expr(m.measure))
    series = [_qualified(entity, s).alias(f"series_{i}") for i, s in enumerate(m.series)]
    order = F.struct(*(_qualified(entity, a) for a in m.not_summed_over))
    last = df.where(value.isNotNull()).groupBy(*groups, *series).agg(F.max_by(value, order).alias(m.name))
    # a group without a value is there as with any other sum
    every = df.groupBy(*groups).agg(F.lit(None).alias("none")).select(*names, F.lit(None).cast(last.schema[m.name].dataType).alias(m.name))
    return last.select(*names, m.name).unionByName(every).groupBy(*names).agg(F.sum(m.name).alias(m.name))


def _qualified(entity: Entity, name: str) -> Column:
    a = entity.attribute(name)
    return F.expr(a.expression) if a.expression else F.col(f"{entity.name}.{a.field or a.name}")


def newest(df: DataFrame, time: Column, by_day: bool) -> datetime | None:
    """The latest time. Of a table that is written by day only the last day's times are read: which that is, the folders say."""
    if by_day and "event_date" in df.columns:
        day = df.agg(F.max("event_date")).first()[0]
        if day is not None:
            df = df.where(F.col("event_date") == F.lit(day))
    return df.agg(F.max(time)).first()[0]


def _in_range(df: DataFrame, time: Column, query: SemanticQuery, by_day: bool) -> DataFrame:
    """The rows of the query's time range. Tables that are written by day (``event_date``) are also cut by the day, so
    that other days' folders aren't opened."""
    if query.time_range is None:
        return df
    as_of = query.as_of
    if as_of is None and any(t and (t == "now" or t.startswith("-")) for t in query.time_range):
        as_of = newest(df, time, by_day)
    start, stop = (resolve_time(t, as_of) for t in query.time_range)
    by_day = by_day and "event_date" in df.columns
    if start is not None:
        df = df.where(time >= timestamp(start))
        df = df.where(F.col("event_date") >= F.lit(start.date())) if by_day else df
    if stop is not None:
        df = df.where(time <= timestamp(stop))
        df = df.where(F.col("event_date") <= F.lit(stop.date())) if by_day else df
    return df


ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.USub: operator.neg}


def formula_column(formula: str) -> Column:
    """The column of an arithmetic formula over metrics; a division by zero gives null, wherever it stands."""

    def column(node: ast.expr) -> Column:
        match node:
            case ast.BinOp(left, op, right) if type(op) in ARITHMETIC:
                return ARITHMETIC[type(op)](column(left), column(right))
            case ast.UnaryOp(ast.USub(), operand):
                return -column(operand)
            case ast.Name(name):
                return F.col(name)
            case ast.Constant(int() | float() as value):
                return F.lit(value)
        raise ValueError(f"only + - * / and brackets make a formula, not {ast.unparse(node)!r}")

    try:
        return column(ast.parse(formula, mode="eval").body)
    except SyntaxError:
        raise ValueError(f"{formula!r} is no formula") from None


def with_formulas(df: DataFrame, query: SemanticQuery, model: Model) -> DataFrame:
    """Add metrics with formulas, inner ones first."""

    def add(df: DataFrame, name: str) -> DataFrame:
        formula = model.metric(name).formula
        if formula is None or name in df.columns:
            return df
        for inner in formula_names(formula):
            df = add(df, inner)
        return df.withColumn(name, formula_column(formula))

    for name in query.metrics:
        df = add(df, name)
    return df


def _hot(query: SemanticQuery, model: Model, observables: DataFrame) -> DataFrame:
    metrics = [model.metric(b) for m in query.metrics for b in model.base_metrics(m)]
    types = sorted({m.type_id for m in metrics if m.type_id is not None})
    df = observables
    if types:
        df = df.where(F.col("type_id").isin(types))
    df = _in_range(df, F.col("event_time"), query, True)
    for f in query.filters:
        df = df.where(predicate(F.col(f.attribute), f, df.schema[f.attribute].dataType))
    bucket = [F.date_trunc(query.time_granularity, "event_time").cast("timestamp_ntz").alias("time_bucket")] if query.time_granularity else []
    grouped = df.groupBy(*bucket, "type_id")
    distinct = F.approx_count_distinct if query.approx else F.count_distinct
    counted = grouped.agg(*(((distinct("value")) if m.aggregation == "count_distinct" else F.count(F.lit(1))).alias(m.name) for m in metrics))
    return with_formulas(counted, query, model).select(*(["time_bucket"] if bucket else []), "type_id", *query.metrics)


def _finish(df: DataFrame, query: SemanticQuery) -> DataFrame:
    if query.order_by:
        df = df.orderBy(*(F.col(n).desc() if d.lower() == "desc" else F.col(n).asc() for n, d in query.order_by))
    if query.offset:
        df = df.offset(query.offset)
    return df.limit(query.limit) if query.limit is not None else df
