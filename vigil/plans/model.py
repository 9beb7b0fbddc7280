"""Semantic models: entities with attributes, metrics and relationships, as plain Python objects."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from typing import Any

#: Operators of a filter, with the number of values that each takes (None: a list).
OPERATORS = {"=": 1, "!=": 1, ">": 1, ">=": 1, "<": 1, "<=": 1, "in": None, "not in": None, "like": 1, "is null": 0, "is not null": 0}
GRANULARITIES = ("minute", "hour", "day", "week", "month")
AGGREGATIONS = ("count", "sum", "avg", "min", "max", "count_distinct")


@dataclass(frozen=True)
class Attribute:
    """A name for a column, a nested path or a SQL expression; an expression goes before a field, a field before the name."""

    name: str
    field: str | None = None
    expression: str | None = None
    dimension: bool = True
    visible: bool = True
    synonyms: tuple[str, ...] = ()
    value_pattern: str | None = None


@dataclass(frozen=True)
class Metric:
    """An aggregate of an entity, a formula over other metrics, or a count over the indicator table.

    A sum that may not be taken over some attributes (``not_summed_over``, the first of them times) is the sum of each
    series' last value; ``series`` names the attributes that tell series apart.
    """

    name: str
    entity: str
    aggregation: str = "count"
    measure: str = "*"
    filter: str | None = None
    formula: str | None = None
    hot: bool = False
    type_id: int | None = None
    not_summed_over: tuple[str, ...] = ()
    series: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """A join to another entity under an alias; the condition names both by entity name or alias."""

    name: str
    target: str
    condition: str
    alias: str | None = None
    many_to_many: bool = False


@dataclass(frozen=True)
class Entity:
    name: str
    attributes: tuple[Attribute, ...]
    relationships: tuple[Relationship, ...] = ()
    class_uids: tuple[int, ...] = ()
    time_column: str = "time"
    covers_observables: tuple[int, ...] = ()

    def attribute(self, name: str) -> Attribute:
        for a in self.attributes:
            if a.name == name:
                return a
        raise ValueError(f"{self.name} has no attribute {name!r}; it has {', '.join(a.name for a in self.attributes)}")


@dataclass(frozen=True)
class Filter:
    attribute: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class SemanticQuery:
    """What to ask of an entity. ``path`` is auto, hot (indicator table) or cold (events)."""

    entity: str
    select: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    time_range: tuple[str | None, str | None] | None = None
    time_granularity: str | None = None
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int | None = None
    path: str = "auto"
    relationships: tuple[str, ...] | None = None
    as_of: Any = None
    approx: bool = False


@dataclass
class Model:
    entities: dict[str, Entity] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)

    @classmethod
    def of(cls, entities: list[Entity], metrics: list[Metric]) -> Model:
        return cls({e.name: e for e in entities}, {m.name: m for m in metrics})

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Model:
        """A model from nested dicts and lists, as a YAML or JSON file holds it."""
        entities = [
            Entity(**{**e, "attributes": tuple(Attribute(**{**a, "synonyms": tuple(a.get("synonyms", ()))}) for a in e["attributes"]), "relationships": tuple(Relationship(**r) for r in e.get("relationships", ())), "class_uids": tuple(e.get("class_uids", ())), "covers_observables": tuple(e.get("covers_observables", ()))})
            for e in data["entities"]
        ]
        metrics = [Metric(**{**m, **{k: tuple(m.get(k, ())) for k in ("not_summed_over", "series")}}) for m in data.get("metrics", ())]
        return cls.of(entities, metrics)

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise ValueError(f"no entity {name!r}; there are {', '.join(sorted(self.entities))}")
        return self.entities[name]

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise ValueError(f"no metric {name!r}; there are {', '.join(sorted(self.metrics))}")
        return self.metrics[name]

    def base_metrics(self, name: str, above: tuple[str, ...] = ()) -> list[str]:
        """The metrics that a metric's formula needs, itself if it has none; formulas may not go in circles."""
        if name in above:
            raise ValueError(f"the formulas of {' -> '.join((*above, name))} go in a circle")
        formula = self.metric(name).formula
        if formula is None:
            return [name]
        return list(dict.fromkeys(b for n in formula_names(formula) for b in self.base_metrics(n, (*above, name))))


def formula_names(formula: str) -> list[str]:
    """The metric names in an arithmetic formula."""
    try:
        tree = ast.parse(formula, mode="eval")
    except SyntaxError:
        raise ValueError(f"{formula!r} is no formula") from None
    names = [node for node in ast.walk(tree) if isinstance(node, ast.Name)]
    return list(dict.fromkeys(node.id for node in sorted(names, key=lambda node: (node.lineno, node.col_offset))))


def validate(query: SemanticQuery, model: Model) -> None:
    """Raise ValueError before any job if the query asks for what the model doesn't have."""
    entity = model.entity(query.entity)
    if not (query.select or query.metrics):
        raise ValueError("select at least one attribute or metric")
    for name in (*query.select, *query.group_by, *(f.attribute for f in query.filters)):
        entity.attribute(name)
    for name in query.group_by:
        if not entity.attribute(name).dimension:
            raise ValueError(f"{name} is not a dimension")
    for f in query.filters:
        if f.operator not in OPERATORS:
            raise ValueError(f"no operator {f.operator!r}")
    for name in query.metrics:
        for base in model.base_metrics(name):
            metric = model.metric(base)
            if metric.aggregation not in AGGREGATIONS:
                raise ValueError(f"no aggregation {metric.aggregation!r}")
            if metric.not_summed_over and metric.aggregation != "sum":
                raise ValueError(f"{base} is no sum, so it has nothing that it is not summed over")
            for attribute in (*metric.not_summed_over, *metric.series):
                entity.attribute(attribute)
    if query.time_granularity not in (None, *GRANULARITIES):
        raise ValueError(f"no granularity {query.time_granularity!r}")
    aliases: dict[str, list[str | None]] = {}
    for r in entity.relationships:
        model.entity(r.target)
        aliases.setdefault(r.target, []).append(r.alias)
    for target, names in aliases.items():
        if len(names) > 1 and len({n or target for n in names}) < len(names):
            raise ValueError(f"relationships to {target} need aliases of their own")
    if query.path == "hot" and not all(model.metric(b).hot for m in query.metrics for b in model.base_metrics(m)):
        raise ValueError("only metrics of the indicator table take the hot path")
