"""From source fields to the event schema: class detection, mapping, conformance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: The targets of a cast, by name.
CASTS = {"Integer": "int", "BigInt": "bigint", "Float": "float", "Double": "double", "Boolean": "boolean", "String": "string", "Timestamp": "timestamp", "Date": "date"}
#: The column type of each schema type.
TYPES = {
    **dict.fromkeys(("string_t", "hostname_t", "ip_t", "mac_t", "email_t", "url_t", "path_t", "uuid_t", "subnet_t", "hash_t", "username_t", "process_name_t"), "string"),
    **dict.fromkeys(("integer_t", "long_t", "port_t"), "bigint"),
    **dict.fromkeys(("float_t", "double_t"), "double"),
    "boolean_t": "boolean",
    **dict.fromkeys(("timestamp_t", "datetime_t"), "timestamp"),
    **dict.fromkeys(("json_t", "object_t"), "string"),
    **dict.fromkeys(("bytestring_t", "binary_t"), "binary"),
}


@dataclass(frozen=True)
class Spec:
    """Source field to target path, with an optional transformation: lower, upper, trim or cast:<type>."""

    source: str
    target: str
    transform: str | None = None
    confidence: float = 1.0


def transformed(spec: Spec) -> Column:
    c = F.col(spec.source)
    match (spec.transform or "").partition(":"):
        case ("", _, _):
            return c
        case ("lower", _, _):
            return F.lower(c)
        case ("upper", _, _):
            return F.upper(c)
        case ("trim", _, _):
            return F.trim(c)
        case ("cast", _, kind) if kind in CASTS:
            return c.try_cast(CASTS[kind])
    raise ValueError(f"no transformation {spec.transform!r}")


def _nest(columns: dict[str, Column]) -> list[Column]:
    """Columns of dotted paths as nested structs."""
    tree: dict = {}
    for path, column in columns.items():
        at = tree
        *inner, leaf = path.split(".")
        for part in inner:
            at = at.setdefault(part, {})
        at[leaf] = column
    build = lambda x: F.struct(*(build(v).alias(k) for k, v in x.items())) if isinstance(x, dict) else x
    return [build(v).alias(k) for k, v in tree.items()]


def apply_mapping(df: DataFrame, specs: list[Spec], class_uid: int, category_uid: int, threshold: float = 0.5, keep_raw: bool = False) -> DataFrame:
    """One projection by all specs that reach the threshold; an error if none does."""
    threshold = min(1.0, max(0.0, threshold))
    chosen = [s for s in specs if s.confidence >= threshold]
    if not chosen:
        raise ValueError("no mapping reaches the confidence threshold")
    stamps = [F.lit(class_uid).alias("class_uid"), F.lit(category_uid).alias("category_uid")]
    raw = [F.to_json(F.struct(*df.columns)).alias("_raw_event"), F.current_timestamp().alias("_ingested_at")] if keep_raw else []
    return df.select(*_nest({s.target: transformed(s) for s in chosen}), *stamps, *raw)


def detect_event_class(df: DataFrame, dictionary: DataFrame, class_col: str = "class_uid", category_col: str = "category_uid") -> DataFrame:
    """Class and category of each record by the dictionary (class_uid, class_name, category_uid, category_name)."""
    classes = dictionary.select(F.col("class_uid").alias("known_class"), F.col("class_name").alias("found_class_name"), F.col("category_uid").alias("class_category"), F.col("category_name").alias("class_category_name")).distinct()
    categories = dictionary.select(F.col("category_uid").alias("known_category"), F.col("category_name").alias("own_category_name")).distinct()
    raw = F.col(class_col)
    number = F.when(raw.cast("string").rlike(r"^-?\d+$"), raw.try_cast("bigint"))
    own = F.when(F.col(category_col).cast("string").rlike(r"^-?\d+$"), F.col(category_col).try_cast("bigint"))
    found = df.withColumns({"_class": number, "_category": own}).join(classes, F.col("_class") == F.col("known_class"), "left").join(categories, F.col("_category") == F.col("known_category"), "left")
    error = F.when(raw.isNotNull() & F.col("_class").isNull(), F.lit("class_uid must be an integer")).when(F.col("_class").isNotNull() & F.col("known_class").isNull(), F.concat(F.lit("class_uid "), F.col("_class"), F.lit(" not found")))
    return found.select(
        *df.columns,
        F.col("_class").alias("detected_class_uid"),
        F.col("found_class_name").alias("class_name"),
        F.coalesce("_category", "class_category").alias("detected_category_uid"),
        F.coalesce("own_category_name", "class_category_name").alias("category_name"),
        F.when(F.col("_class").isNotNull(), "Definitive").otherwise("Low").alias("confidence"),
        error.alias("error"),
    )


def with_type_uid(df: DataFrame) -> DataFrame:
    return df.withColumn("type_uid", F.col("class_uid").cast("long") * 100 + F.col("activity_id"))


class _Node:
    """A part of the schema that a dictionary describes: parts by name, or a leaf's type."""

    def __init__(self) -> None:
        self.parts: dict[str, _Node] = {}
        self.leaf: str | None = None

    @property
    def ddl(self) -> str:
        return self.leaf or "struct<" + ", ".join(f"`{n}`: {x.ddl}" for n, x in self.parts.items()) + ">"


def _tree(dictionary: list[tuple[str, str, str, bool]]) -> _Node:
    """The dictionary's paths as a tree; ``[]`` after a name is only a mark of an array."""
    root = _Node()
    for path, kind, _, is_array in dictionary:
        node = root
        for part in path.replace("[]", "").split("."):
            node = node.parts.setdefault(part, _Node())
        to = TYPES.get(kind, "string")
        node.leaf = f"array<{to}>" if is_array else to
    if any(x.leaf and x.parts for x in _all(root)):
        raise ValueError("an attribute of the dictionary has both a type and parts")
    return root


def _all(node: _Node) -> list[_Node]:
    return [node, *(y for x in node.parts.values() for y in _all(x))]


def _conformed(column: Column, kind: DataType, node: _Node) -> Column:
    """A column in the shape and types of its part of the schema; arrays of objects element by element."""
    if node.leaf:
        if isinstance(kind, StructType) or (isinstance(kind, ArrayType) and not node.leaf.startswith("array")):
            return F.to_json(column).try_cast(node.leaf)
        if node.leaf.startswith("array") and not isinstance(kind, ArrayType):
            return F.when(column.isNotNull(), F.array(column)).try_cast(node.leaf)
        return column.try_cast(node.leaf)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _conformed(x, kind.elementType, node))
    if not isinstance(kind, StructType):
        return F.lit(None).cast(node.ddl)
    part = lambda n, x: _conformed(column.getField(n), kind[n].dataType, x) if n in kind.names else F.lit(None).cast(x.ddl)
    return F.when(column.isNotNull(), F.struct(*(part(n, x).alias(n) for n, x in node.parts.items())))


def _lacks(column: Column, kind: DataType, parts: list[str]) -> Column:
    """Whether a place that a path leads to is null; of an array of objects, whether any of its elements' is."""
    if isinstance(kind, ArrayType) and parts:
        return column.isNull() | F.exists(column, lambda x: _lacks(x, kind.elementType, parts))
    if not parts:
        return column.isNull()
    return column.isNull() | _lacks(column.getField(parts[0]), kind[parts[0]].dataType, parts[1:])


def conform(df: DataFrame, dictionary: list[tuple[str, str, str, bool]] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events in the shape of a class's dictionary (path, type, requirement, is_array), and the rows that lack what is required.

    Paths may lead through objects and arrays of objects. A type that isn't known is a string, an object where the
    dictionary has a leaf is JSON text; an attribute that the data lacks is null, what the dictionary lacks is left out.
    Rejected rows have their required attributes that are null in ``missing``. A dictionary may be a table, of the
    size of a schema.
    """
    if isinstance(dictionary, DataFrame):
        dictionary = [tuple(r) for r in dictionary.select("path", "type", "requirement", "is_array").collect()]
    root = _tree(dictionary)
    columns = {n: _conformed(F.col(f"`{n}`"), df.schema[n].dataType, x) if n in df.columns else F.lit(None).cast(x.ddl) for n, x in root.parts.items()}
    shaped = df.select(*(c.alias(n) for n, c in columns.items()))
    lacking = []
    for path, _, requirement, _ in dictionary:
        if requirement == "required":
            first, *parts = path.replace("[]", "").split(".")
            lacking.append(F.when(_lacks(F.col(f"`{first}`"), shaped.schema[first].dataType, parts), F.lit(path)))
    missing = F.array_compact(F.array(*lacking)) if lacking else F.array().cast("array<string>")
    checked = shaped.withColumn("missing", missing)
    return checked.where(F.size("missing") == 0).drop("missing"), checked.where(F.size("missing") > 0)
