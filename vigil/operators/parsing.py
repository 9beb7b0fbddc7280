"""Raw log records: their format, and their fields as rows (record, path, value, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How lines of the known formats begin or look.
BSD_TIME = r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
BSD_LINE = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
ISO_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
PAIR = r"""(\w+)=(?:"([^"]*?)"|'([^']*?)'|(\S+))"""
NUMBER = r"^-?\d+(\.\d+)?$"


def trimmed(column: str | Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def filled_lines(column: Column) -> Column:
    return F.filter(F.split(column, "\n"), lambda x: F.length(F.trim(x)) > 0)


def detect_log_format(column: str | Column) -> Column:
    """json, csv, syslog or kv; json also where nothing fits."""
    text = trimmed(column)
    commas = lambda i: F.regexp_count(F.get(filled_lines(text), F.lit(i)), F.lit(","))
    return (
        F.when(text.rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull(), "json")
        .when((F.size(filled_lines(text)) > 1) & (commas(0) > 0) & (commas(0) == commas(1)), "csv")
        .when(text.rlike(BSD_TIME) | text.rlike(ISO_TIME), "syslog")
        .when(text.rlike(r"\w+=\S+"), "kv")
        .otherwise("json")
    )


def infer_value_type(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin("", "null", "NULL"), "null").when(c.isin("true", "false", "TRUE", "FALSE"), "boolean").when(c.rlike(NUMBER), "number").otherwise("string")


def pairs(column: Column) -> Column:
    """All k=v, k="v" and k='v' of a text, repeats kept, as structs of path and value."""
    group = lambda i: F.regexp_extract_all(column, F.lit(PAIR), F.lit(i))
    return F.transform(F.arrays_zip(group(1).alias("k"), group(2).alias("a"), group(3).alias("b"), group(4).alias("c")), lambda x: F.struct(x["k"].alias("path"), F.concat(x["a"], x["b"], x["c"]).alias("value")))


def parse_kv(df: DataFrame, key: str, column: str) -> DataFrame:
    found = df.select(key, F.posexplode(pairs(trimmed(column))).alias("position", "f")).select(key, "position", "f.path", "f.value")
    return found.withColumn("type", infer_value_type("value"))


def parse_syslog(df: DataFrame, key: str, column: str) -> DataFrame:
    """timestamp, hostname, process, pid, message and the message's pairs; a line of neither form is ``raw``."""
    text = trimmed(column)
    line = F.when(text.rlike(BSD_LINE), F.lit(BSD_LINE)).when(text.rlike(ISO_LINE), F.lit(ISO_LINE))
    parts = df.where(F.length(text) > 0).select(key, text.alias("text"), line.isNotNull().alias("known"), *(F.when(text.rlike(BSD_LINE), F.regexp_extract(text, BSD_LINE, i)).when(text.rlike(ISO_LINE), F.regexp_extract(text, ISO_LINE, i)).alias(n) for i, n in enumerate(("timestamp", "hostname", "process", "pid", "message"), 1)))
    field = lambda path, value, kind: F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(kind).alias("type"))
    fixed = F.array(*(field(n, F.col(n), "number" if n == "pid" else "string") for n in ("timestamp", "hostname", "process", "pid", "message")), field("raw", F.when(~F.col("known"), F.col("text")), "string"))
    fixed = F.filter(fixed, lambda x: x["value"].isNotNull() & ((x["path"] != "pid") | (x["value"] != "")))
    own = F.transform(F.coalesce(pairs(F.col("message")), F.array()), lambda x: F.struct(F.concat(F.lit("message."), x["path"]).alias("path"), x["value"].alias("value"), infer_value_type(x["value"]).alias("type")))
    return parts.select(key, F.explode(F.concat(fixed, own)).alias("f")).select(key, "f.*")


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, quotes and doubled quotes resolved."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'((?:[^",]|"(?:[^"]|"")*")*),'), F.lit(1))
    whole = r'^\s*"((?:[^"]|"")*)"\s*$'
    return F.transform(cells, lambda x: F.trim(F.when(x.rlike(whole), F.replace(F.regexp_extract(x, whole, 1), F.lit('""'), F.lit('"'))).otherwise(F.replace(x, F.lit('"'), F.lit("")))))


def parse_csv(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, row, position, path, value, type): header names with the values of every data row, rows counted from 0.

    A name that is missing is column_i, a value that is missing empty; a header alone gives its names with empty texts.
    """
    lines = df.select(key, filled_lines(trimmed(column)).alias("lines"))
    names = csv_cells(F.get("lines", F.lit(0))).alias("names")
    rows = lines.select(key, names, F.posexplode_outer(F.when(F.size("lines") > 1, F.slice("lines", F.lit(2), F.size("lines")))).alias("row", "line"))
    cells = rows.select(key, F.coalesce("row", F.lit(0)).alias("row"), F.coalesce(csv_cells(F.col("line")), F.array()).alias("cells"), F.col("line").isNotNull().alias("has_row"), "names")
    found = cells.select(key, "row", "cells", "has_row", F.posexplode("names").alias("position", "name"))
    value = F.coalesce(F.get("cells", F.col("position")), F.lit(""))
    path = F.when(F.col("name") == "", F.concat(F.lit("column_"), F.col("position"))).otherwise(F.col("name"))
    return found.select(key, "row", "position", path.alias("path"), value.alias("value"), F.when(F.col("has_row"), infer_value_type(value)).otherwise("string").alias("type"))


def variant_kind(column: Column, split_numbers: bool = False) -> Column:
    """null, array, object, boolean, string or number; with ``split_numbers`` integer (also 1.0) or float for number."""
    kind = F.schema_of_variant(column)
    number = F.lit("number")
    if split_numbers:
        number = F.when(kind == "BIGINT", "integer").when(F.try_variant_get(column, "$", "double") % 1 == 0, "integer").otherwise("float")
    return F.when(column.isNull() | F.is_variant_null(column), "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").otherwise(number)


def json_depth(column: str | Column) -> Column:
    """How deep the objects and arrays of a JSON text are nested."""
    brackets = F.regexp_replace(F.regexp_replace(column, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def flatten_json(df: DataFrame, key: str, column: str, max_depth: int | None = None, split_numbers: bool = False) -> DataFrame:
    """Every leaf and every array of JSON texts with its path; texts that aren't JSON give no rows.

    Levels are unfolded one by one in a single pass: a leaf is carried along, an object gives way to its parts, an array
    to itself and its parts. Without ``max_depth`` the deepest text is looked for first, so that nothing stays folded;
    with it, what is still an object below is given as JSON text. An empty object gives no row.
    """
    if max_depth is None:
        text = trimmed(column)
        max_depth = df.where(F.try_parse_json(text).isNotNull()).agg(F.max(json_depth(text))).first()[0] or 0
    parse = df.sparkSession.tvf.variant_explode_outer
    level = df.select(F.col(key).alias("record"), F.try_parse_json(trimmed(column)).alias("v"), F.lit("").alias("path"), F.lit(False).alias("done")).where(F.col("v").isNotNull())
    level = level.withColumn("type", variant_kind(F.col("v"), split_numbers))
    for _ in range(max_depth):
        opens = F.when(F.col("done") | ~F.col("type").isin("object", "array"), F.array(F.lit(False))).when(F.col("type") == "array", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
        split = level.select("*", F.explode(opens).alias("open"))
        parts = split.lateralJoin(parse(F.when(F.col("open").outer(), F.col("v").outer()))).where(~F.col("open") | F.col("pos").isNotNull())
        inner = F.when(F.col("type") == "array", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        level = parts.select("record", F.when(F.col("open"), F.col("value")).otherwise(F.col("v")).alias("v"), F.when(F.col("open"), inner).otherwise(F.col("path")).alias("path"), (~F.col("open")).alias("done"), F.when(F.col("open"), variant_kind(F.col("value"), split_numbers)).otherwise(F.col("type")).alias("type"))
    text = F.when(F.col("type") == "null", F.lit("null")).when(F.col("type").isin("array", "object"), F.to_json("v")).otherwise(F.col("v").cast("string"))
    level = level.where((F.col("type") != "object") | (F.to_json("v") != "{}"))
    return level.select(F.col("record").alias(key), F.when(F.col("path") == "", "root").otherwise(F.col("path")).alias("path"), text.alias("value"), "type")
