"""Names for terms that users type: exact ones by equality, near ones from an inverted index.

A name is near a term if one contains the other, if they begin with the same three letters or more, or if they have a
word in common. Each of these leaves a key that both have: one of the shorter text's pieces of three letters (its
rarest one is looked up), the first three letters, a word. So candidates come from equality joins, and only they are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a piece; shorter texts are one piece.
Q = 3
#: What a containment, a letter of a common beginning and a common word count, and the least beginning.
CONTAINED, LETTER, WORD, LEAST_PREFIX = 100, 10, 20, 3


def grams(c: Column) -> Column:
    """All pieces of at most three letters in a text."""
    piece = lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(q)))
    return F.array_distinct(F.flatten(F.array(*(piece(q) for q in range(1, Q + 1)))))


def own_grams(c: Column) -> Column:
    """The pieces by which a text can be looked up in those that contain it: of three letters, or itself if it is shorter."""
    return F.filter(grams(c), lambda g: F.length(g) == F.least(F.length(c), F.lit(Q)))


def score(a: Column, b: Column) -> Column:
    """How near two lower-case texts are; null if not at all."""
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), lambda n, i: F.when(F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i), i).otherwise(n))
    words = F.size(F.array_intersect(F.split(a, r"\s+"), F.split(b, r"\s+")))
    return F.when(F.contains(a, b) | F.contains(b, a), CONTAINED).when(common >= LEAST_PREFIX, common * LETTER).when(words > 0, words * WORD)


def _rarest(texts: DataFrame, column: str, frequency: DataFrame) -> DataFrame:
    """(column, gram): each text's piece that the fewest texts of the other side have; texts with a piece that none has are
    in none of them and go."""
    own = texts.select(column, F.explode(own_grams(F.col(column))).alias("gram"))
    known = own.join(frequency, "gram", "left")
    return known.groupBy(column).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0").select(column, "gram")


def near_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name, score) for distinct lower-case ``term`` and ``name`` texts that are near each other; empty ones are near none."""
    a = terms.select("term").where(F.length("term") > 0).distinct()
    b = names.select("name").where(F.length("name") > 0).distinct()
    all_a, all_b = (df.select(c, F.explode(grams(F.col(c))).alias("gram")) for df, c in ((a, "term"), (b, "name")))
    count = lambda df: df.groupBy("gram").agg(F.count("*").alias("n"))
    pair = ["term", "name"]
    longer = lambda x, y: F.length(x) >= F.length(y)
    inside_name = _rarest(a, "term", count(all_b)).join(all_b, "gram").where(longer("name", "term")).select(*pair)
    inside_term = _rarest(b, "name", count(all_a)).join(all_a, "gram").where(longer("term", "name")).select(*pair)
    keyed = lambda df, c: df.select(c, F.explode(F.array_distinct(F.concat(F.transform(F.split(c, r"\s+"), lambda w: F.concat(F.lit("w"), w)), F.when(F.length(c) >= LEAST_PREFIX, F.array(F.concat(F.lit("p"), F.substring(c, 1, LEAST_PREFIX)))).otherwise(F.array().cast("array<string>"))))).alias("key"))
    alike = keyed(a, "term").join(keyed(b, "name"), "key").select(*pair)
    found = inside_name.unionByName(inside_term).unionByName(alike).distinct().withColumn("score", score(F.col("term"), F.col("name")))
    return found.where(F.col("score").isNotNull())


def resolve_terms(terms: DataFrame, dictionary: DataFrame, n: int = 3) -> DataFrame:
    """(term, entity, attribute, matched, suggestions): names of any case; a canonical name goes before a synonym.

    The dictionary is (entity, attribute, synonyms). Terms that nothing equals get the ``n`` attributes with the nearest
    names. Null and empty terms are near nothing.
    """
    names = dictionary.select("entity", "attribute", F.lower("attribute").alias("name"), F.lit(0).alias("synonym")).unionByName(dictionary.select("entity", "attribute", F.explode("synonyms").alias("name"), F.lit(1).alias("synonym")).withColumn("name", F.lower("name")))
    best = names.groupBy("name").agg(F.min(F.struct("synonym", "entity", "attribute")).alias("b"))
    asked = terms.select("term").distinct().withColumn("name", F.lower("term"))
    hit = asked.join(best, "name", "left")
    resolved = hit.where(F.col("b").isNotNull()).select("term", "b.entity", "b.attribute", F.when(F.col("b.synonym") == 0, "canonical").otherwise("synonym").alias("matched"), F.lit(None).cast("array<string>").alias("suggestions"))
    rest = hit.where(F.col("b").isNull()).select("term", F.col("name").alias("lower"))
    near = near_names(rest.select(F.col("lower").alias("term")), names).withColumnRenamed("term", "lower")
    scored = rest.join(near, "lower").join(names.select("name", "attribute").distinct(), "name")
    each = scored.groupBy("term", "attribute").agg(F.max("score").alias("score"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "attribute"))).where(F.col("r") <= n)
    listed = ranked.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "attribute"))), lambda x: x["attribute"]).alias("suggestions"))
    missing = rest.join(listed, "term", "left").select("term", F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("attribute"), F.lit("none").alias("matched"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
    return resolved.unionByName(missing)
