"""A corpus pipeline over documents: each stage works on what the one before it kept.

Rejected by the quality classifier or the quality rules, a document goes; repeated line runs go from texts, and
documents left without words; of near-duplicates one stays; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import line_runs, packing, quality_classifier, quality_rules, similar
from vigil.llm.queries import END_ID, SEQUENCE, tokenizer
from vigil.llm.shared import Workspace, workspaces

#: Near-duplicates: words in a shingle, bits in which linked fingerprints differ at most, and the least share of common
#: shingles of two texts.
WIDTH, RADIUS, SIMILAR = 5, 8, 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    Null and empty texts get the score of a text without features; very long texts are scored whole, in batches of their
    own. Repeated rows score alike, whatever their ids, and a score equal to the threshold is enough; an empty table stays
    empty. All stages but the last carry columns of any name.
    """
    return quality_classifier.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules hold good, by the posterior of their votes.

    The base rule of the query (20 words or more, few repeated windows) isn't applied: short clean documents stay.
    Null and empty texts have the votes of a text without words; very long texts are counted whole; documents with equal
    votes fare alike; an empty table stays empty.
    """
    return quality_rules.accept(docs, Workspace(spark))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of repeated line runs; those left without words go.

    Null and empty texts stay as they are; a very long text is cut into its lines, which are dealt like any others. Of equal
    runs the one of the smallest doc_id (null last) stays, in a document the first. Rows that repeat an id and a text count
    once. An empty table stays empty.
    """
    return line_runs.without_repeated_runs(docs, Workspace(spark))


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (null last).

    Null texts and texts without words are equal to each other; a very long text is hashed whole, in a batch of its own; of
    rows that repeat an id the first one stays. An empty table stays empty.
    """
    return similar.one_of_each(docs, WIDTH, RADIUS, SIMILAR, Workspace(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is one piece that holds the end id; a very long text is encoded whole and cut into pieces. Null ids
    and repeated rows are packed like any others, pieces of equal length in any order; an empty table gives no rows; extra
    columns are left out.
    """
    return packing.pack(docs, tokenizer(), END_ID, SEQUENCE, Workspace(spark))


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("line_dedup", dedupe_lines), ("simhash", dedupe_documents), ("packing", pack)]
#: SQL can express none of the learned stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written and read again as the next one's documents.

    What a stage wrote on its way is deleted once its result is written, and each result once the next one is. What
    the last stage's result reads stays.
    """
    work, docs = Workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with workspaces():
            docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
