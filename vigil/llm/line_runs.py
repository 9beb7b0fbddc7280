"""Removal of repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

Lines with words get 128-bit ids. Lines that occur once can't be part of a repeated run, so only suffixes that
start with a repeated line are ranked. Round k ranks each suffix by its first 2**k lines: the pair of the ranks
of its two halves, in sorted order. Suffixes alone in their rank drop out, and doubling goes on until all have. The
ranks of all rounds are the suffix order; the suffixes of one rank are a longest-common-prefix interval of depth
2**k or more, and an interval of any depth in between is read off two ranks that overlap. The longest common prefix
of two suffixes is found by going down the rounds and stepping on wherever their ranks agree.

A run counts from ``least_words`` words on. Of each run that repeats, the copy that comes first, by doc_id and
line, stays; the lines of later copies go. A line belongs to such a copy exactly if it lies in a shortest run of
enough words, grown to the right from its first line or to the left from its last, that has an earlier copy. The
intervals of these depths give each such run's first copy; from there it is grown to its longest common prefix
with it, and runs that lie on another that follows the same copy are left out. What stays are the maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, carried, nothing_kept, restored, text_batches

#: Words from which a repeated run is removed.
LEAST_WORDS = 8
LINES = "doc long, tie long, at int, hi long, lo long, right int, left int"
#: Position of a document whose id is null: after all others.
LAST = (1 << 63) - 1


def _key(docs: DataFrame) -> dict[str, Column]:
    """The key that names a document and orders copies; rows with equal id and text share a key."""
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tie": F.xxhash64(F.coalesce("text", F.lit("")))}


def lines_of(text: str) -> list[str]:
    return [s for s in (x.strip() for x in text.split("\n")) if s]


def explode_lines(docs: DataFrame, least_words: int) -> DataFrame:
    """A row for each line with words: its place among them, its id, and the lengths of the shortest runs of
    enough words that start (``right``) or end (``left``) with it; 0 if the document has no such run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for rows in text_batches(batches, "text"):
            found = [lines_of(x) for x in rows.column("text").to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = [s for x in found for s in x]
            ids = np.array([divmod(xxhash.xxh3_128_intdigest(s.encode()), 1 << 64) for s in flat], np.uint64).reshape(-1, 2).view(np.int64)
            words = np.fromiter((len(s.split()) for s in flat), np.int64, len(flat))
            sums = np.concatenate([[0], np.cumsum(words)])
            first = np.repeat(np.cumsum(counts) - counts, counts)
            stop = first + np.repeat(counts, counts)
            here = np.arange(len(flat))
            end = np.searchsorted(sums, sums[here] + least_words)  # the run is here .. end - 1
            start = np.searchsorted(sums, sums[here + 1] - least_words, side="right") - 1
            right = np.where(end <= stop, end - here, 0)
            left = np.where(start >= first, here + 1 - start, 0)
            owner = pa.array(np.repeat(np.arange(len(found)), counts))
            yield pa.RecordBatch.from_pydict({"doc": rows.column("doc").take(owner), "tie": rows.column("tie").take(owner), "at": pa.array(here - first, pa.int32()), "hi": ids[:, 0], "lo": ids[:, 1], "right": pa.array(right, pa.int32()), "left": pa.array(left, pa.int32())})

    # rows that repeat an id and a text have the same lines at the same places
    return docs.select("doc", "tie", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, LINES).dropDuplicates(["doc", "tie", "at"])


def _ranked(groups: DataFrame, keys: list[str], work: Workspace, name: str) -> DataFrame:
    """A number for each row that grows in the order of its keys; rows are distinct, so no range is crowded."""
    return work.table(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def _ahead(rank: str, steps: Column | int) -> Column:
    """The rank of the same document's suffix that starts ``steps`` lines later, null if it was dropped."""
    return F.max(rank).over(Window.partitionBy("doc", "tie").orderBy("at").rangeBetween(steps, steps))


def ranks(lines: DataFrame, work: Workspace, whole: bool = True) -> list[DataFrame]:
    """For k = 0, 1, ...: the suffixes whose first 2**k lines occur again, with their rank by these lines; until no rank
    is shared, or without ``whole`` as far as the shortest runs of enough words reach."""
    groups = lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ranked = _ranked(groups, ["hi", "lo"], work, "ranks-0")
    found = [work.table(lines.join(ranked, ["hi", "lo"]).drop("hi", "lo"), "suffixes-0")]
    work.drop("lines", "ranks-0")
    longest = max(x or 0 for x in found[0].agg(F.max("right"), F.max("left")).first())
    while True:
        k = len(found)
        if not whole and (1 << k) > longest:
            return found
        pairs = work.table(found[-1].select("doc", "tie", "at", "rank").withColumn("next", _ahead("rank", 1 << (k - 1))).where(F.col("next").isNotNull()), f"pairs-{k}")
        groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rank").alias("head"), F.col("next").alias("tail"))
        ranked = _ranked(groups, ["head", "tail"], work, f"ranks-{k}")
        if ranked.isEmpty():
            return found
        alive = pairs.withColumnsRenamed({"rank": "head", "next": "tail"}).join(ranked, ["head", "tail"]).drop("head", "tail")
        found.append(work.table(alive, f"suffixes-{k}"))
        work.drop(f"pairs-{k}", f"ranks-{k}")


def repeated_windows(levels: list[DataFrame], work: Workspace) -> DataFrame:
    """(doc, tie, start, length, first, copies) of the shortest runs of enough words that have an earlier copy:
    the members of their interval but the first, with the first's place and the interval's size."""
    sides = [levels[0].where(f"{side} > 0").select("doc", "tie", start.alias("start"), F.col(side).alias("length")) for side, start in (("right", F.col("at")), ("left", F.col("at") - F.col("left") + 1))]
    runs = sides[0].unionByName(sides[1]).distinct().withColumn("k", F.length(F.bin("length")) - 1)
    # runs of 2**k .. 2**(k + 1) - 1 lines, by the ranks of their first and last 2**k lines
    ladder = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("k"), "doc", "tie", "at", "rank") for k, x in enumerate(levels)])
    head = ladder.withColumnsRenamed({"at": "start", "rank": "head"})
    tail = ladder.withColumnsRenamed({"at": "tail_at", "rank": "tail"})
    tail_at = F.col("start") + F.col("length") - F.expr("shiftleft(1, k)")
    found = runs.join(head, ["k", "doc", "tie", "start"]).withColumn("tail_at", tail_at).join(tail, ["k", "doc", "tie", "tail_at"])
    runs = work.table(found.select("doc", "tie", "start", "length", "head", "tail"), "runs")
    firsts = runs.groupBy("length", "head", "tail").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = runs.join(firsts, ["length", "head", "tail"]).where(F.struct("doc", "tie", "start") != F.col("first"))
    return work.table(later.select("doc", "tie", "start", "length", "first", "copies"), "windows")


def maximal_runs(windows: DataFrame, levels: list[DataFrame], work: Workspace) -> DataFrame:
    """(doc, tie, start, length, copy_doc, copy_tie, copy_start, copies): the windows grown to their longest common
    prefix with their first copy, without those that lie on another that follows the same copy."""
    copy = {f"copy_{c}": F.col(f"first.{c}") for c in ("doc", "tie", "start")}
    pairs = windows.select("doc", "tie", "start", *(c.alias(n) for n, c in copy.items()), "copies").groupBy("doc", "tie", "start", *copy).agg(F.max("copies").alias("copies"))
    along = Window.partitionBy("doc", "tie", "copy_doc", "copy_tie", F.col("start") - F.col("copy_start")).orderBy("start")
    behind = F.lag("start").over(along)
    # the prefix of a window that follows another on the same copy ends where the other's does
    pairs = work.table(pairs.withColumn("behind", behind).where(F.col("behind").isNull() | (F.col("behind") < F.col("start") - 1)).drop("behind").withColumn("length", F.lit(0)), "pairs")
    for k in range(len(levels) - 1, -1, -1):
        mine = levels[k].select("doc", "tie", F.col("at").alias("here"), F.col("rank").alias("mine"))
        others = levels[k].select(F.col("doc").alias("copy_doc"), F.col("tie").alias("copy_tie"), F.col("at").alias("there"), F.col("rank").alias("other"))
        ahead = pairs.withColumns({"here": F.col("start") + F.col("length"), "there": F.col("copy_start") + F.col("length")})
        both = ahead.join(mine, ["doc", "tie", "here"], "left").join(others, ["copy_doc", "copy_tie", "there"], "left")
        agree = F.coalesce(F.col("mine") == F.col("other"), F.lit(False))
        pairs = both.withColumn("length", F.col("length") + F.when(agree, 1 << k).otherwise(0)).select(*pairs.columns)
        if k % 3 == 0:  # plans stay small
            pairs = work.table(pairs, f"grown-{k}")
            work.drop("pairs", f"grown-{k + 3}")
    return pairs


def repeated_runs(docs: DataFrame, work: Workspace, least_words: int = LEAST_WORDS) -> DataFrame:
    """The maximal runs of later copies in ``docs`` (doc, tie, text): see ``maximal_runs``."""
    lines = work.table(explode_lines(docs, least_words), "lines")
    levels = ranks(lines, work)
    runs = maximal_runs(repeated_windows(levels, work), levels, work)
    return runs


def _rewritten_docs(docs: DataFrame, work: Workspace, least_words: int, grown: bool) -> DataFrame:
    """The carried columns and ``new``: text, n_lines, n_deleted. The runs that go are maximal ones if ``grown``, else the
    shortest ones of enough words, which together cover the same lines and take half the jobs."""
    keyed = docs.select(*(c.alias(n) for n, c in _key(docs).items()), "text")
    if grown:
        runs = repeated_runs(keyed, work, least_words)
    else:
        runs = repeated_windows(ranks(work.table(explode_lines(keyed, least_words), "lines"), work, whole=False), work)
    # a document has at most two such runs for each line; both sides of the join grow with the corpus
    marks = work.table(runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "length")).alias("runs")), "marks")
    work.keep_only("marks")

    def rewrite(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_rewritten(t, r) for t, r in zip(text, runs, strict=True)], columns=["text", "n_lines", "n_deleted"])

    rewritten = F.pandas_udf(rewrite, "text string, n_lines long, n_deleted long")
    return carried(docs, text=F.col("text"), **_key(docs)).join(marks.hint("merge"), ["doc", "tie"], "left").withColumn("new", rewritten("text", "runs"))


def remove_repeated_runs(docs: DataFrame, work: Workspace, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text less its later copies of repeated runs, and the lines before (``n_lines``)
    and removed (``n_deleted``), which go before columns of these names.

    Lines are compared without white space at their ends; those without words stay, unless the line with words
    before them goes. A null text has no lines and stays null, an empty one stays empty; a very long one is cut into
    lines in a batch of its own. Documents with a null id come last. Of equal runs at two places the one of the smaller
    id, then of the smaller hash of its text, then the upper one stays; rows with equal id and text count once and get
    the same result. An empty table gives no rows. Columns are carried under numbers, so their names can't clash.
    """
    found = _rewritten_docs(docs, work, least_words, True)
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return found.select(*(F.col("new.text").alias(c) if c == "text" else F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns) if c in own), F.col("new.n_lines").alias("n_lines"), F.col("new.n_deleted").alias("n_deleted"))


def without_repeated_runs(docs: DataFrame, work: Workspace, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with their columns, the text rewritten as by ``remove_repeated_runs``, ``n_chars`` (if there
    is such a column) counted anew where lines went; rows that lost all their words are left out."""
    found = _rewritten_docs(docs, work, least_words, False)
    found = found.where((F.col("new.n_deleted") == 0) | F.col("new.text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("new.text")}
    if "n_chars" in docs.columns:
        old = F.col(f"carried_{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("new.n_deleted") == 0, old).otherwise(F.length("new.text").cast(docs.schema["n_chars"].dataType))
    return restored(found, docs, **new)


def _rewritten(text: str | None, runs: list | None) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    raw = text.split("\n")
    filled = [bool(x.strip()) for x in raw]
    if runs is None or not len(runs):
        return text, sum(filled), 0
    change = np.zeros(sum(filled) + 1, np.int64)
    for r in runs:
        change[r["start"]] += 1
        change[r["start"] + r["length"]] -= 1
    gone = np.cumsum(change) > 0
    kept, at, last_gone = [], -1, False
    for line, full in zip(raw, filled, strict=True):
        if full:
            at += 1
            last_gone = bool(gone[at])
        if not last_gone:
            kept.append(line)
    return "\n".join(kept), sum(filled), int(gone.sum())
