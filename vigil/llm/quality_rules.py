"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good (+1), bad (-1) or abstains (0). Documents with equal votes are counted, at most
3 ** len(RULES) patterns however many documents there are. From these counts, expectation-maximisation
estimates how often each rule casts each vote on good and on bad documents; a document is kept if it is
more likely good than ``least`` under its votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, carried, nothing_kept, restored, text_batches

SYMBOLS = "[#*$%&|<>]"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long, n_marks long, n_ended_lines long, n_same_next long, most_common_word long"
WINDOW = 8
#: A document is kept if it is at least as likely good as bad.
LEAST = 0.5


def repeated_window_words(codes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Flags the words that lie in a window of ``width`` words which its text holds twice or more.

    Windows get exact numbers by doubling: a window of 2k words is the pair of the numbers of its halves.
    """
    n = len(codes)
    flags = np.zeros(n, bool)
    if n < width:
        return flags
    named, k = pd.factorize(codes)[0].astype(np.int64), 1
    while k < width:
        step = min(k, width - k)
        pair = named[: len(named) - step] * (named.max() + 1) + named[step:]
        named, k = pd.factorize(pair)[0].astype(np.int64), k + step
    inside = owner[: n - width + 1] == owner[width - 1 :]
    at = np.flatnonzero(inside)
    key = pd.factorize(owner[at] * (named.max() + 1) + named[at])[0]
    twice = at[np.bincount(key)[key] >= 2]
    change = np.zeros(n + 1, np.int64)
    change[twice] += 1
    change[twice + width] -= 1
    return np.cumsum(change[:-1]) > 0


def measure(docs: DataFrame) -> DataFrame:
    """All columns but ``measured_text`` and the counts that the rules go by; a null text has no words and no lines."""
    kept = [c for c in docs.columns if c != "measured_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for rows in text_batches(batches, "measured_text"):
            raw = [x or b"" for x in rows.column("measured_text").cast(pa.binary()).to_pylist()]
            words = [x.split() for x in raw]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            owner = np.repeat(np.arange(len(words)), counts)
            flat = [w for x in words for w in x]
            codes, names = pd.factorize(np.array(flat + [None], object)[:-1])
            codes = codes.astype(np.int64)
            per_doc = lambda flags: np.bincount(owner, flags, len(words)).astype(np.int64)  # noqa: E731, B023
            same = np.zeros(len(codes), bool)
            same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
            pair, of_doc = pd.factorize(owner * (len(names) + 1) + codes)
            most = np.zeros(len(words), np.int64)
            np.maximum.at(most, of_doc // (len(names) + 1), np.bincount(pair, minlength=len(of_doc)))
            columns = {c: rows.column(c) for c in kept} | {"n_words": counts, "n_same_next": per_doc(same), "most_common_word": most, "n_repeat_words": per_doc(repeated_window_words(codes, owner, WINDOW))}
            lines = [[s for s in x.split(b"\n") if s.strip()] for x in raw]
            n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
            columns |= {"n_lines": n_lines, "n_dup_lines": n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(lines)), "n_ended_lines": np.array([sum(s.rstrip()[-1:] in b".!?:;\"')" for s in x) for x in lines], np.int64)}
            text = [x or "" for x in rows.column("measured_text").to_pylist()]
            columns["word_chars"] = np.array([len(t) - sum(map(t.count, " \t\n\r\x0b\x0c")) for t in text], np.int64)
            columns["n_symbols"] = np.array([sum(map(x.count, b"#*$%&|<>")) for x in raw], np.int64)
            columns["n_marks"] = np.array([sum(map(x.count, b"!?,.;:")) for x in raw], np.int64)
            shape = [np.bincount(CLASS[np.frombuffer(x, np.uint8)], minlength=4) for x in raw]
            columns["n_upper"] = np.array([s[1] for s in shape], np.int64)
            columns["n_letters"] = np.array([s[1] + s[2] + s[3] for s in shape], np.int64)
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in [*kept, *(x.split()[0] for x in FEATURES.split(", "))]})

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *T._parse_datatype_string(FEATURES)]))


#: Of each byte: 1 an upper-case letter, 2 a lower-case one, 3 the lead byte of a character beyond ASCII, 0 else.
CLASS = np.zeros(256, np.int64)
CLASS[65:91], CLASS[97:123], CLASS[0xC3:0xF0] = 1, 2, 3


def _share(part: str, of: str) -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: Each rule's vote; the thresholds are parameters of the rules.
RULES: dict[str, Column] = {
    "length": lambda: _vote(F.col("n_words") >= 20, F.col("n_words") < 5),
    "word_length": lambda: _vote(_share("word_chars", "n_words").between(3, 10), ~_share("word_chars", "n_words").between(2, 15)),
    "symbols": lambda: _vote(_share("n_symbols", "n_words") <= 0.05, _share("n_symbols", "n_words") > 0.25),
    "marks": lambda: _vote(_share("n_marks", "n_words") <= 0.4, _share("n_marks", "n_words") > 1),
    "upper_case": lambda: _vote(_share("n_upper", "n_letters") <= 0.15, _share("n_upper", "n_letters") > 0.5),
    "letters": lambda: _vote(_share("n_letters", "word_chars") >= 0.9, _share("n_letters", "word_chars") < 0.8),
    "dup_lines": lambda: _vote(F.col("n_dup_lines") == 0, (F.col("n_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
    "repeats": lambda: _vote(F.col("n_repeat_words") * 20 <= F.col("n_words"), F.col("n_repeat_words") * 10 > F.col("n_words") * 3),
    "same_next": lambda: _vote(_share("n_same_next", "n_words") <= 0.05, _share("n_same_next", "n_words") > 0.2),
    "common_word": lambda: _vote(_share("most_common_word", "n_words") <= 0.15, (F.col("n_words") >= 20) & (_share("most_common_word", "n_words") > 0.3)),
    "line_ends": lambda: _vote(_share("n_ended_lines", "n_lines") >= 0.7, (F.col("n_lines") >= 5) & (_share("n_ended_lines", "n_lines") < 0.1)),
}
#: What is held of any rule and of the share of good documents before documents are seen: probabilities of -1, 0 and +1
#: on bad and on good documents. A rule errs seldom on good documents, and most rules find nothing wrong with a bad one.
BAD, GOOD, SHARE = (0.2, 0.2, 0.6), (0.02, 0.1, 0.88), 0.85
#: What that counts for on bad and on good documents, as a share of all documents, so that it is alike at every size.
#: It ties the classes to votes for and against, also where there are hardly any bad documents.
WEIGHTS = (0.01, 0.1)


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """The share of good documents and, for bad and good ones, each rule's probabilities of -1, 0 and +1.

    Expectation-maximisation from the tables above; votes of one rule are taken as independent of the others'
    given the class.
    """
    onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    total, weights = counts.sum(), np.array(WEIGHTS) * counts.sum()
    held = np.broadcast_to(np.array([BAD, GOOD])[:, None, :], (2, votes.shape[1], 3))
    prior, table = SHARE, held.copy()
    for _ in range(rounds):
        good = posterior(votes, prior, table)
        mass = np.stack([(1 - good) * counts, good * counts])
        new_prior = float((mass[1].sum() + SHARE * weights.sum()) / (total + weights.sum()))
        new = np.einsum("cp,prv->crv", mass, onehot) + weights[:, None, None] * held
        new /= new.sum(2, keepdims=True)
        moved = max(abs(new_prior - prior), float(np.abs(new - table).max()))
        prior, table = new_prior, new
        if moved < 1e-12:
            break
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """The probability that a document with these votes and abstentions is good."""
    onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    logs = np.einsum("prv,crv->cp", onehot, np.log(table)) + np.log([[1 - prior], [prior]])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _judged(docs: DataFrame, work: Workspace, least: float) -> DataFrame:
    """The columns of ``docs`` but its text, the counts, and the verdict."""
    spark = docs.sparkSession
    code = sum((F.pmod(vote() + 3, F.lit(3)) * 3**i for i, vote in enumerate(RULES.values())), F.lit(0)).cast("int")
    measured = work.table(measure(docs).withColumn("pattern", code), "measured")
    rows = sorted(measured.groupBy("pattern").count().collect())  # at most 3 ** len(RULES)
    patterns = np.array([r["pattern"] for r in rows], np.int64)
    votes = np.stack([(patterns // 3**i % 3 + 1) % 3 - 1 for i in range(len(RULES))], 1)
    good = posterior(votes, *fit(votes, np.array([r["count"] for r in rows], float))) if rows else np.zeros(0)
    scores = spark.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, good, strict=True)], "pattern int, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.join(F.broadcast(scores), "pattern")  # one row a pattern, so its size is bounded
        .withColumn("base_failed", failed)
        .withColumn("accepted", F.col("quality") >= least)
    )


def judge(docs: DataFrame, work: Workspace, least: float = LEAST) -> DataFrame:
    """Per document: the counts, the base rule, the posterior and whether it is kept.

    A document is kept if it passes the base rule and its posterior reaches ``least``. Null and empty texts have no
    words and fail the base rule. Very long texts are counted whole, in batches of their own. Null or repeated ids
    are judged like any others; documents with equal votes get equal posteriors. An empty table gives no rows; extra
    columns are ignored.
    """
    found = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("measured_text")), work, least)
    kept = ~F.col("base_failed") & F.col("accepted")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "quality")


def accept(docs: DataFrame, work: Workspace, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches ``least``, with their columns; the base rule isn't asked.

    A null or empty text has the votes of a text without words. Very long texts are counted whole. Repeated rows
    and null ids are judged like any others. An empty table gives no rows. Columns are carried under numbers, so
    their names can't clash.
    """
    return restored(_judged(carried(docs, measured_text=F.col("text")), work, least).where("accepted"), docs)
