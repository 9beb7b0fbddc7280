"""Licence scans: a trained paragraph classifier with a calibrated class for unknown licences; templates confirm.

A text's lines with words make blocks, which end at lines without words. Features of a paragraph are its word n-grams
of two and three words, those that occur in the training texts, over the root of its number of words and a few. Logistic regression over the families,
a class for licences of no family and one for no licence is trained on licence texts whole and wrapped at many
widths, on variants of them with words left out, changed or added, and on plain sentences. Held-out variants
calibrate it: a temperature for its probabilities, and the least probability at which a family is named.

Each line is scored by itself. Neighbouring lines of a block that are more likely of a licence than not (or lie between
two such) make one paragraph, which is scored as a whole, but lines that hold most of a template are paragraphs of their own; so a
notice is found on a line of its own and wrapped over several. A paragraph
is named by its likeliest family if that is likely enough, else its licence is unknown. Templates confirm a name, and one that they don't must be likelier: most
of a template's trigrams stand in the paragraph, or most of the paragraph's in the family's templates.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import OTHERS, PLAIN, TEMPLATES
from .shared import SPACE, nothing_kept, small_batches, text_batches, text_bytes

#: Variants of each training text, and widths in words at which it is wrapped.
VARIANTS, WRAPS = 12, (6, 9, 12, 16)
EPOCHS, RATE, DECAY = 150, 3.0, 2e-5
#: Share of trigrams that confirms a family.
CONFIRM = 0.6
#: Share of calibration variants of known families that must stay above the least probability.
KEEP = 0.97
#: Least probability of a family that templates don't confirm.
SURE = 0.95
#: A line between two licence lines belongs to them unless it is of no licence with this probability.
BRIDGE = 0.95
#: A worker forgets its words beyond this many.
MOST_WORDS = 300_000
RESULT = "doc_id long, n_paragraphs long, n_licences long, n_confirmed long, n_unknown long, families string"

#: Words that every paragraph is longer by, so that two words alone tell little.
SPARE = 4
#: A word of no training text.
STRANGE = b"\xff"
#: Bytes that words are made of: ASCII letters and digits, and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(text: str) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return np.where(WORD[raw], raw, 32).astype(np.uint8).tobytes().split()


class Model:
    """The classifier, its calibration and the templates' trigrams."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.families = sorted(TEMPLATES)
        self.unknown, self.none = len(self.families), len(self.families) + 1
        known = [(words_of(t), i) for i, f in enumerate(self.families) for t in TEMPLATES[f]]
        other = [(words_of(t), self.unknown) for t in OTHERS]
        plain = [(words_of(t), self.none) for t in PLAIN]
        learn, hold = known + other[::2] + plain[::2], known + other[1::2] + plain[1::2]
        names = sorted({w for words, _ in known + other[::2] + plain[::2] for w in words})
        self.words = {w: i for i, w in enumerate(names)}
        filler = sorted({w for words, _ in plain[::2] for w in words})
        common = [w for words, _ in plain[::2] for w in words if w in {x for y, c in known for x in y}]

        def variant(words: list[bytes]) -> list[bytes]:
            strange = [STRANGE, *filler]
            out = [strange[rng.integers(len(strange)) * (rng.random() < 0.5)] if rng.random() < 0.04 else w for w in words if rng.random() > 0.05]
            before, after = ([filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 3))] for _ in range(2))
            return before + out + after

        def pieces(words: list[bytes], width: int) -> list[list[bytes]]:
            """The lines of a text that is wrapped at so many words, those of three words or more."""
            first = int(rng.integers(1, width + 1))
            cuts = [0, *range(first, len(words), width), len(words)]
            return [x for a, b in itertools.pairwise(cuts) if len(x := words[a:b]) >= 3]

        def samples(source: list[tuple[list[bytes], int]], n: int) -> list[tuple[list[bytes], int]]:
            out = list(source)
            for words, c in source:
                out += [(variant(words), c) for _ in range(n)]
                # two words of a licence are too few to tell it
                at = rng.integers(0, max(1, len(words) - 1))
                out += [(words[at : at + 2], self.none)] if len(words) > 12 else []
                for width in WRAPS:
                    out += [(x, c) for x in (pieces(words, width) if len(words) > width + 3 else [])]
            # words in no order say nothing, however many; nor do a few words again and again, nor unknown ones
            for _ in range(8 * n):
                pool = names if rng.random() < 0.5 else common
                out.append(([pool[i] for i in rng.integers(0, len(pool), int(2 ** rng.uniform(0, 8)))], self.none))
                out.append(([pool[i] for i in rng.integers(0, len(pool), rng.integers(2, 9))] * int(2 ** rng.uniform(1, 5)), self.none))
                rare = rng.uniform(0.3, 1)
                out.append(([STRANGE if rng.random() < rare else pool[rng.integers(len(pool))] for _ in range(int(2 ** rng.uniform(1, 8)))], self.none))
            return out

        train = samples(learn, VARIANTS)
        ids = [self.numbers(words) for words, _ in train]
        self._index(ids)
        self.weights, self.bias = self._fit(ids, np.array([c for _, c in train]))
        held = samples(hold, VARIANTS // 2)
        y = np.array([c for _, c in held])
        raw = self.raw([self.numbers(words) for words, _ in held])
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
        chance = softmax(raw / self.temperature)
        named = chance[:, : self.unknown]
        right = (y < self.unknown) & (named.argmax(1) == y)
        # an unknown licence is named by mistake above this, a known one is lost below that
        strange = named[y == self.unknown].max(1)
        self.least = float(min(np.quantile(named.max(1)[right], 1 - KEEP), max(0.5, np.quantile(strange, 0.9))))
        self.templates = [[t for text in TEMPLATES[f] if len(t := self._trigrams(self.numbers(words_of(text))))] for f in self.families]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for those of no training text."""
        return np.array([self.words.get(w, -1) for w in words], np.int64)

    def _keys(self, ids: np.ndarray) -> list[np.ndarray]:
        """For n = 2, 3: a key of the n-gram that starts at each place, -1 where a word of it is unknown."""
        base, out = len(self.words) + 1, [ids]
        for n in (2, 3):
            key = np.full(len(ids), -1, np.int64)
            if len(ids) >= n:
                longer = out[-1][: len(ids) - n + 1] * base + ids[n - 1 :]
                key[: len(longer)] = np.where((out[-1][: len(longer)] >= 0) & (ids[n - 1 :] >= 0), longer, -1)
            out.append(key)
        return out[1:]

    def _index(self, texts: list[np.ndarray]) -> None:
        keys = [self._keys(x) for x in texts]
        # n-grams of two texts or more; the others tell one text from all, not a family
        self.known = []
        for n in range(2):
            found, times = np.unique(np.concatenate([np.unique(k[n][k[n] >= 0]) for k in keys]), return_counts=True)
            self.known.append(found[times >= 2])
        self.offsets = np.cumsum([0, *map(len, self.known)])

    def features(self, ids: np.ndarray) -> list[np.ndarray]:
        """For n = 2, 3: the feature of the n-gram that starts at each place, -1 for none."""
        out = []
        for n, key in enumerate(self._keys(ids)):
            at = np.minimum(np.searchsorted(self.known[n], key), len(self.known[n]) - 1)
            out.append(np.where(self.known[n][at] == key, at + self.offsets[n], -1))
        return out

    def _rows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features of all texts, their values, and where each text's start (one more for the end)."""
        found = [np.concatenate(self.features(x)) if len(x) else np.zeros(0, np.int64) for x in texts]
        found = [x[x >= 0] for x in found]
        sizes = np.array([len(x) for x in found])
        words = SPARE + np.array([len(x) for x in texts])
        return np.concatenate(found), np.repeat(1 / np.sqrt(words), sizes), np.concatenate([[0], np.cumsum(sizes)])

    def _fit(self, texts: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Full-batch gradient descent with momentum; classes weigh alike."""
        column, value, first = self._rows(texts)
        classes = self.none + 1
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        share = 1 / np.bincount(y, minlength=classes)[y] / classes
        order = np.argsort(column, kind="stable")
        column, value, owner = column[order], value[order], owner[order]
        starts = np.searchsorted(column, np.arange(self.offsets[-1]))
        by_text = np.argsort(owner, kind="stable")
        filled = np.diff(first) > 0
        w, b, speed = np.zeros((self.offsets[-1], classes)), np.zeros(classes), 0.0
        for _ in range(EPOCHS):
            raw = np.tile(b, (len(texts), 1))
            raw[filled] += np.add.reduceat((w[column] * value[:, None])[by_text], first[:-1][filled])
            wrong = softmax(raw)
            wrong[np.arange(len(y)), y] -= 1
            wrong *= share[:, None]
            slope = np.add.reduceat(wrong[owner] * value[:, None], starts) + DECAY * w
            speed = 0.9 * speed + slope
            w -= RATE * speed
            b -= RATE * wrong.sum(0)
        return w, b

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Each class's score of each text."""
        column, value, first = self._rows(texts)
        out = np.tile(self.bias, (len(texts), 1))
        filled = np.diff(first) > 0
        if filled.any():
            out[filled] += np.add.reduceat(self.weights[column] * value[:, None], first[:-1][filled])
        return out

    def chances(self, raw: np.ndarray) -> np.ndarray:
        return softmax(raw / self.temperature)

    def plain_chances(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of lines that start at ``first`` (one more for the end) among the words: the probability that each is of no
        licence. A line without features is as likely as the bias says."""
        out = np.full(len(first) - 1, self.chances(self.bias[None])[0, self.none])
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        sums, some = np.zeros((len(out), self.none + 1)), np.zeros(len(out), bool)
        for n, found in enumerate(self.features(ids), 1):
            # an n-gram must end in the line that it starts in
            ends = np.minimum(np.arange(len(ids)) + n, len(ids) - 1)
            at = np.flatnonzero((found >= 0) & (owner[ends] == owner) & (np.arange(len(ids)) + n < len(ids)))
            if not len(at):
                continue
            here, lines = found[at], owner[at]
            cuts = np.flatnonzero(np.append(True, lines[1:] != lines[:-1]))
            sums[lines[cuts]] += np.add.reduceat(self.weights[here], cuts)
            some[lines[cuts]] = True
        some = np.flatnonzero(some)
        chance = self.chances(sums[some] / np.sqrt(SPARE + np.diff(first)[some])[:, None] + self.bias)
        out[some] = chance[:, self.none]
        return out

    def _trigrams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of a text's trigrams; of its pairs if it has two words."""
        key = self._keys(ids)[len(ids) > 2]
        return np.unique(key[key >= 0])

    def judge(self, ids: np.ndarray) -> tuple[str, bool, bool]:
        """A paragraph's family ('' for no licence, 'unknown' for none of the families), whether templates confirm it,
        and whether it holds most of a template."""
        chance = self.chances(self.raw([ids]))[0]
        if chance[self.none] >= 0.5:
            return "", False, False
        best = int(chance[: self.unknown].argmax())
        mine = self._trigrams(ids)
        whole = any(len(np.intersect1d(t, mine, assume_unique=True)) >= CONFIRM * len(t) for t in self.templates[best])
        confirmed = whole or self._inside(ids, best)
        if chance[best] < (self.least if confirmed else SURE):
            return "unknown", False, False
        return self.families[best], confirmed, whole

    def _inside(self, ids: np.ndarray, family: int) -> bool:
        """Whether most of a paragraph's trigrams stand in a family's templates."""
        mine, theirs = self._trigrams(ids), np.unique(np.concatenate(self.templates[family]))
        return len(mine) > 0 and len(np.intersect1d(theirs, mine, assume_unique=True)) >= CONFIRM * len(mine)

    def paragraphs(self, lines: list[np.ndarray], judge: Callable[[np.ndarray], tuple[str, bool, bool]]) -> list[tuple[str, bool]]:
        """The families that neighbouring licence lines name, and whether each is confirmed.

        They are one paragraph, but for lines that hold a notice of their own. Neighbours of one family are joined, and
        what goes on with a family's templates belongs to it.
        """
        parts: list[list[np.ndarray]] = []
        after_own = True
        for line in lines:
            own = judge(line)[2]
            if own or after_own:
                parts.append([])
            parts[-1].append(line)
            after_own = own
        out: list[tuple[str, bool]] = []
        for part in parts:
            family, confirmed, _ = judge(np.concatenate(part))
            last = out[-1][0] if out else ""
            if last and (last == family or family == "unknown" and self._inside(np.concatenate(part), self.families.index(last))):
                out[-1] = (last, out[-1][1] or confirmed)
            elif family:
                out.append((family, confirmed))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@cache
def model() -> Model:
    """The model, trained once by the driver; it has no input but fixed texts."""
    return Model()


class Lines:
    """The words of a batch of texts, and the lines and blocks that they stand in."""

    def __init__(self, texts: pa.Array, numbers: dict[bytes, int], of: dict[bytes, int]):
        bounds, data = text_bytes(texts)
        word = WORD[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        begin[inner] = word[inner]
        at = np.flatnonzero(begin)
        ends = np.cumsum(word, dtype=np.int32)
        starts = np.append(ends[at] - 1, ends[-1] if len(ends) else 0).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(LOWER[data[word]])]).dictionary_encode()
        names = found.dictionary.to_pylist()
        if len(numbers) > MOST_WORDS:
            numbers.clear()
        numbers.update((w, of.get(w, -1)) for w in names if w not in numbers)
        self.ids = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        # physical lines end at line feeds and texts' ends; those with a word (of any characters) count
        breaks = np.flatnonzero(data == 10)
        edges = np.unique(np.concatenate([breaks + 1, bounds]))
        edges = edges[edges <= len(data)]
        solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
        full = np.flatnonzero(solid[edges[1:]] > solid[edges[:-1]]) if len(edges) > 1 else np.zeros(0, np.int64)
        self.text = np.searchsorted(bounds, edges[full], side="right") - 1
        # a block goes on where the line before was full too and of the same text
        self.new_block = np.ones(len(full), bool)
        self.new_block[1:] = (full[1:] != full[:-1] + 1) | (self.text[1:] != self.text[:-1])
        self.first = np.append(np.searchsorted(at, edges[full]), len(at))
        self.n_texts = len(texts)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs (lines with words), notices of a named family, those that templates confirm, other
    licences, and the families' names in order.

    A notice that is wrapped over lines counts once. Null and empty texts have no paragraphs. A very long text is
    scanned whole, in a batch of its own. Null or repeated ids are scanned like any others; of equally likely families
    the first by name counts. An empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        judge, numbers, seen = shared.value, {}, {}

        def once(ids: np.ndarray) -> tuple[str, bool, bool]:
            key = ids.tobytes()
            if key not in seen:
                if len(seen) > 20_000:
                    seen.clear()
                seen[key] = judge.judge(ids)
            return seen[key]

        for rows in text_batches(batches, "text", 1 << 20):
            found = Lines(rows.column("text"), numbers, judge.words)
            n, out = found.n_texts, np.zeros((3, found.n_texts), np.int64)
            families: list[set[str]] = [set() for _ in range(n)]
            for start, stop in licence_runs(judge.plain_chances(found.ids, found.first), found.new_block):
                lines = [found.ids[found.first[i] : found.first[i + 1]] for i in range(start, stop)]
                text = found.text[start]
                for family, confirmed in judge.paragraphs(lines, once):
                    if family == "unknown":
                        out[2, text] += 1
                        continue
                    families[text].add(family)
                    out[0, text] += 1
                    out[1, text] += confirmed
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_paragraphs": np.bincount(found.text, minlength=n), "n_licences": out[0], "n_confirmed": out[1], "n_unknown": out[2], "families": [",".join(sorted(x)) for x in families]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def licence_runs(plain: np.ndarray, new_block: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, after the last) of neighbouring lines of one block that are more likely of a licence than not, and of
    single lines between such that may be."""
    hit = plain < 0.5
    hit[1:-1] |= hit[:-2] & hit[2:] & (plain[1:-1] < BRIDGE) & ~new_block[1:-1] & ~new_block[2:]
    at = np.flatnonzero(hit)
    if not len(at):
        return
    begin = np.append(True, (at[1:] != at[:-1] + 1) | new_block[at[1:]])
    starts = at[begin]
    stops = np.append(at[np.flatnonzero(begin)[1:] - 1], at[-1]) + 1
    yield from zip(starts.tolist(), stops.tolist(), strict=True)
