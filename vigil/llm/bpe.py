"""Byte-level BPE by a pair occurrence index, and its inverse.

The words that a partition has not met before are laid out one after the other as byte symbols. Each pair of
neighbours is mapped to all its positions. Ranks that have positions wait in a heap; the lowest is applied to
all its positions at once, and the lists of the pairs that it breaks and makes are updated.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept_in_worker, small_batches, text_batches
from .tokenize import cuts_before_white_space

#: The code points of Unicode's White_Space property. Chunks begin with white space or at the text's start.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

#: Fixed value: the pattern of byte-level BPE's pre-tokeniser.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A chunk of letters that the pattern takes as one word, and marks after it that it takes as another.
LETTERS = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: A worker forgets its words or chunks beyond this many.
MOST_CACHED, MOST_CHARACTERS = 400_000, 12_000_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexBPE:
    """Encoding and decoding with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if not cuts_before_white_space(spec):
            raise ValueError("only byte-level files without a normaliser are supported")
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [regex.escape(x) for x in sorted(self.special, key=len, reverse=True)]
        self.split_special = regex.compile(f"({'|'.join(names)})") if names else None
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for name, i in vocabulary.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.byte_id = np.array([vocabulary[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        self.size, self.rank, self.made = size, {}, []
        made_at = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, new = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            # a pair may only join what lower ranks make, else ranks can't be applied to all words in one order
            if max(made_at.get(pair[0], -1), made_at.get(pair[1], -1)) >= r or new in made_at:
                raise ValueError("the merges are not in an order of making")
            made_at[new] = r
            self.rank[pair[0] * size + pair[1]] = r
            self.made.append(new)
        keys = np.array(sorted(self.rank), np.int64)
        self.keys, self.ranks = keys, np.array([self.rank[k] for k in keys.tolist()], np.int64)
        self.decimals = [b"%d," % i for i in range(size)]
        # of a word or chunk: the number of its ids, the ids in decimals with a comma behind each, and their bytes
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}
        self.characters = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of distinct words."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbol)
        word = np.repeat(np.arange(len(raw)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last, first = np.cumsum(sizes) - 1, np.cumsum(sizes) - sizes
        filled = sizes > 0
        after[last[filled]], before[first[filled]] = -1, -1
        # the index: rank -> arrays of positions at which its pair begins
        where: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(positions: np.ndarray) -> None:
            positions = positions[(positions >= 0)]
            positions = positions[after[positions] >= 0]
            ranks = self._ranks(symbol[positions], symbol[after[positions]])
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r not in where:
                    where[r] = []
                    heapq.heappush(waiting, r)
                where[r].append(part)

        enter(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(where.pop(r)))
            # entries that an earlier merge has broken
            at = at[symbol[at] >= 0]
            at = at[after[at] >= 0]
            at = at[self._ranks(symbol[at], symbol[after[at]]) == r]
            if not len(at):
                continue
            # of pairs that overlap, as in a run of one symbol, every second counts, from the left
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
            gone = after[at]
            symbol[at], symbol[gone] = self.made[r], -1
            following = after[gone]
            after[at] = following
            before[following[following >= 0]] = at[following >= 0]
            # only a merged symbol and its left neighbour begin new pairs
            enter(np.unique(np.concatenate([at, before[at]])))
        alive = symbol >= 0
        counts = np.bincount(word[alive], minlength=len(raw))
        flat, stops = symbol[alive].tolist(), np.cumsum(counts).tolist()
        return [flat[b - c : b] for b, c in zip(stops, counts.tolist(), strict=True)]

    def _parts(self, chunk: str) -> list[str | int]:
        """The words of a chunk, and the ids of its special tokens."""
        if plain := LETTERS.fullmatch(chunk):  # the commonest case: letters, then marks
            return [x for x in plain.groups() if x]
        if not any(x in chunk for x in self.special):
            return WORDS.findall(chunk)
        out: list[str | int] = []
        for piece in self.split_special.split(chunk):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += WORDS.findall(piece)
        return out

    def _entry(self, ids: Sequence[int]) -> tuple[int, bytes, bytes]:
        return len(ids), b"".join([self.decimals[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def learn(self, chunks: Sequence[str]) -> None:
        """Enter chunks that weren't met before."""
        if len(self.chunks) > MOST_CACHED or self.characters > MOST_CHARACTERS:
            self.chunks.clear()
            self.characters = 0
        if len(self.words) > MOST_CACHED:
            self.words.clear()
        cut = [self._parts(chunk) for chunk in chunks]
        new = list({x for parts in cut for x in parts if isinstance(x, str)}.difference(self.words))
        if new:
            self.words.update(zip(new, map(self._entry, self.encode_words(new)), strict=True))
        for chunk, parts in zip(chunks, cut, strict=True):
            if len(parts) == 1 and isinstance(parts[0], str):
                self.chunks[chunk] = self.words[parts[0]]
                continue
            found = [self._entry([x]) if isinstance(x, int) else self.words[x] for x in parts]
            counts, decimals, raw = zip(*found, strict=True)
            self.chunks[chunk] = (sum(counts), b"".join(decimals), b"".join(raw))
        self.characters += sum(map(len, chunks))

    def coded(self, texts: Sequence[str | None]) -> list[list[tuple[int, bytes, bytes]]]:
        """The chunks of whole texts, coded; None counts as empty."""
        cut = [CHUNKS.findall(x or "") for x in texts]
        need = set().union(*cut)
        new = need.difference(self.chunks)
        if new:
            before = len(self.chunks)
            self.learn(list(new))
            if len(self.chunks) < before:  # all were forgotten
                self.learn(list(need.difference(self.chunks)))
        return [[self.chunks[c] for c in x] for x in cut]

    def encode(self, texts: Sequence[str | None]) -> list[list[int]]:
        """Ids of whole texts; None counts as empty."""
        return [[int(i) for x in chunks for i in x[1].split(b",")[:-1]] for chunks in self.coded(texts)]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def coder(path: str) -> PairIndexBPE:
    """The worker's coder of a file."""
    return kept_in_worker(("bpe", path), lambda: PairIndexBPE(path))


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each whole text's ids and of the text that they decode to.

    A null or empty text has no ids. A very long text is encoded whole, in a batch of its own. Of equal ranks the pair that
    stands first is merged first. Null or repeated ids stay as they are; an empty table gives no rows; extra columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for rows in text_batches(batches, "text", 6 << 20):
            sizes, digests, decoded = [], [], []
            gc.disable()  # what is kept holds no cycles, and the collector would walk it again and again
            try:
                for chunks in bpe.coded(rows.column("text").to_pylist()):
                    counts, decimals, raw = zip(*chunks, strict=True) if chunks else ((), (), ())
                    sizes.append(sum(counts))
                    digests.append(hashlib.sha256(b"".join(decimals)[:-1]).hexdigest())
                    # chunks end between characters, so the bytes may be decoded together
                    decoded.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
            finally:
                gc.enable()
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": digests, "decoded_sha256": decoded})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESULT)
