"""Token ids in a binary format of 64-bit words (Simple-8b), with escapes and per-block offsets.

A word's upper four bits are a selector. Selectors 0 to 13 say how many ids its other 60 bits hold and how
wide each is; selector 14 says that the next word holds one whole id (an escape, for ids of 2**60 and more).
A word may hold fewer ids than its selector allows only at the end of a block; the block's header says how
many ids there are, so that what lies beyond them is not read.

A file is a magic number, then groups of blocks, then a footer. A group holds the documents of one batch:
a header, the document ids with their null flags and sizes, the offset of each block's first word, and the
words. Groups can be read one after the other, so neither side holds a whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

MAGIC = b"S8BTOK01"
#: Ids in a word and bits of each, for selectors 0 to 13.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 14
#: Ids in a block.
BLOCK = 1024
GROUP = struct.Struct("<qqqq")  # documents, ids, blocks, words


#: Bits of each number of up to sixteen bits.
SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    if len(ids) and ids.max() < len(SHORT):
        return SHORT[ids.astype(np.uint16)]
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    if len(ids) and ids.max() >= 1 << 53:  # beyond what a double holds exactly
        high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1].astype(np.uint8)
        bits = np.where(high > 0, high + np.uint8(32), bits)
    return bits


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks and the index of each block's first word (one more for the end).

    Blocks lie in rows that end in zeros, so that no word's ids reach into the next block. All blocks
    advance together: step j places the j-th word of every block that isn't finished.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks, row = -(-n // BLOCK), BLOCK + int(COUNTS[0])
    grid = np.zeros((blocks + 1, row), np.uint64)
    for part, rows in ((ids[: n // BLOCK * BLOCK].reshape(-1, BLOCK), slice(0, n // BLOCK)), (ids[n // BLOCK * BLOCK :], slice(n // BLOCK, blocks))):
        grid[rows, : part.shape[-1]] = part
    flat = grid.reshape(-1)
    # widest[k][i]: the bits that the k ids from i on need
    widest = {1: bit_lengths(flat)}
    for k in COUNTS[::-1][1:].tolist():
        a = max(x for x in widest if x < k and k - x in widest)
        wide = widest[a].copy()
        np.maximum(wide[: len(wide) - a], widest[k - a][a:], out=wide[: len(wide) - a])
        widest[k] = wide
    choice = np.full(len(flat), ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        choice[widest[int(COUNTS[s])] <= WIDTHS[s]] = s
    step = np.append(COUNTS, 1).astype(np.int64)
    starts = np.arange(blocks, dtype=np.int64) * row
    ends = starts + BLOCK
    ends[-1] = starts[-1] + n - (blocks - 1) * BLOCK
    steps = []
    here, until, live = starts, ends, np.arange(blocks)
    while len(here):
        placed = np.full(blocks, -1, np.int64)
        placed[live] = here
        steps.append(placed)
        here = here + step[choice[here]]
        keep = here < until
        here, until, live = here[keep], until[keep], live[keep]
    by_block = np.stack(steps, 1)  # a block's words are in order, and so are the blocks
    positions = by_block[by_block >= 0]
    chosen = choice[positions]
    size = 1 + (chosen == ESCAPE).astype(np.int64)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[to] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        first = positions[mine]
        if s == ESCAPE:
            words[to[mine] + 1] = flat[first]
            continue
        value = flat[first]
        for k in range(1, int(COUNTS[s])):
            value |= flat[first + k] << np.uint64(k * WIDTHS[s])
        words[to[mine]] |= value
    return words, np.append(to[np.searchsorted(positions, starts)], len(words)).astype(np.int64)


def decode(words: np.ndarray, first_words: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks; each selector's words are unpacked at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # an escape's second word isn't a header; such words follow each other only in pairs
    header = np.ones(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE):
        if header[i] and i + 1 < len(words):
            header[i + 1] = False
    heads = np.flatnonzero(header)
    block = np.searchsorted(first_words, heads, side="right") - 1
    counts = np.append(COUNTS, 1)[selectors[heads]]
    ends = np.cumsum(counts)
    before = np.concatenate([[0], ends])
    block_first = np.searchsorted(heads, first_words[:-1])
    at = (ends - counts) - before[block_first][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selectors[heads]):
        mine = selectors[heads] == s
        if s == ESCAPE:
            out[at[mine]] = words[heads[mine] + 1]
            continue
        word, to, limit = words[heads[mine]], at[mine], stop[mine]
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            inside = to + k < limit
            out[(to + k)[inside]] = (word[inside] >> np.uint64(k * WIDTHS[s])) & mask
    return out


class Writer:
    """Writes groups of documents to an open file."""

    def __init__(self, file: BinaryIO):
        self.file, self.documents, self.ids = file, 0, 0
        file.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        words, first_words = encode(ids)
        self.file.write(GROUP.pack(len(sizes), len(ids), len(first_words) - 1, len(words)))
        for x, kind in ((doc_ids, "<i8"), (nulls, "u1"), (sizes, "<i8"), (first_words, "<i8"), (words, "<u8")):
            self.file.write(np.ascontiguousarray(x, kind).tobytes())
        self.documents += len(sizes)
        self.ids += len(ids)

    def close(self) -> None:
        self.file.write(GROUP.pack(-1, self.ids, self.documents, 0))


def read(file: BinaryIO) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each group: document ids, null flags, sizes, ids."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    documents = total = 0

    def column(n: int, kind: str) -> np.ndarray:
        return np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)

    while True:
        m, n, blocks, n_words = GROUP.unpack(file.read(GROUP.size))
        if m < 0:
            if (n, blocks) != (total, documents):
                raise ValueError("the file is not whole")
            return
        doc_ids, nulls, sizes, first_words = column(m, "<i8"), column(m, "u1"), column(m, "<i8"), column(blocks + 1, "<i8")
        yield doc_ids, nulls.astype(bool), sizes, decode(column(n_words, "<u8").astype(np.uint64), first_words, n)
        documents, total = documents + m, total + n
