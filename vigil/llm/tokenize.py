"""Token ids of a byte-level BPE file, as the tokenizers library gives them, with a cache of text pieces.

The pre-tokeniser of such a file splits a text into runs of letters, of digits and of other marks, each with the
white space before it. A text may be cut wherever it surely splits: before white space, and between runs of two
kinds whose characters are plain. The ids of the pieces, one after the other, are the ids of the text. Pieces
repeat; each worker encodes a new one once. A file with another pre-tokeniser or a normaliser is applied to whole
texts instead.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from .shared import SPACE, kept_in_worker, text_bytes

#: A worker forgets its pieces beyond this many pieces or bytes.
MOST_PIECES, MOST_BYTES = 800_000, 16_000_000
#: New pieces that are encoded as one text.
TOGETHER = 64
#: What to do between two bytes: cut, or look at the whole character before (its last byte tells too little).
CUT, LOOK = 1, 2


def _table(fine: bool) -> np.ndarray:
    """For each pair of bytes, first * 256 + second: 0, CUT or LOOK. Without ``fine`` only white space is cut off."""
    byte = np.arange(256)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    letter = ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
    digit = (byte >= 48) & (byte <= 57)
    high = byte >= 128
    mark = ~(space | letter | digit | high)
    out = np.zeros((256, 256), np.uint8)
    out[np.ix_(~space & ~high, space)] = CUT
    out[np.ix_(high, space)] = LOOK
    if fine:
        for kind in (letter, digit):
            out[np.ix_(kind, mark | (letter | digit) & ~kind)] = CUT
        # an apostrophe may belong with the letters after it
        out[np.ix_(mark & (byte != 39), letter | digit)] = CUT
        out[np.ix_(high, mark)] = LOOK
    return out.reshape(-1)


COARSE, FINE = _table(False), _table(True)


def _cut_after_high(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether to cut after the characters that end at ``at``, all beyond ASCII: before white space unless they are
    white space too, before a mark if they are surely letters (U+00C0 to U+017F but two signs)."""
    last, before, lead = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    space = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    space |= (lead == 0xE1) & (before == 0x9A) & (last == 0x80)
    space |= (lead == 0xE2) & (before == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    space |= (lead == 0xE2) & (before == 0x81) & (last == 0x9F)
    space |= (lead == 0xE3) & (before == 0x80) & (last == 0x80)
    letter = ((before == 0xC3) & (last != 0x97) & (last != 0xB7)) | (before == 0xC4) | (before == 0xC5)
    return np.where(SPACE[data[at + 1]], ~space, letter)


def cut(data: np.ndarray, texts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts that start at ``texts`` (one more for the end); the end is the last."""
    if not len(data):
        return np.zeros(1, np.int32)
    pair = data[:-1].astype(np.uint16)
    pair <<= 8
    pair |= data[1:]
    what = np.empty(len(data) + 1, np.uint8)
    np.take(table, pair, out=what[1:-1])
    look = np.flatnonzero(what[1:-1] == LOOK)
    what[look + 1] = _cut_after_high(data, look)
    what[texts] = CUT
    what[[0, -1]] = CUT
    return np.flatnonzero(what).astype(np.int32)


def cuts_before_white_space(spec: dict) -> bool:
    """Whether the file's texts may be cut before white space."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None and plain


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.cached = cuts_before_white_space(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        if self.cached:  # a byte-level token has a character for each byte
            names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
            special = {t["id"] for t in spec["added_tokens"]}
            self.width = np.zeros(max(names.values()) + 1, np.int64)
            for name, i in names.items():
                self.width[i] = len(name.encode()) if i in special else len(name)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.bytes = 0
        self.starts = np.zeros(1, np.int64)  # of each piece's ids; one more for the end
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces. Those that lead from white space to something else are joined to longer texts, as each
        is a piece of its own there too; the tokens' bytes tell where one ends."""
        led = [SPACE[x[0]] and not SPACE[x[-1]] and (x[-1] < 128 or not x.decode()[-1].isspace()) for x in pieces]
        joined, single = [x for x, y in zip(pieces, led, strict=True) if y], [x for x, y in zip(pieces, led, strict=True) if not y]
        pieces = joined + single
        texts = [b"".join(joined[k : k + TOGETHER]).decode() for k in range(0, len(joined), TOGETHER)] + [x.decode() for x in single]
        ids = np.concatenate([np.array(x, np.uint32) for x in self._encode(texts)])
        ends = np.cumsum(self.width[ids])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.searchsorted(ends, np.cumsum(sizes)) + 1
        n = len(self.codes)
        self.bytes += int(sizes.sum())
        self.codes.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + stops])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text. None counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.cached:
            found = self._encode([x or "" for x in texts.to_pylist()])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes
        if len(self.codes) > MOST_PIECES or self.bytes > MOST_BYTES:
            self._forget()
        bounds, data = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # a special token in a text must stay whole
        special = any(memoryview(data).tobytes().find(x) >= 0 for x in self.added)
        starts = cut(data, bounds, COARSE if special else FINE)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if new := [x for x in names if x not in self.codes]:
            self._learn(new)
        of_name = np.fromiter(map(self.codes.__getitem__, names), np.int64, len(names))
        first, length = self.starts[of_name], self.starts[of_name + 1] - self.starts[of_name]
        which = pieces.indices.to_numpy()
        lengths = length[which]
        ends = np.cumsum(lengths)
        # the n-th id of a piece lies n places after its first one
        at = np.repeat(first[which] - (ends - lengths), lengths)
        at += np.arange(len(at))
        sizes = np.diff(np.append(0, ends)[np.searchsorted(starts, bounds)])
        return self.ids[at], sizes


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    return kept_in_worker(("encoder", path), lambda: Encoder(path))


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to each text's ids."""
    stops = np.cumsum(sizes)
    return np.insert(ids, stops, np.uint32(end)), sizes + 1
