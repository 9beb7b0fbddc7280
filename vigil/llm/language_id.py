"""Languages of documents by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows. One network reads each window forwards, another backwards; at every position both
states together give probabilities of the languages, and a document's probabilities are the means over its positions. The
networks are trained in numpy by backpropagation through time on windows of a bounded number of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_classifier import held_out
from .shared import kept_in_worker, nothing_kept, text_batches, text_bytes

#: Labelled documents that are read for training, at most of each language, and windows of each. Languages, at most (the
#: most frequent ones).
TRAIN_DOCS, TRAIN_WINDOWS, LANGUAGES = 400, 4, 64
#: Bytes of a window, and of a training window; windows that are read together.
WINDOW, TRAIN_LENGTH, LANES = 128, 64, 1024
#: States of each network.
STATES = 8
EPOCHS, BATCH, RATE = 4, 128, 0.02
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


def new_weights(rng: np.random.Generator, n_out: int, states: int = STATES) -> Weights:
    """Of both networks, ``f`` forwards and ``b`` backwards: inputs by byte, recurrences and offsets of the update gate, the
    reset gate and the candidate; and the output layer."""
    scale = 1 / np.sqrt(states)
    made = {"out": rng.normal(0, scale, (2 * states, n_out)), "out0": np.zeros(n_out)}
    for d in "fb":
        made |= {f"in_{d}": rng.normal(0, 0.5, (256, 3 * states)), f"rec_{d}": rng.normal(0, scale, (states, 3 * states)), f"off_{d}": np.zeros(states)}
    return {k: v.astype(np.float32) for k, v in made.items()}


def _gates(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def states_of(w: Weights, d: str, codes: np.ndarray, live: np.ndarray | None, trace: list | None = None) -> np.ndarray:
    """The states of network ``d`` after each position of ``codes`` (position, window); where ``live`` is 0 they stay 0."""
    inputs, rec, off = w[f"in_{d}"], w[f"rec_{d}"], w[f"off_{d}"]
    n = rec.shape[0]
    h = np.zeros((codes.shape[1], n), np.float32)
    out = np.empty((*codes.shape, n), np.float32)
    for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
        x, u = inputs[codes[t]], h @ rec
        gates = _gates(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        inner = u[:, 2 * n :] + off
        new = np.tanh(x[:, 2 * n :] + r * inner)
        before, h = h, new + z * (h - new)
        if live is not None:
            h *= live[t][:, None]
        if trace is not None:
            trace.append((t, before, z, r, inner, new))
        out[t] = h
    return out


def position_odds(w: Weights, codes: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """Log-odds of the languages at each position, up to a constant."""
    both = np.concatenate([states_of(w, "f", codes, None), states_of(w, "b", codes, live)], 2)
    return both @ w["out"] + w["out0"]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def slopes(w: Weights, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, Weights]:
    """The mean cross-entropy of all positions with their windows' labels, and its slope by every weight."""
    n = w["rec_f"].shape[0]
    traces: dict[str, list] = {"f": [], "b": []}
    states = {d: states_of(w, d, codes, None, traces[d]) for d in "fb"}
    both = np.concatenate([states["f"], states["b"]], 2)
    chance = _softmax(both @ w["out"] + w["out0"])
    size = np.float32(codes.size)
    lanes = np.arange(codes.shape[1])
    loss = float(-(np.log(chance[:, lanes, labels] + 1e-12) * weight).sum() / size)
    chance[:, lanes, labels] -= 1
    chance *= (weight / size)[:, None]
    flat = chance.reshape(-1, chance.shape[2])
    made = {"out": both.reshape(-1, 2 * n).T @ flat, "out0": flat.sum(0)}
    back = chance @ w["out"].T
    for k, d in enumerate("fb"):
        rec, inputs = w[f"rec_{d}"], np.zeros_like(w[f"in_{d}"])
        by_rec, by_off = np.zeros_like(rec), np.zeros(n, np.float32)
        carry = np.zeros((codes.shape[1], n), np.float32)
        for t, before, z, r, inner, new in reversed(traces[d]):
            dh = back[t, :, k * n : (k + 1) * n] + carry
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r], 1)
            by_rec += before.T @ d_u
            by_off += d_u[:, 2 * n :].sum(0)
            np.add.at(inputs, codes[t], np.concatenate([d_z, d_r, d_new], 1))
            carry = dh * z + d_u @ rec.T
        made |= {f"in_{d}": inputs, f"rec_{d}": by_rec, f"off_{d}": by_off}
    return loss, made


def train(codes: np.ndarray, labels: np.ndarray, n_out: int, seed: int = 5) -> Weights:
    """Weights from windows (window, position) and their labels, by Adam; languages weigh alike."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng, n_out)
    counts = np.bincount(labels, minlength=n_out)
    weight = (len(labels) / (n_out * np.maximum(1, counts)))[labels].astype(np.float32)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    total = EPOCHS * max(1, len(labels) // BATCH)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            _, made = slopes(w, codes[some].T, labels[some], weight[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in made.values()))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k, g in made.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))  # long products may explode
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def fit(docs: DataFrame) -> tuple[list[str], Weights | None]:
    """Languages and weights, from documents outside the held-out fold that have a language.

    At most ``TRAIN_DOCS`` documents of each language are used, those of the smallest hash of id and text, and windows of
    them at places that the hash gives; all languages count alike. Rows without text, id or language teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = sorted(r.lang for r in counts)
    if not langs:
        return [], None
    # the share of each language's documents that leaves about twice as many as are used
    share = {r.lang: min(1.0, 2 * TRAIN_DOCS / r["count"]) for r in counts}
    shares = docs.sparkSession.createDataFrame(sorted(share.items()), "lang string, share double")
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    rows = known.select("lang", "doc_id", "text").join(F.broadcast(shares), "lang")  # at most LANGUAGES rows
    chosen = rows.withColumn("draw", draw).where((F.shiftrightunsigned("draw", 11) / float(1 << 53)) < F.col("share")).select("lang", "draw", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            found: dict[str, list] = {"lang": [], "draw": [], "windows": []}
            for lang, draw, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "draw", "text")), strict=True):
                raw = text.encode()
                rng = np.random.default_rng(draw & ((1 << 63) - 1))
                starts = rng.integers(0, max(1, len(raw) - TRAIN_LENGTH + 1), TRAIN_WINDOWS)
                whole = [raw[s : s + TRAIN_LENGTH] for s in dict.fromkeys(starts.tolist()) if len(raw) >= TRAIN_LENGTH]
                for name, value in (("lang", lang), ("draw", draw), ("windows", whole)):
                    found[name].append(value)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(found["lang"], pa.string()), "draw": pa.array(found["draw"], pa.int64()), "windows": pa.array(found["windows"], pa.list_(pa.binary()))})

    given = sorted(((r.lang, r.draw, r.windows) for r in chosen.mapInArrow(cut, "lang string, draw long, windows array<binary>").where(F.size("windows") > 0).toLocalIterator()), key=lambda r: (r[0], r[1]))
    used: dict[str, int] = {}
    windows, labels = [], []
    for lang, _, own in given:
        used[lang] = used.get(lang, 0) + 1
        if used[lang] <= TRAIN_DOCS:
            windows += [np.frombuffer(x, np.uint8) for x in own]
            labels += [langs.index(lang)] * len(own)
    del given
    if not windows:
        return langs, None
    made = train(np.stack(windows), np.array(labels, np.int64), len(langs))
    del windows
    nothing_kept()
    return langs, made


def _flat(w: Weights) -> Weights:
    """Weights for ``pooled``: a row for each unit, so that all windows' numbers of a unit lie together, and those of gates
    halved, as the logistic function is a hyperbolic tangent of the half."""
    n = w["rec_f"].shape[0]
    half = np.repeat(np.array([0.5, 0.5, 1], np.float32), n)[:, None]
    made = {f"{k}_{d}": np.ascontiguousarray(w[f"{k}_{d}"].T * half) for d in "fb" for k in ("in", "rec")}
    made |= {f"off_{d}": w[f"off_{d}"][:, None] for d in "fb"}
    return made | {"out_f": np.ascontiguousarray(w["out"][:n].T), "out_b": np.ascontiguousarray(w["out"][n:].T), "out0": w["out0"][:, None]}


def pooled(w: Weights, codes: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """The sums, over all positions, of the probabilities of ``position_odds``: (language, window). ``w`` as ``_flat`` gives it."""
    n = w["off_f"].shape[0]

    def step(d: str, t: int, h: np.ndarray) -> np.ndarray:
        x, u = np.take(w[f"in_{d}"], codes[t], axis=1), w[f"rec_{d}"] @ h
        gates, new, inner = x[: 2 * n], x[2 * n :], u[2 * n :]
        gates += u[: 2 * n]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        inner += w[f"off_{d}"]
        inner *= gates[n:]
        new += inner
        np.tanh(new, out=new)
        h = h - new
        h *= gates[:n]
        h += new
        return h

    states = np.empty((len(codes), n, codes.shape[1]), np.float32)
    h = np.zeros((n, codes.shape[1]), np.float32)
    for t in range(len(codes)):
        states[t] = h = step("f", t, h)
    total = np.zeros((w["out0"].shape[0], codes.shape[1]), np.float32)
    h = np.zeros((n, codes.shape[1]), np.float32)
    for t in range(len(codes) - 1, -1, -1):
        h = step("b", t, h)
        if live is not None:
            h *= live[t]
        chance = w["out_f"] @ states[t]
        chance += w["out_b"] @ h
        chance += w["out0"]
        chance -= chance.max(0)
        np.exp(chance, out=chance)
        # past a window's end all chances are 0
        chance /= chance.sum(0) if live is None else np.where(live[t] > 0, chance.sum(0), np.inf)
        total += chance
    return total


def chances(w: Weights, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean probabilities over all its bytes, and the number of bytes."""
    bounds, data = text_bytes(texts)
    sizes = np.diff(bounds).astype(np.int64)
    n_windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n_windows)
    start = bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * WINDOW
    length = np.minimum(WINDOW, bounds[1:][owner] - start)
    sums, flat = np.zeros((len(sizes), w["out0"].shape[0])), _flat(w)
    by = np.argsort(-length, kind="stable")  # windows of like lengths together
    for k in range(0, len(by), LANES):
        some = by[k : k + LANES]
        steps = int(length[some].max())
        place = np.arange(steps)[:, None]
        live = place < length[some]
        codes = data[np.where(live, start[some] + place, 0)]
        total = pooled(flat, codes, None if live.all() else live.astype(np.float32))
        for c in range(len(total)):
            sums[:, c] += np.bincount(owner[some], total[c], len(sizes))
    return sums / np.maximum(1, sizes)[:, None], sizes


def identify(docs: DataFrame) -> DataFrame:
    """Per document: whether its id is held out, the language and its probability.

    Every byte of a text is labelled; very long texts are cut into windows like any others, in batches of their own. Null
    texts and texts without a letter are ``und`` with score 0, as are all if no language can be learned. A null id isn't held
    out and teaches nothing. Of equal probabilities the language first by name counts; repeated rows get equal results. An
    empty table gives no rows; extra columns are ignored.
    """
    langs, weights = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if weights is None:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    tag = hash(b"".join(v.tobytes() for v in weights.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Any = kept_in_worker(("language", tag), lambda: shared.value)
        for batch in text_batches(batches, "text"):
            chance, sizes = chances(held, batch.column("text"))
            best = chance.argmax(1)
            score = np.clip(chance[np.arange(len(best)), best], 0, 1)
            named = [langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(np.where(sizes > 0, score, 0.0))], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
