"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read through overlapping windows of ``WINDOW`` words, a new one every
``STRIDE`` words to the end of the text.  A word, a run of letters and
digits in lower case, enters as the vector of its hash, the mean of its
character trigrams' vectors and the vector of its first characters; two gated recurrent
layers read the window in both directions, attention weighs their states, and
the weighted mean gives the window's value.  The text's score comes from its
highest window and the number of its windows.

All is numpy.  The network learns on the driver from a bounded sample of
labelled documents outside the held-out fold (``PER_LABEL`` of each label): in
each round the highest window of every text, and for clean texts another one
too, is trained towards the text's label.  Scoring reads whole texts where they
are; the work of a word that occurs often in a batch is done once.

A null or empty text has one empty window.  Without labelled rows of both labels
every score is 0.5.  Repeated rows give repeated results; rows without doc_id
are left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import samples
from canvass.llm import textbytes as tb
from canvass.llm.common import documents, parts, small_batches
from canvass.llm.quality import calibrate

PER_LABEL = 1500
WINDOW, STRIDE = 32, 16
WORDS, TRIGRAMS, STARTS = 1 << 13, 1 << 12, 1 << 12  # hash buckets
DIM, HIDDEN = 6, 8
ROUNDS, LOOK_AGAIN = 18, 4  # rounds, and after how many the highest windows are sought anew
PART = 4096  # windows run at once
START = 6  # bytes of a word's beginning
EDGE = 32  # stands before and after a word in its trigrams


class Words:
    """The words of a batch: for each its kind, and for each kind its hash
    bucket, its beginning's and its trigrams'."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = tb.lower(data)
        starts, ends, self.first = tb.words(data, offsets, tb.NO_LETTER)
        hashes = tb.word_hashes(data, starts, ends)
        kinds, at, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.kind = self.kind.astype(np.int32)
        self.bucket = (kinds >> np.uint64(40)).astype(np.int64) % WORDS
        begin, size = starts[at], ends[at] - starts[at]
        order = np.argsort(at)
        self.start = np.empty(len(at), np.int64)
        self.start[order] = (tb.word_hashes(data, begin[order], begin[order] + np.minimum(size, START)[order], 1) >> np.uint64(40)).astype(np.int64) % STARTS
        place = tb.repeat_ranges(begin, size)
        self.owner = np.repeat(np.arange(len(kinds)), size)
        middle = data[place].astype(np.int64)
        before, after = np.full(len(place), EDGE), np.full(len(place), EDGE)
        inner = np.ones(len(place), bool)
        inner[(np.cumsum(size) - size)[size > 0]] = False
        before[1:][inner[1:]] = middle[:-1][inner[1:]]
        after[:-1][inner[1:]] = middle[1:][inner[1:]]
        self.trigram = ((before * 331 + middle) * 331 + after) * 2654435761 % (1 << 32) >> 20
        self.share = 1.0 / np.maximum(size, 1)

    def only(self, kinds: np.ndarray) -> Words:
        """Of these kinds of words alone."""
        part = object.__new__(Words)
        start = np.searchsorted(self.owner, kinds)
        size = np.searchsorted(self.owner, kinds, "right") - start
        part.bucket, part.start, part.share = self.bucket[kinds], self.start[kinds], self.share[kinds]
        part.trigram, part.owner = self.trigram[tb.repeat_ranges(start, size)], np.repeat(np.arange(len(kinds)), size)
        return part

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of each window, and the texts' window offsets."""
        number = np.diff(self.first)
        per = np.maximum(-(-(number - WINDOW) // STRIDE), 0) + 1
        bounds = np.concatenate([[0], np.cumsum(per)])
        step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)
        begin = np.repeat(self.first[:-1], per) + step * STRIDE
        size = np.minimum(WINDOW, np.repeat(self.first[1:], per) - begin)
        return begin, size, bounds


def grouped(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows for each of ``size`` places."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    at = at[order]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    if len(new):
        out[at[new]] = np.add.reduceat(rows[order], new, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": normal(WORDS, DIM, scale=0.1), "tri": normal(TRIGRAMS, DIM, scale=0.1), "start": normal(STARTS, DIM, scale=0.1), "pool": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"in_{side}": normal(3 * DIM, 3 * HIDDEN, scale=0.4), f"gate_{side}": normal(HIDDEN, 2 * HIDDEN, scale=0.3), f"state_{side}": normal(HIDDEN, HIDDEN, scale=0.3), f"b_{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.weights = np.zeros(3)  # of highest window, of log windows, constant

    def inputs(self, words: Words) -> np.ndarray:
        """The vector of each kind of word."""
        tri = np.zeros((len(words.bucket), DIM), np.float32)
        if len(words.owner):
            new = np.flatnonzero(np.concatenate([[True], words.owner[1:] != words.owner[:-1]]))
            tri[words.owner[new]] = np.add.reduceat(self.p["tri"][words.trigram], new, axis=0)
        return np.concatenate([self.p["word"][words.bucket], tri * words.share[:, None].astype(np.float32), self.p["start"][words.start]], axis=1)

    def run(self, kind: np.ndarray, mask: np.ndarray, ready: dict[str, np.ndarray], keep: bool = False):
        """Values of windows: ``kind`` (time x windows) picks rows of ``ready``,
        the words' shares in each direction's gates."""
        steps, n = kind.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        kept = {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            wg, ws, each = self.p[f"gate_{side}"], self.p[f"state_{side}"], []
            for t in order:
                x, m = ready[side][kind[t]], mask[t][:, None]
                gates = sigmoid(x[:, : 2 * HIDDEN] + h @ wg)
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ ws)
                old = h
                h = old + m * z * (new - old)
                states[t, :, slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)] = h
                if keep:
                    each.append((t, old, z, r, new))
            kept[side] = each
        look = states @ self.p["pool"] + np.where(mask > 0, 0, -1e4).astype(np.float32)
        look = np.exp(look - look.max(axis=0))
        look /= look.sum(axis=0)
        pooled = (look[:, :, None] * states).sum(axis=0)
        value = pooled @ self.p["out"] + self.p["bias"]
        return (value, states, look, pooled, kept) if keep else value

    def ready(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {side: vectors @ self.p[f"in_{side}"] + self.p[f"b_{side}"] for side in "fb"}

    def layout(self, words: Words, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = int(max(size.max(initial=1), 1))
        there = np.arange(steps)[:, None] < size
        at = np.where(there, begin + np.arange(steps)[:, None], 0)
        kind = words.kind[at] if len(words.kind) else np.zeros_like(at)
        return kind, there.astype(np.float32)

    def values(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The value of every window, and the texts' window offsets."""
        begin, size, bounds = words.windows()
        vectors = self.inputs(words)
        ready = self.ready(vectors if len(vectors) else np.zeros((1, 3 * DIM), np.float32))
        out = np.empty(len(begin), np.float32)
        for low in range(0, len(begin), PART):
            part = slice(low, low + PART)
            out[part] = self.run(*self.layout(words, begin[part], size[part]), ready)
        return out, bounds

    def highest(self, words: Words) -> np.ndarray:
        """For each text its highest window's value and the logarithm of their number."""
        value, bounds = self.values(words)
        return np.stack([np.maximum.reduceat(value, bounds[:-1]), np.log(np.diff(bounds))], axis=1).astype(float)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.highest(Words(data, offsets))
        return sigmoid(np.clip(x @ self.weights[:2] + self.weights[2], -40, 40))

    def slopes(self, words: Words, begin: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log-likelihood of labels y, by going back through time."""
        kind, mask = self.layout(words, begin, size)
        used, kind = np.unique(kind, return_inverse=True)
        kind, words = kind.reshape(mask.shape), words.only(used)
        vectors = self.inputs(words)
        value, states, look, pooled, kept = self.run(kind, mask, self.ready(vectors), keep=True)
        p, g = self.p, {}
        error = ((y - sigmoid(value)) * weight).astype(np.float32)
        g["bias"], g["out"] = np.array([error.sum()]), pooled.T @ error
        d_pooled = error[:, None] * p["out"]
        d_look = (states * d_pooled).sum(axis=2)
        d_raw = look * (d_look - (look * d_look).sum(axis=0))
        d_states = look[:, :, None] * d_pooled + d_raw[:, :, None] * p["pool"]
        g["pool"] = np.einsum("tn,tnh->h", d_raw, states)
        d_vectors = np.zeros_like(vectors)
        for side in "fb":
            wg, ws = p[f"gate_{side}"], p[f"state_{side}"]
            g[f"gate_{side}"], g[f"state_{side}"] = np.zeros_like(wg), np.zeros_like(ws)
            d_x = np.empty((*kind.shape, 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(begin), HIDDEN), np.float32)
            for t, old, z, r, new in reversed(kept[side]):
                d_h = d_h + d_states[t, :, slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)]
                m = mask[t][:, None]
                d_new = d_h * m * z * (1 - new**2)
                d_z = d_h * m * (new - old) * z * (1 - z)
                d_mixed = d_new @ ws.T
                d_r = d_mixed * old * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], axis=1)
                g[f"gate_{side}"] += old.T @ d_gates
                g[f"state_{side}"] += (r * old).T @ d_new
                d_x[t] = np.concatenate([d_gates, d_new], axis=1)
                d_h = d_h * (1 - m * z) + d_mixed * r + d_gates @ wg.T
            d_ready = grouped(kind.ravel(), d_x.reshape(-1, 3 * HIDDEN), len(vectors))
            g[f"in_{side}"], g[f"b_{side}"] = vectors.T @ d_ready, d_ready.sum(axis=0)
            d_vectors += d_ready @ p[f"in_{side}"].T
        g["word"] = grouped(words.bucket, d_vectors[:, :DIM], WORDS)
        g["start"] = grouped(words.start, d_vectors[:, 2 * DIM :], STARTS)
        g["tri"] = grouped(words.trigram, (d_vectors[:, DIM : 2 * DIM] * words.share[:, None].astype(np.float32))[words.owner], TRIGRAMS)
        return g


TEXTS_AT_ONCE = 128


def _evidence(words: Words, name: str, y: np.ndarray, size: int) -> np.ndarray:
    """How much a bucket speaks for label 1: the smoothed log ratio of the
    shares of texts that hold it."""
    ones, all_ = np.zeros(size), np.zeros(size)
    for low in range(0, len(y), TEXTS_AT_ONCE):
        bounds = words.first[low : low + TEXTS_AT_ONCE + 1]
        text = np.repeat(np.arange(low, low + len(bounds) - 1), np.diff(bounds))
        pair = np.unique(text * len(words.bucket) + words.kind[bounds[0] : bounds[-1]])
        text, kind = pair // max(len(words.bucket), 1), pair % max(len(words.bucket), 1)
        if name == "tri":
            start = np.searchsorted(words.owner, kind)
            n = np.searchsorted(words.owner, kind, "right") - start
            bucket, text = words.trigram[tb.repeat_ranges(start, n)], np.repeat(text, n)
        else:
            bucket = (words.bucket if name == "word" else words.start)[kind]
        pair = np.unique(text * size + bucket)
        ones += np.bincount(pair % size, weights=y[pair // size], minlength=size)
        all_ += np.bincount(pair % size, minlength=size)
    return np.log((ones + 1) / (y.sum() + 2)) - np.log((all_ - ones + 1) / (len(y) - y.sum() + 2))


def train(sample: list[tuple[str, int]], rounds: int = ROUNDS, seed: int = 7) -> Network | None:
    """None if a label is missing."""
    y = np.array([label for _, label in sample], float)
    if len(set(y)) < 2:
        return None
    words = Words(*tb.column(pa.array([text for text, _ in sample], pa.large_string())))
    begin, size, bounds = words.windows()
    net, r = Network(seed), np.random.default_rng(seed)
    for name in ("word", "start", "tri"):
        net.p[name][:, 0] = np.clip(_evidence(words, name, y, len(net.p[name])), -3, 3) / 2
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    plain = net.inputs(words)[:, [0, DIM, 2 * DIM]].sum(axis=1)[words.kind] if len(words.kind) else np.zeros(0)
    total = np.concatenate([[0], np.cumsum(plain)])
    value = total[begin + size] - total[begin]
    for turn in range(rounds):
        if turn and turn % LOOK_AGAIN == 0:
            value, _ = net.values(words)
        top = np.array([low + int(np.argmax(value[low:high])) for low, high in zip(bounds[:-1], bounds[1:], strict=True)])
        other = bounds[:-1] + (r.random(len(y)) * np.diff(bounds)).astype(np.int64)
        clean = np.flatnonzero(y == 0)
        chosen = np.concatenate([top, other[clean]])
        label = np.concatenate([y, np.zeros(len(clean))])
        order = r.permutation(len(chosen))
        for low in range(0, len(order), 512):
            part = order[low : low + 512]
            g = net.slopes(words, begin[chosen[part]], size[chosen[part]], label[part], np.full(len(part), 1 / len(part)))
            step += 1
            for k, v in net.p.items():
                slope = g[k] - 1e-5 * v
                m, s = state[k]
                m += 0.1 * (slope - m)
                s += 0.01 * (slope**2 - s)
                v += (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.weights = calibrate(net.highest(words), y)
    return net


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, per_label: int = PER_LABEL) -> Network | None:
    return train(samples.labelled(docs, labels, "toxic", parts, held_out, per_label))


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, score`` for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    base = documents(docs)
    if network is None:
        return base.select("doc_id", F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(network)

    def run(batches):
        for batch in parts(batches):
            value = shared.value.score(*tb.column(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(value, float))], ["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double")
