"""Language of a text by prediction by partial matching.

Each language has a byte context tree, learned from a bounded sample of
documents (``PER_LANGUAGE`` of each of the commonest languages, outside the held-out fold;
``samples`` has the bounds) and then
frozen: for every context of up to three bytes the counts of what follows.  The
code length of a byte is -log2 of its share of the longest context that was
ever followed by it, plus what the escapes from longer contexts cost (escapes
count as often as different bytes were seen, method C), down to 1/256 for a byte
never seen.  A text's code length is the sum over all its bytes, and the
language that codes it shortest is the answer; the score is its share of the
posterior with equal priors.

A text that is null or has no letter is ``und`` with score 0, and so is every
text if no language could be learned.  Repeated rows give repeated results; rows
without doc_id are left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canvass.llm import samples
from canvass.llm import textbytes as tb
from canvass.llm.common import documents, parts, small_batches

ORDER = 3
PER_LANGUAGE = 150
START = 10  # stands for the bytes before a text
SLOTS = 20  # bits of the hash by which a context is found in the table
#: Cells of the table of code lengths; what isn't in it is looked up in the trees.
CELLS = 1 << 22


def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it."""
    out = data.astype(np.uint32)
    first = offsets[:-1][np.diff(offsets) > 0]
    size = np.diff(offsets)[np.diff(offsets) > 0]
    for back in range(1, ORDER + 1):
        before = np.full(len(data), START, np.uint32)
        before[back:] = data[:-back] if back < len(data) else before[back:]
        for j in range(back):
            before[first[size > j] + j] = START
        out |= before << np.uint32(8 * back)
    return out


class Tree:
    """The frozen statistics of one language."""

    def __init__(self, seen: np.ndarray):
        self.codes, self.contexts = [], []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            symbol, count = np.unique(seen & mask, return_counts=True)
            context, start = np.unique(symbol >> np.uint32(8), return_index=True)
            total = np.add.reduceat(count, start)
            kinds = np.diff(np.concatenate([start, [len(symbol)]]))
            own = np.repeat(total + kinds, kinds)
            self.codes.append((symbol, np.log2(own / count)))
            self.contexts.append((context, np.log2((total + kinds) / kinds)))

    def lengths(self, wanted: np.ndarray) -> np.ndarray:
        """Code length in bits of each byte in its context."""
        out = np.zeros(len(wanted))
        rest = np.arange(len(wanted))
        for order in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            symbol = wanted[rest] & mask
            known, cost = self.codes[order]
            at = np.minimum(np.searchsorted(known, symbol), len(known) - 1)
            hit = known[at] == symbol
            out[rest[hit]] += cost[at[hit]]
            rest, symbol = rest[~hit], symbol[~hit] >> np.uint32(8)
            known, cost = self.contexts[order]
            at = np.minimum(np.searchsorted(known, symbol), len(known) - 1)
            out[rest] += np.where(known[at] == symbol, cost[at], 0)
        out[rest] += 8
        return out


class Model:
    def __init__(self, sample: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for text, name in sample:
            if text:
                by.setdefault(name, []).append(text)
        self.names = sorted(by)
        seen = [keys(*tb.column(pa.array(by[name], pa.large_string()))) for name in self.names]
        self.trees = [Tree(s) for s in seen]
        known, count = np.unique(np.concatenate([*seen, np.zeros(0, np.uint32)]), return_counts=True)
        self.known = np.sort(known[np.argsort(-count, kind="stable")[: CELLS // max(len(self.names), 1)]])
        self.table = np.stack([t.lengths(self.known) for t in self.trees], axis=1) if self.names else None
        if self.names:
            slot = self._slot(self.known)
            self.slot = np.zeros(1 << SLOTS, np.int32)
            self.slot[slot[::-1]] = np.arange(len(self.known), dtype=np.int32)[::-1]

    @staticmethod
    def _slot(wanted: np.ndarray) -> np.ndarray:
        return (wanted * np.uint32(2654435769)) >> np.uint32(32 - SLOTS)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        for low in range(0, len(data), 1 << 18):
            high = min(low + (1 << 18), len(data))
            # Three bytes more on the left give the part's first bytes their contexts.
            begin = max(0, low - ORDER)
            inner = offsets[(offsets > begin) & (offsets < high)] - begin
            wanted = keys(data[begin:high], np.concatenate([[0], inner, [high - begin]]))[low - begin :]
            at = self.slot[self._slot(wanted)]
            missing = np.flatnonzero(self.known[at] != wanted)
            value = self.table[at]
            if len(missing):
                fresh, inverse = np.unique(wanted[missing], return_inverse=True)
                value[missing] = np.stack([t.lengths(fresh) for t in self.trees], axis=1)[inverse]
            cuts = np.clip(offsets, low, high) - low
            some = np.flatnonzero(np.diff(cuts) > 0)
            out[some] += np.add.reduceat(value, cuts[some], axis=0, dtype=np.float64)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        bits = self.lengths(data, offsets)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), dtype=np.int64)])
        names, score = [], []
        for k, n in enumerate(np.diff(letters[offsets])):
            if n or any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode())):
                names.append(self.names[best[k]]), score.append(share[k])
            else:
                names.append("und"), score.append(0.0)
        return names, np.array(score)


def fit(docs: DataFrame, parts: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> Model:
    return Model(samples.languages(docs, parts, held_out, per_language))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches):
            n = batch.num_rows
            names, score = shared.value.predict(*tb.column(batch.column("text"))) if shared.value.names else (["und"] * n, np.zeros(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
