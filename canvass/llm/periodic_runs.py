"""Periodic runs: stretches of words that repeat with some period.

A run is a stretch of consecutive words with smallest period q and at least
``max(LEAST, TIMES * q)`` words that no neighbouring word extends.  Words q apart
are equal in it, so its first ``length - q`` words occur again q words on.  That
overlap has at least ``overlap()`` words (5), so every word of a run lies in a
k-gram of that many words that the document holds twice.

1. Repeated k-gram masking: words outside such k-grams can't join a run.  K-grams
   are compared by hashes; two that are taken for one only keep more words.
2. Main-Lorentz on what survives, and there on exact word numbers: each segment is
   halved again and again, and for each middle and period the longest common
   extensions to both sides tell the run across it.  Extensions come from names of
   all substrings whose lengths are powers of two, so one level of all halvings is
   a few array operations.

Every document is judged by itself, in one pass without a shuffle.  Memory
follows the longest text (some 250 bytes a word of it that survives).  A null or
blank text has no words and no runs; repeated rows give repeated results; rows
without doc_id are left out; other columns are ignored.  Ties for the longest run
go to the smallest start, then to the smallest period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canvass.llm import textbytes as tb
from canvass.llm.common import documents, parts, small_batches

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words that a run and the run moved by its period share."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words of a document, a tenth of which is made periodic from some word
    on, as a stated function of doc_id and the number of words."""
    h, n = zlib.crc32(b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def repeated(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document has twice.  ``first``: the
    n + 1 offsets of the documents' words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(len(hashes), bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    keys = tb.mix(tb.grams(hashes, k)[at] ^ tb.mix(doc[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    return tb.covered(len(hashes), at, at + k)


class _Extensions:
    """Longest common extensions within segments of a sequence of numbers."""

    def __init__(self, values: np.ndarray, longest: int):
        self.names, size = [values.astype(np.int64)], 1
        while 2 * size <= longest:
            low = self.names[-1]
            pair = low[:-size] * (int(low.max()) + 1) + low[size:]
            self.names.append(np.unique(pair, return_inverse=True)[1])
            size *= 2

    def forward(self, x: np.ndarray, y: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many values from x on equal those from y > x on, before ``stop``."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            at = np.flatnonzero(y + out + size <= stop)
            at = at[names[x[at] + out[at]] == names[y[at] + out[at]]]
            out[at] += size
        return out

    def backward(self, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many values before x equal those before y > x, from ``start`` on."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            at = np.flatnonzero(x - out - size >= start)
            at = at[names[x[at] - out[at] - size] == names[y[at] - out[at] - size]]
            out[at] += size
        return out


def main_lorentz(values: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of the segments [begin, end) of
    ``values``, ordered by start, then end."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    wide = np.flatnonzero(end - begin >= least)
    start, stop = begin[wide], end[wide]
    low, high = start, stop
    extend = _Extensions(values, int((stop - start).max())) if len(wide) else None
    while len(low):
        middle = (low + high) // 2
        periods = (high - low) // times
        q = tb.repeat_ranges(np.ones(len(low), np.int64), periods)
        m, left, right = (np.repeat(x, periods) for x in (middle, start, stop))
        # A run across the middle has a whole period right of it, or left of it.
        for x, fits in ((m, m + q <= right), (m - q, m - q >= left)):
            at = np.flatnonzero(fits)
            x, p, ends = x[at], q[at], right[at]
            ahead = extend.forward(x, x + p, ends)
            # Fewer equal pairs than these on both sides make no run.
            behind = extend.backward(x, x + p, left[at])
            length = ahead + behind + p
            long = length >= np.maximum(least, times * p)
            found.append(((x - behind)[long], (x + p + ahead)[long], p[long]))
        low, high, start, stop = (np.concatenate([a, b]) for a, b in ((low, middle), (middle, high), (start, start), (stop, stop)))
        wide = np.flatnonzero(high - low >= least)
        low, high, start, stop = low[wide], high[wide], start[wide], stop[wide]
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)  # multiples of a period give the same stretch
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[new], e[new], q[new]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs: (start, length, period), by start, then period."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    hashes = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(hash, w), np.int64, len(w)) for w in texts)])
    stays = repeated(tb.mix(hashes.view(np.uint64)), first, overlap(least, times))
    # Survivors side by side, with their documents' ends between them.
    at = np.flatnonzero(stays)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(at):
        return out
    doc = np.searchsorted(first, at, "right") - 1
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    numbers: dict[bytes, int] = {}
    values = np.fromiter((numbers.setdefault(texts[d][i], len(numbers)) for d, i in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True)), np.int64, len(at))
    s, e, q = main_lorentz(values, begin, end, least, times)
    d = doc[s]
    for k, run in zip(d.tolist(), zip((at[s] - first[d]).tolist(), (e - s).tolist(), q.tolist(), strict=True), strict=True):
        out[k].append(run)
    for each in out:
        each.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    start, length, period = np.array(runs).T
    gone = tb.covered(len(words), start + period, start + length)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def find(docs: DataFrame, change: Callable[[int, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """For every document ``doc_id, runs array<struct<start, length, period>>``
    (by start, then period) and ``kept binary``, its words joined by one space
    without the repeated periods of runs.  ``change`` maps doc_id and words to
    the words to look at."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches):
        for batch in parts(batches):
            ids = batch.column("doc_id")
            words = [t.encode().split() for t in batch.column("text").to_pylist()]
            if change is not None:
                words = [change(i, w) for i, w in zip(ids.to_pylist(), words, strict=True)]
            runs = runs_of(words)
            kept = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs], kind)
            yield pa.RecordBatch.from_arrays([ids, listed, pa.array(kept, pa.binary())], ["doc_id", "runs", "kept"])

    return documents(docs).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, kept binary")

