"""Repeated word windows, found level by level and cut out.

A window of ``window`` words that also starts in a document with a smaller
doc_id is removed there, with every word that it covers.

Level-wise doubling: runs of 4 words that occur in one document alone can't be
part of a repeated window, so only those that occur in several are extended to
8 words, of these only the repeated ones to 16, and so on while twice the length is
shorter than the window, and last to the window itself (4, 8, 13).  At the first level one run stands for each window: the one with the
least hash in it, its anchor.  Equal windows have equal anchors at equal
places, so no window is missed, while about a fifth of the runs is looked at.

Runs and windows are compared by hashes of their words, the full windows by two
of 64 bits; long words enter them by XXH3.  What is kept of a document between
levels is at most a few numbers for each of its words.  Counts are pre-aggregated before the shuffle, and what is joined to
them can be split by key, so a passage that a third of all documents share is
no hot spot.

A null text has no words.  Words are parted by space, tab, line feed, vertical
tab, form feed and return, and never changed.  Repeated rows of one doc_id
count as one document and each yield a result; rows without doc_id are left
out; other columns come through only in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch, parts, small_batches

#: Words of the runs at the first level.
BASE = 4
BITS = 10  # of a place's offsets within a window


def levels(window: int) -> list[int]:
    """Lengths between the first level and the window: each twice the last."""
    out = [BASE]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return out


def _stops(first: np.ndarray) -> np.ndarray:
    """For each word the end of its text."""
    return np.repeat(first[1:], np.diff(first))


def _anchors(window: int):
    def run(batches):
        for batch in parts(batches):
            data, offsets = tb.column(batch.column("text"))
            starts, ends, first = tb.words(data, offsets)
            grams = tb.grams(tb.word_hashes(data, starts, ends), BASE)
            at, least, most = tb.anchors(grams, _stops(first), BASE, window)
            text = np.searchsorted(first, at, "right") - 1
            ids = np.asarray(batch.column("doc_id"))[text]
            place = ((at - first[text]) << 2 * BITS) | (least << BITS) | most
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(ids), pa.array(place)], ["run", "doc_id", "place"])

    return run


def _unpack(batch: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and offsets of the places listed for each text."""
    places, bounds = tb.lists(batch.column("places"))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low = (1 << BITS) - 1
    return text, (places >> 2 * BITS) + first[text], (places >> BITS) & low, places & low


def _extend(length: int, window: int):
    """From places with runs of half the length to runs of this length: those
    that start there, for the windows that hold them, and for the other windows
    those that end with the shorter run or, near the middle, lie around it."""
    half = length // 2

    def run(batches):
        for batch in parts(batches):
            data, offsets = tb.column(batch.column("text"))
            starts, ends, first = tb.words(data, offsets)
            text, at, least, most = _unpack(batch, first)
            fits = window - length  # the most words before a run of this length in a window
            edge = max(fits + 1, half)  # from here on the longer run can end with the shorter one
            right, left = least <= fits, most >= edge
            # Windows between these hold only longer runs that begin at another word each.
            most_between, least_between = np.minimum(most, edge - 1), np.maximum(least, fits + 1)
            number = np.maximum(most_between - least_between + 1, 0)
            between = np.repeat(at, number) - (tb.repeat_ranges(least_between, number) - fits)
            begin = np.concatenate([at[right], at[left] - half, between])
            low = np.concatenate([least[right], np.maximum(least[left], edge) - half, np.full(len(between), fits)])
            high = np.concatenate([np.minimum(most[right], fits), most[left] - half, np.full(len(between), fits)])
            text = np.concatenate([text[right], text[left], np.repeat(text, number)])
            place = ((begin - first[text]) << 2 * BITS) | (low << BITS) | high
            grams = tb.grams(tb.word_hashes(data, starts, ends), length)
            columns = [pa.array(grams[begin].view(np.int64) if len(begin) else begin), pa.array(np.asarray(batch.column("doc_id"))[text]), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["run", "doc_id", "place"])

    return run


def _windows(window: int):
    """The 128-bit hash of each window that has its run at a listed place."""

    def run(batches):
        for batch in parts(batches):
            data, offsets = tb.column(batch.column("text"))
            starts, ends, first = tb.words(data, offsets)
            text, at, least, most = _unpack(batch, first)
            number = most - least + 1
            begin = tb.repeat_ranges(at - most, number)
            text = np.repeat(text, number)
            columns = [pa.array(np.asarray(batch.column("doc_id"))[text]), pa.array(begin - first[text])]
            for k in range(2):
                full = tb.grams(tb.word_hashes(data, starts, ends, k), window, k)
                columns.append(pa.array(full[begin].view(np.int64) if len(begin) else begin))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "w1", "w2"])

    return run


def _remove(keep: tuple[str, ...], window: int):
    """Cut the windows at the listed starts out of each text."""

    def run(batches):
        for batch in parts(batches):
            data, offsets = tb.column(batch.column("text"))
            starts, ends, first = tb.words(data, offsets)
            at, bounds = tb.lists(batch.column("starts"))
            at = at + np.repeat(first[:-1], np.diff(bounds))
            gone = tb.covered(len(starts), at, at + window) if len(starts) else np.zeros(0, bool)
            total = np.concatenate([[0], np.cumsum(gone)])
            # A word goes with the white space after it; all other white space stays.
            out = np.flatnonzero(gone)
            follows = np.append(starts, len(data))[out + 1] if len(out) else out
            stops = np.minimum(follows, offsets[np.searchsorted(first, out, "right")])
            left = ~tb.covered(len(data), starts[out], stops)
            size = np.concatenate([[0], np.cumsum(left)])[offsets]
            columns = [batch.column("doc_id"), *(batch.column(k) for k in keep), pa.array(np.diff(first)), pa.array(np.diff(total[first])), tb.binary(data[left], size, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_words", "n_removed", "kept"])

    return run


def _repeated(runs: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in several documents, with the smallest doc_id."""
    return runs.groupBy(*keys).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select(*keys, "owner")


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``doc_id, starts``: where (in words) the windows of a document start that
    also start in one with a smaller doc_id."""
    if not BASE < window < 1 << BITS:
        raise ValueError(f"a window has over {BASE} and under {1 << BITS} words")
    texts = docs.select("doc_id", "text")
    schema = "run long, doc_id long, place long"

    def places(runs: DataFrame) -> DataFrame:
        """For each document where the runs that others have too are."""
        often = scratch.keep(_repeated(runs, "run"))
        again = runs.join(often, "run", "left_semi").select("doc_id", "place")
        kept = scratch.keep(again.groupBy("doc_id").agg(F.collect_set("place").alias("places")))
        scratch.drop(runs, often)
        return kept

    left = places(scratch.keep(texts.mapInArrow(_anchors(window), schema)))
    for length in levels(window)[1:]:
        runs = scratch.keep(texts.join(left, "doc_id").mapInArrow(_extend(length, window), schema))
        scratch.drop(left)
        left = places(runs)
    found = scratch.keep(texts.join(left, "doc_id").mapInArrow(_windows(window), "doc_id long, start long, w1 long, w2 long"))
    scratch.drop(left)
    # The hashes' two halves in turn, so that half of the windows is shuffled at a time.
    marked = []
    for half in ("w1 < 0", "w1 >= 0"):
        part = found.where(half)
        # Written first, so that the join reads two plain tables and its large keys can be split.
        often = scratch.keep(_repeated(part, "w1", "w2"))
        marked.append(scratch.keep(part.join(often, ["w1", "w2"]).where("owner < doc_id").select("doc_id", "start")))
        scratch.drop(often)
    scratch.drop(found)
    kept = scratch.keep(marked[0].unionByName(marked[1]).groupBy("doc_id").agg(F.collect_set("start").alias("starts")))
    scratch.drop(*marked)
    return kept


def remove_repeats(docs: DataFrame, window: int = 13, keep: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, *keep, n_words, n_removed, kept``: for every document the
    number of its words and of those removed, and its text without these, each
    cut with the white space after it.  Windows are judged on the input."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "substrings")
    base = docs.where("doc_id IS NOT NULL").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}).select("doc_id", "text", *keep)
    marked = repeated_windows(base, window, scratch)
    kinds = dict(base.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{k}` {kinds[k]}" for k in keep), "n_words long, n_removed long, kept string"])
    return base.join(marked, "doc_id", "left").mapInArrow(_remove(keep, window), schema)
