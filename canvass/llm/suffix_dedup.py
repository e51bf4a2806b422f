"""Repeated byte strings found by a distributed, sampled suffix array.

Every byte covered by a string of ``length`` bytes that also starts earlier (in
a document with a smaller doc_id, or earlier in the same one) is removed.

1. Suffixes are sampled by content: a string is pinned by its 32-byte run of
   least hash, its anchor, and suffixes are taken at anchors only.  Equal strings
   have equal anchors at equal places, so no repeat is missed.
2. Anchors whose run occurs once are dropped; the others take with them the
   bytes that their strings can cover.
3. Sampled splitters range-partition these suffixes by their leading bytes
   (ties by doc_id and place, so one run's suffixes can fill several buckets).
   There are at most ``MOST_BUCKETS`` buckets, so the sample that the driver sees
   is bounded; a task goes through its bucket in order, ``CHUNK`` suffixes at a
   time.  Each chunk is sorted by multikey quicksort, in both reading directions,
   and neighbours' common prefixes give, for each offset, the strings that are
   equal.
4. Chunks end between two runs where they can.  Where a run goes on in the next
   chunk, or may do so in the next bucket, they are compared across the boundary:
   the strings of that run that were seen first in a chunk meet by two 64-bit
   hashes of their bytes (XXH3).

Within a chunk bytes are compared, not hashes.  A chunk is bounded however often
a run occurs.  What is kept of a document is at most a few numbers for each of its
bytes.

A null text is empty.  Repeated rows of one doc_id count as one document and
each yield a result; rows without doc_id are left out; other columns come
through only in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch, partitions, parts, settings, small_batches

U = np.uint64
#: Bytes of a run; a power of two.
RUN = 32
BITS = 10  # of a place's offsets within a string
LOW = (1 << BITS) - 1
#: Suffixes that are sorted at once, suffixes of a bucket, and buckets.
CHUNK, SUFFIXES_PER_BUCKET, MOST_BUCKETS = 25_000, 400_000, 1 << 14
#: Suffixes of each bucket that Spark's sampler may send to the driver.
SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
SAMPLES_PER_BUCKET = 30
#: Ranges up to this length are sorted by all their keys at once.
SMALL_RANGE = 2048
#: Texts, and suffixes, that numpy works on at once.
TEXT_BATCH, SUFFIX_BATCH = 128, 4096


def run_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes, by doubling."""
    h, size, factor = tb.BYTES[0][data], 1, int(tb.BASES[0])
    while size < RUN and len(h) > size:
        h = h[:-size] * U(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    return tb.mix(h) if size == RUN else np.zeros(0, U)


def _anchors(length: int):
    def run(batches):
        for batch in parts(batches, TEXT_BATCH):
            data, offsets = tb.column(batch.column("text"))
            stops = np.repeat(offsets[1:], np.diff(offsets))
            h = run_hashes(data)
            at, least, most = tb.anchors(h, stops, RUN, length)
            text = np.searchsorted(offsets, at, "right") - 1
            place = ((at - offsets[text]) << 2 * BITS) | (least << BITS) | most
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.asarray(batch.column("doc_id"))[text]), pa.array(place)], ["run", "doc_id", "place"])

    return run


def _contexts(length: int):
    """Each suffix with the bytes that its strings cover."""

    def run(batches):
        for batch in parts(batches, TEXT_BATCH):
            data, offsets = tb.column(batch.column("text"))
            places, bounds = tb.lists(batch.column("places"))
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            at = (places >> 2 * BITS) + offsets[text]
            most, least = places & LOW, (places >> BITS) & LOW
            size = most + length - least
            ids = np.asarray(batch.column("doc_id"))[text]
            for low in range(0, len(at), SUFFIX_BATCH):  # a long text has many
                part = slice(low, low + SUFFIX_BATCH)
                bytes_ = data[tb.repeat_ranges(at[part] - most[part], size[part])]
                column = tb.binary(bytes_, np.concatenate([[0], np.cumsum(size[part])]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(places[part]), column], ["doc_id", "place", "bytes"])

    return run


def matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row of ``width`` bytes for each suffix, zero after its end; step -1
    reads backwards from ``begin``."""
    width = -(-width // 8) * 8
    out = np.zeros((len(begin), width), np.uint8)
    reach = np.arange(width, dtype=np.int64)
    for low in range(0, len(begin), 4096):  # in parts: the places take eight times the bytes
        part = slice(low, low + 4096)
        there = reach < size[part, None]
        at = begin[part, None] + step * reach
        out[part][there] = data[at[there]]
    return out


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of the rows by multikey quicksort over keys of eight bytes: a
    range is parted into those whose key is less than the pivot's, equal or
    more, and those with equal keys go on with the next key."""
    keys = rows.view(">u8").astype(U)
    order = np.arange(len(rows))
    ranges = [(0, len(rows), 0)]
    while ranges:
        low, high, depth = ranges.pop()
        if high - low < 2 or depth == keys.shape[1]:
            continue
        part = order[low:high]
        key = keys[part, depth]
        if high - low <= SMALL_RANGE:
            order[low:high] = part[_by_columns(keys[part, depth:])]
            continue
        some = np.sort(key[:: len(key) // 63 + 1])
        pivot = some[len(some) // 2]
        less, more = key < pivot, key > pivot
        order[low:high] = np.concatenate([part[less], part[~(less | more)], part[more]])
        same, after = low + int(less.sum()), high - int(more.sum())
        ranges += [(low, same, depth), (same, after, depth + 1), (after, high, depth)]
    return order


def _by_columns(keys: np.ndarray) -> np.ndarray:
    """The order of a small range: each next key parts only what is still tied."""
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    for j in range(1, keys.shape[1]):
        before = keys[order, j - 1]
        new[1:] |= before[1:] != before[:-1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        part = order[tied]
        order[tied] = part[np.lexsort((keys[part, j], np.cumsum(new)[tied]))]
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in this order."""
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 50_000):
        high = min(low + 50_000, len(order))
        other = rows[order[low:high]] != rows[order[low - 1 : high - 1]]
        out[low:high] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def repeats(ids: np.ndarray, places: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix (rows in the order of the documents) and number of bytes
    before it: is the string there one that started earlier?  And is it one
    whose first place is this one?"""
    n = len(ids)
    least, most = (places >> BITS) & LOW, places & LOW
    width = length - RUN + 1
    again, first = np.zeros((n, width), bool), np.zeros((n, width), bool)
    center = offsets[:-1] + most
    prefixes, inverse = [], []
    for begin, size, far, step in ((center, offsets[1:] - center, length, 1), (center - 1, most, max(width - 1, 1), -1)):
        rows = matrix(data, begin, size, far, step)
        order = multikey_sort(rows)
        prefixes.append(common_prefix(rows, order))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        inverse.append(place)
    for before in range(width):
        some = np.flatnonzero((least <= before) & (before <= most))
        if not len(some):
            continue
        right = np.cumsum(prefixes[0] < length - before)[inverse[0][some]]
        left = np.cumsum(prefixes[1] < before)[inverse[1][some]] if before else 0
        _, at, which = np.unique(right * (n + 1) + left, return_index=True, return_inverse=True)
        origin = some[at[which]]
        own = (ids[origin] == ids[some]) & (places[origin] == places[some])
        again[some, before] = ~own
        first[some, before] = own
    return again, first


def _leads(table: pa.Table) -> np.ndarray:
    """The run that each suffix starts with."""
    data, offsets = tb.column(table.column("bytes"))
    most = np.asarray(table.column("place").combine_chunks()) & LOW
    return matrix(data, offsets[:-1] + most, np.full(table.num_rows, RUN), RUN, 1)


def _chunks(batches, most: int):
    """A sorted bucket in chunks of about ``most`` suffixes that end with a
    run, unless the run itself is longer; and whether the first and the last
    run of each may have suffixes elsewhere."""
    held, rows, head = [], 0, True
    for batch in batches:
        step = min(SUFFIX_BATCH, most)
        for low in range(0, batch.num_rows, step):
            held.append(batch.slice(low, step))
            rows += held[-1].num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            leads = _leads(table)
            ends = np.flatnonzero((leads[1:] != leads[:-1]).any(axis=1)) + 1
            cut = int(ends[-1]) if len(ends) else table.num_rows
            yield table.slice(0, cut), head, not len(ends)
            head = not len(ends)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks(), head, True


def _bucket(length: int, chunk: int):
    names = ["doc_id", "begin", "end", "w1", "w2"]

    def run(batches):
        for table, head, tail in _chunks(batches, chunk):
            ids, places = np.asarray(table.column("doc_id").combine_chunks()), np.asarray(table.column("place").combine_chunks())
            order = np.lexsort((places, ids))
            ids, places = ids[order], places[order]
            table = table.take(pa.array(order))
            data, offsets = tb.column(table.column("bytes"))
            again, first = repeats(ids, places, data, offsets, length)
            at, most = places >> 2 * BITS, places & LOW
            # Strings that started earlier, as runs of starts; column 0 of the flipped table is the earliest.
            width = again.shape[1]
            flipped = np.zeros((len(ids), width + 2), bool)
            flipped[:, 1:-1] = again[:, ::-1]
            row, begin = np.nonzero(flipped[:, 1:] & ~flipped[:, :-1])
            end = np.nonzero(~flipped[:, 1:] & flipped[:, :-1])[1] - 1
            anchor = at[row] - (width - 1)
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(anchor + begin), pa.array(anchor + end + length), none, none], names)
            # The runs at the chunk's ends may go on elsewhere.
            leads = _leads(table)
            edge = multikey_sort(leads)[[0, -1]]
            ends = head & (leads == leads[edge[0]]).all(axis=1) | tail & (leads == leads[edge[1]]).all(axis=1)
            row, before = np.nonzero(first & ends[:, None])
            for low in range(0, len(row), 500_000):
                r, o = row[low : low + 500_000], before[low : low + 500_000]
                begin = offsets[r] + most[r] - o
                w = [pa.array(tb.word_hashes(data, begin, begin + length, k).view(np.int64)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(at[r] - o), pa.array(at[r] - o + length), *w], names)

    return run


def _cut(keep: tuple[str, ...]):
    def run(batches):
        for batch in parts(batches, TEXT_BATCH):
            data, offsets = tb.column(batch.column("text"))
            spans, bounds = tb.lists(batch.column("spans"))
            base = np.repeat(offsets[:-1], np.diff(bounds))
            gone = tb.covered(len(data), (spans >> 32) + base, (spans & 0xFFFFFFFF) + base)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            begins[starts] = gone[starts]
            total, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            size, removed = np.diff(offsets), np.diff(total[offsets])
            kept = tb.binary(data[~gone], np.concatenate([[0], np.cumsum(size - removed)]))
            columns = [batch.column("doc_id"), *(batch.column(k) for k in keep), pa.array(size), pa.array(removed), pa.array(np.diff(runs[offsets])), kept]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated_spans(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``doc_id, begin, end`` (in bytes) of repeated strings, overlapping."""
    if not RUN < length < 1 << BITS:
        raise ValueError(f"a string has over {RUN} and under {1 << BITS} bytes")
    spark = texts.sparkSession
    anchors = scratch.keep(texts.mapInArrow(_anchors(length), "run long, doc_id long, place long"))
    # Written first, so that the join reads two plain tables and its large keys can be split.
    often = scratch.keep(anchors.groupBy("run").count().where("count > 1").select("run"))
    left = scratch.keep(anchors.join(often, "run", "left_semi").select("doc_id", "place"))
    scratch.drop(anchors, often)
    places = left.distinct().groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    suffixes = scratch.keep(texts.join(places, "doc_id").mapInArrow(_contexts(length), "doc_id long, place long, bytes binary"))
    scratch.drop(left)
    n = min(partitions(spark, suffixes.count(), SUFFIXES_PER_BUCKET), MOST_BUCKETS)
    lead = F.expr(f"substring(bytes, cast((place & {LOW}) + 1 AS int), {RUN})")
    dealt = suffixes.repartitionByRange(n, lead, "doc_id", "place").sortWithinPartitions(lead, "doc_id", "place")
    with settings(spark, **{SAMPLES: str(SAMPLES_PER_BUCKET)}):
        found = scratch.keep(dealt.mapInArrow(_bucket(length, CHUNK), "doc_id long, begin long, end long, w1 long, w2 long"))
    scratch.drop(suffixes)
    local = found.where("w1 IS NULL").select("doc_id", "begin", "end")
    across = found.where("w1 IS NOT NULL")
    first = across.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1")
    more = across.join(first, ["w1", "w2"]).where("NOT (first.doc_id = doc_id AND first.begin = begin)")
    return local.unionByName(more.select("doc_id", "begin", "end"))


def remove_repeats(docs: DataFrame, length: int = 100, keep: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, *keep, n_bytes, n_removed, n_spans, kept binary`` for every
    document; ``kept`` joins the bytes that stay.  Strings are judged on the
    input."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "suffixes")
    base = docs.where("doc_id IS NOT NULL").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}).select("doc_id", "text", *keep)
    spans = repeated_spans(base.select("doc_id", "text"), length, scratch)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.expr("shiftleft(begin, 32) + end")).alias("spans"))
    kinds = dict(base.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{k}` {kinds[k]}" for k in keep), "n_bytes long, n_removed long, n_spans long, kept binary"])
    return base.join(spans, "doc_id", "left").mapInArrow(_cut(keep), schema)
