"""SimHash near-dedup at a Jaccard similarity of word shingles of 0.8, exactly.

Fingerprints of ``simhash`` propose pairs: those that differ in at most five of 64
bits, found by one-wildcard segments.  Whole sets decide.  A similarity of 0.8 can
mean fingerprints further apart than any segments of use can reach, so an index of
rare shingles brings the pairs that are still missing.

Two texts are near copies if the sets of their shingles (words in lower case,
five at a time; a shorter text is one shingle) have a Jaccard similarity of at
least 0.8.  In whatever order all shingles are put, two such sets of n and m
share one of the first ``n // 5 + 1`` of the one and of the first ``m // 5 + 1``
of the other.  So only those are indexed, and no pair is left out.  Shingles
that are common in a sample come last in that order, which keeps them out of
the index; the sample has no part in the result.

Texts of one set are one class, and only classes are indexed.  The classes that
meet under an entry are first compared with the smallest of them.  What that
joins needs no more comparisons; other pairs are compared unless their sizes
and their places in the order rule them out.  A sketch of a set holds for each of
512 parts of all shingles whether the set has an odd number of them: two
sketches differ in no more bits than the sets do in shingles, which rules out
most of the rest.  Each entry also knows the last ones of its class before it, and
two classes that have met under one of those aren't paired again: near copies
share long runs of entries, so a pair comes about once rather than at each of
them, and never less than once, as its first has none before it.  Links come
from whole sets alone.

The joins by entry and by pair go through slices of their keys, so that the disk
they shuffle through is a part of the whole.

Texts without words are copies of each other.  Repeated rows give repeated
results with one component; rows without doc_id are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm import simhash
from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch, documents, parts, small_batches
from canvass.llm.components import components

U = np.uint64
#: Texts in the sample, and shingles that count as common in it (the commonest).
SAMPLE_TEXTS = 10_000
COMMON = 100_000
#: Bits by which fingerprints of proposed pairs differ at most.
MOST_BITS = 5
#: Longs in a sketch.
SKETCH = 8
#: Earlier entries of its class that each entry of the last join knows.
EARLIER = 2
#: Rows that a slice of the joins by entry, and by pair, should have, and the most slices.
SLICE_ENTRIES, SLICE_PAIRS, SLICES = 2_000_000, 20_000, 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles, text by text, and where each text's begin."""
    starts, ends, first = tb.words(data, offsets)
    number = np.diff(first)
    shingles = np.where(number >= width, number - width + 1, np.minimum(number, 1))
    owner = np.repeat(np.arange(len(number)), shingles)
    hashes = np.zeros(len(owner), U)
    if len(starts):
        inside = ~tb.SPACE[data]
        keep = inside.copy()
        keep[ends[ends < len(data)]] = True  # one separator after each word
        plain = tb.LOWER[data][keep]
        plain[~inside[keep]] = 32
        begin = (np.cumsum(keep) - 1)[starts]
        end = begin + ends - starts
        some = np.flatnonzero(number)
        at = tb.repeat_ranges(first[some], shingles[some])
        last = np.minimum(at + width, first[owner + 1]) - 1
        view, digest = memoryview(plain.tobytes()), xxhash.xxh64_intdigest
        for low in range(0, len(at), 1 << 16):
            part = slice(low, low + (1 << 16))
            b, e = begin[at[part]].tolist(), end[last[part]].tolist()
            hashes[part] = np.fromiter((digest(view[i:j]) for i, j in zip(b, e, strict=True)), U, len(b))
    hashes = hashes[np.lexsort((hashes, owner))]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(number) + 1))


def prints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each set of shingles."""
    size = np.diff(first)
    counts = np.zeros((len(size), 64), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    for low in range(0, len(hashes), 1 << 16):
        bits, part = np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8)).reshape(-1, 64), owner[low : low + (1 << 16)]
        new = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        counts[part[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > size[:, None], axis=1).view(U).ravel()


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles``: each text's set in ascending order."""

    def run(batches):
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(*shingle_sets(*tb.column(batch.column("text")), width))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, in ascending order, and in how many."""
    share = max(docs.count() // SAMPLE_TEXTS, 1)
    some = sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), width)
    counts = some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    shingle = np.asarray(found.column("shingle").combine_chunks()).astype(np.int64).view(U)
    order = np.argsort(shingle)
    return shingle[order], np.asarray(found.column("count").combine_chunks()).astype(np.int64)[order]


def prefixes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, digest, fingerprint, n, sketch, entries``: a text's set as a
    digest, its fingerprint, its size, its sketch and the first of its shingles, the rare before the common."""
    known, counts = common(docs, width)

    def run(batches):
        for batch in parts(batches):
            hashes, first = shingle_sets(*tb.column(batch.column("text")), width)
            digests = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            size = np.diff(first)
            owner = np.repeat(np.arange(len(size)), size)
            bits = 64 * SKETCH
            odd = np.bincount(owner * bits + (hashes % U(bits)).astype(np.int64), minlength=len(size) * bits) % 2
            sketch = np.packbits(odd.astype(np.uint8)).view(U)
            weight = np.zeros(len(hashes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                weight = np.where(known[at] == hashes, counts[at], 0)
            ordered = hashes[np.lexsort((hashes, weight, owner))]
            most = np.where(size > 0, size // 5 + 1, 0)
            some = np.flatnonzero(size)
            entries = ordered[tb.repeat_ranges(first[some], most[some])] if len(some) else ordered
            columns = [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(prints(hashes, first).view(np.int64)), pa.array(size, pa.int64()), _lists(sketch, SKETCH * np.arange(len(size) + 1)), _lists(entries, np.concatenate([[0], np.cumsum(most)]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fingerprint", "n", "sketch", "entries"])

    return docs.mapInArrow(run, "doc_id long, digest binary, fingerprint long, n long, sketch array<long>, entries array<long>")


def possible(a: str, b: str) -> Column:
    """Whether sets of these sizes, whose first common shingle has these places,
    can be similar: 9 times what they share is at least 4 times both sizes."""
    return F.expr(f"9 * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= 4 * ({a}.n + {b}.n)")


def apart_in(a: str, b: str) -> str:
    """In how many bits two sketches differ."""
    return " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(SKETCH))


def met_before(a: str, b: str) -> str:
    """Whether one of the entries before this is among those of both classes,
    under which the two have met already."""
    known = " OR ".join(f"{a}[{j}] = {b}[{k}]" for j in range(EARLIER) for k in range(EARLIER))
    return f"coalesce({known}, false)"


def slices(rows: int, each: int) -> int:
    """How many slices a join goes through one after another: what is shuffled for
    it at once is a part of the rows, whatever their number."""
    return max(1, min(SLICES, -(-rows // each)))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def similar(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets have the similarity 0.8."""
    left, right = (sketches.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    pairs = scratch.keep(pairs.distinct().join(left, "a").join(right, "b").where(f"9 * ({apart_in('s_a', 's_b')}) <= n_a + n_b").select("a", "b").distinct())
    met = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    whole = scratch.keep(sets(docs.join(met, "doc_id", "left_semi"), width))
    left = whole.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = whole.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    n, found = slices(pairs.count(), SLICE_PAIRS), []
    for k in range(n):
        mine = lambda rows: rows.where(F.pmod(F.xxhash64("a"), F.lit(n)) == k)  # noqa: B023, E731
        both = mine(pairs).join(right, "b").join(mine(left), "a")
        found.append(scratch.keep(both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b").distinct()))
    scratch.drop(pairs, whole)
    return _all(found)


def near_copies(docs: DataFrame, width: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, component_id`` for every document; ``component_id`` is the
    smallest doc_id that near copies lead to."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "near-copies")
    docs = documents(docs)
    index = scratch.keep(prefixes(docs, width))
    # A class has one set, so that its first row's entries are those of all.
    classes = scratch.keep(index.groupBy("digest").agg(F.min("doc_id").alias("rep"), *(F.first(k).alias(k) for k in ("fingerprint", "n", "sketch", "entries"))))
    names = scratch.keep(index.select("doc_id", "digest"))
    scratch.drop(index)
    sketches = scratch.keep(classes.select("digest", "fingerprint", "rep", "n", "sketch"))

    # Classes of one fingerprint are held against the smallest of them, others by their links.
    alike = scratch.keep(sketches.groupBy("fingerprint").agg(F.min("rep").alias("head"), F.count("*").alias("classes")))
    same = sketches.join(alike.where("classes > 1"), "fingerprint").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    apart = simhash.links(alike.select("fingerprint", F.col("head").alias("rep")), scratch, MOST_BITS)
    proposed = same.unionByName(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    n = slices(classes.agg(F.sum(F.size("entries"))).first()[0] or 0, SLICE_ENTRIES)
    part = lambda rows, k: rows.where(F.pmod(F.col("entry"), F.lit(n)) == k)
    shared = []
    for k in range(n):
        entries = part(classes.select(F.posexplode("entries").alias("pos", "entry"), "rep", "n"), k).select("entry", F.struct("rep", "n", "pos").alias("one"))
        # Groups, not windows: they are summed up before they meet, and the join can be split.
        ends = entries.groupBy("entry").agg(F.min("one").alias("head"), F.max("one.rep").alias("end")).where("head.rep < end").select("entry", "head")
        to = F.when((F.col("one.rep") != F.col("head.rep")) & possible("one", "head"), F.col("head.rep"))
        shared.append(scratch.keep(entries.join(ends, "entry").select("entry", "one", to.alias("to"))))
    scratch.drop(classes)
    first = _all(shared).where("to IS NOT NULL").select(F.col("to").alias("a"), F.col("one.rep").alias("b"))
    links = similar(proposed.unionByName(first), sketches, docs, width, scratch)
    joined = scratch.keep(components(links, scratch))

    rest = _all(shared).join(joined, F.col("one.rep") == F.col("node"), "left").select("entry", "one", F.coalesce("component", "one.rep").alias("c"))
    rest = scratch.keep(rest)
    scratch.drop(*shared)
    ends = scratch.keep(rest.groupBy("entry").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("entry"))
    some = rest.join(ends, "entry", "left_semi").join(sketches.select("rep", "sketch"), F.col("one.rep") == F.col("rep"))
    # One class in order: its size and sketch keep apart what repeated rows with other texts put under one rep.
    order = Window.partitionBy("one.rep", "one.n", "sketch").orderBy("one.pos")
    some = scratch.keep(some.select("entry", "one", "c", "sketch", F.array(*(F.lag("entry", k + 1).over(order) for k in range(EARLIER))).alias("earlier")))
    scratch.drop(rest, ends)
    other = some.select("entry", F.col("one").alias("two"), F.col("c").alias("d"), F.col("sketch").alias("drawn"), F.col("earlier").alias("sooner"))
    # The sketches speak within the join, before a pair becomes a row.
    pairs = [part(some, k).join(part(other, k), "entry").where("one.rep < two.rep AND c <> d").where(possible("one", "two")).where(f"NOT {met_before('earlier', 'sooner')}").where(f"9 * ({apart_in('sketch', 'drawn')}) <= one.n + two.n") for k in range(n)]
    pairs = [scratch.keep(p.select(F.col("one.rep").alias("a"), F.col("two.rep").alias("b")).distinct()) for p in pairs]
    scratch.drop(some)
    more = similar(_all(pairs), sketches, docs, width, scratch)
    if not more.isEmpty():
        joined = scratch.keep(components(links.unionByName(more), scratch))
    named = sketches.join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return names.join(named, "digest").select("doc_id", "component_id")
