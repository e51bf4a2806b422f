"""SimHash near-duplicates by deletion variants.

A document's 64-bit fingerprint sums its shingles' hashes bit by bit.  Two
fingerprints that differ in at most four bits, cut into three segments, differ
in at most one bit of some segment.  So each fingerprint is indexed under each
of its segments with one bit wiped out, 64 entries in all, and fingerprints
that meet under an entry are compared.  A pair is linked only under the first
entry that it shares, so that it isn't found again and again.

Copies share a fingerprint and are linked through it, once.  Entries with many
different fingerprints are cut into blocks, and only links that join what isn't
joined yet come out of a block: no list of all pairs is ever made, and no pair
is left out.

A null or empty text has the fingerprint zero, which is linked like any other.
Repeated rows give repeated results with one component; rows without doc_id are
left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch, documents, partitions, parts, small_batches
from canvass.llm.components import components

U = np.uint64
#: First bit and number of bits of the segments.
SEGMENTS = ((0, 21), (21, 22), (43, 21))
#: Runs up to this length are compared all at once, longer ones one by one.
SHORT_RUN = 16
#: Fingerprints of one entry that a task compares; more are cut into blocks.
BLOCK = 4096
ROWS_PER_TASK = 1_000_000


def shingle_bits(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The fingerprints of a batch of texts."""
    texts = len(offsets) - 1
    starts, ends, first = tb.words(data, offsets)
    counts = np.zeros((texts, 64), np.int64)
    number = np.diff(first)
    shingles = np.where(number >= width, number - width + 1, np.minimum(number, 1))
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
        owner = np.repeat(some, shingles[some])
        last = np.minimum(at + width, first[owner + 1]) - 1
        begin, end = begin[at].tolist(), end[last].tolist()
        view, digest = memoryview(plain.tobytes()), xxhash.xxh64_intdigest
        for low in range(0, len(at), 1 << 16):
            high = min(low + (1 << 16), len(at))
            h = np.fromiter((digest(view[s:e], seed) for s, e in zip(begin[low:high], end[low:high], strict=True)), U, high - low)
            bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
            part = owner[low:high]
            new = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            counts[part[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > shingles[:, None], axis=1).view(U).ravel()


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint long`` (the 64 bits as a signed number)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in parts(batches):
            prints = shingle_bits(*tb.column(batch.column("text")), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint long")


def variants(prints: DataFrame) -> DataFrame:
    """``entry, fingerprint, rep`` for each of the 64 one-bit deletions."""
    shift = "CASE " + " ".join(f"WHEN bit < {lo + n} THEN {lo}" for lo, n in SEGMENTS) + " END"
    mask = "CASE " + " ".join(f"WHEN bit < {lo + n} THEN {(1 << n) - 1}L" for lo, n in SEGMENTS) + " END"
    part = f"shiftrightunsigned(fingerprint, {shift}) & {mask} & ~shiftleft(1L, bit - {shift})"
    return prints.select("fingerprint", "rep", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(F.expr(f"shiftleft(cast(bit AS long), 22) + ({part})").alias("entry"), "fingerprint", "rep")


def linked(a: np.ndarray, b: np.ndarray, bit: np.ndarray, most: int) -> np.ndarray:
    """Which pairs differ in at most ``most`` bits, and share no entry before this one."""
    d = a ^ b
    home = np.full(len(d), -1, np.int64)
    for lo, n in SEGMENTS:
        part = (d >> U(lo)) & U((1 << n) - 1)
        single = (part & (part - (part > 0).astype(U))) == 0
        place = lo + np.where(part > 0, np.bitwise_count(part - (part > 0).astype(U)).astype(np.int64), 0)
        home = np.where((home < 0) & single, place, home)
    return (np.bitwise_count(d) <= most) & (home == bit)


def forest(prints: np.ndarray, reps: np.ndarray, bit: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of one entry as all links between them would."""
    rest, queue = np.arange(len(prints)), []
    a, b = [], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        one = queue.pop()
        hit = linked(np.full(len(rest), prints[one], U), prints[rest], np.full(len(rest), bit), most)
        near = rest[hit]
        if len(near):
            a.append(np.full(len(near), reps[one]))
            b.append(reps[near])
            queue.extend(near.tolist())
            rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def _short(entry, prints, reps, most):
    """All links within the short runs of a sorted table."""
    a, b = [], []
    for step in range(1, SHORT_RUN):
        same = np.flatnonzero(entry[step:] == entry[:-step]) if len(entry) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        ok = same[linked(prints[same], prints[same + step], entry[same] >> 22, most)]
        a.append(reps[ok])
        b.append(reps[ok + step])
    none = np.zeros(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def _runs(most: int):
    """Over a partition sorted by entry: links within each entry's run; the
    rows of a run that is too long come out again with their block."""

    def links(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none], NAMES)

    def sweep(batches):
        held, entry_passed, n_passed = np.zeros((3, 0), np.int64), None, 0

        def passing(rows, offset):
            block = (offset + np.arange(rows.shape[1])) // BLOCK
            none = pa.nulls(rows.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(r) for r in rows), pa.array(block)], NAMES)

        def full(rows):
            """Links of complete runs."""
            entry = rows[0]
            new = np.concatenate([[0], np.flatnonzero(entry[1:] != entry[:-1]) + 1, [len(entry)]])
            size = np.diff(new)
            each = np.repeat(size, size)
            a, b = [], []
            few = rows[:, (each > 1) & (each <= SHORT_RUN)]
            x, y = _short(few[0], few[1].view(U), few[2], most)
            a.append(x), b.append(y)
            for k in np.flatnonzero(size > SHORT_RUN):
                part = rows[:, new[k] : new[k + 1]]
                x, y = forest(part[1].view(U), part[2], int(part[0, 0]) >> 22, most)
                a.append(x), b.append(y)
            return links(np.concatenate(a), np.concatenate(b))

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("entry", "fingerprint", "rep")])
            held = np.ascontiguousarray(np.concatenate([held, rows], axis=1))
            if entry_passed is not None:
                n = int(np.searchsorted(held[0], entry_passed, "right"))
                if n:
                    yield passing(held[:, :n], n_passed)
                    n_passed += n
                held = np.ascontiguousarray(held[:, n:])
                if not held.shape[1]:
                    continue
                entry_passed = None
            open_from = int(np.searchsorted(held[0], held[0, -1], "left")) if held.shape[1] else 0
            if open_from:
                yield full(np.ascontiguousarray(held[:, :open_from]))
                held = np.ascontiguousarray(held[:, open_from:])
            if held.shape[1] > BLOCK:
                entry_passed, n_passed = held[0, 0], held.shape[1]
                yield passing(held, 0)
                held = held[:, :0]
        if held.shape[1]:
            yield full(held)

    return sweep


NAMES = ["a", "b", "entry", "fingerprint", "rep", "block"]
SCHEMA = "a long, b long, entry long, fingerprint long, rep long, block long"


def _pair_of_blocks(most: int):
    def run(key, table):
        prints = np.asarray(table.column("fingerprint").combine_chunks()).astype(np.int64)
        reps = np.asarray(table.column("rep").combine_chunks()).astype(np.int64)
        a, b = forest(prints.view(U), reps, key[0].as_py() >> 22, most)
        return pa.table({"a": a, "b": b})

    return run


def links(prints: DataFrame, scratch: Scratch, most: int = 4) -> DataFrame:
    """Links ``a, b`` between the representatives ``rep`` of different
    fingerprints whose bits differ in at most ``most`` places: enough of them to
    join all that such links would join.  Three segments suit 2 to 5 bits."""
    if not 0 <= most <= 5:
        raise ValueError("three segments leave one with at most one differing bit for up to five bits")
    spark = prints.sparkSession
    small_batches(spark)
    n = partitions(spark, 64 * prints.count(), ROWS_PER_TASK)
    found = scratch.keep(variants(prints).repartition(n, "entry").sortWithinPartitions("entry").mapInArrow(_runs(most), SCHEMA))
    near = found.where("a IS NOT NULL").select("a", "b")
    long = found.where("entry IS NOT NULL").select("entry", "fingerprint", "rep", "block")
    if long.isEmpty():
        return near
    blocks = long.groupBy("entry").agg((F.max("block") + 1).alias("blocks"))
    pairs = long.join(blocks, "entry").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("entry", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "fingerprint", "rep")
    return near.unionByName(pairs.groupBy("entry", "p", "q").applyInArrow(_pair_of_blocks(most), "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, fingerprint long, component_id`` for every document;
    ``component_id`` is the smallest doc_id that links lead to."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, width, seed))
    classes = scratch.keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    found = scratch.keep(components(links(classes, scratch, most), scratch))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
