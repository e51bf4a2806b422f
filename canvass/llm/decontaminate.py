"""Benchmark items in documents, paraphrases included, by latent semantics.

1. Passages of ``PASSAGE`` words, a new one every ``STRIDE`` words, become TF-IDF
   vectors over hashed words; the document frequencies count all passages.
2. A distributed randomised SVD of all (non-overlapping) passages gives the
   latent space: each task multiplies its passages with one shared random
   matrix and back, the sums meet in blocks of features, and the driver
   decomposes a matrix whose size doesn't depend on the corpus.
3. Every passage is compared with every item's passages by cosine.
4. Passages above ``COSINE`` are held against the item word by word: the longest
   common subsequence's share of the item, and the share of its answer, the
   item's last words, that is found.  ``FOUND`` of the item is proof by itself,
   ``LIKELY`` of it together with the answer.

Words are runs of letters, digits and bytes over 127, in lower case.  Null and
empty texts and items match nothing.  Items are sent to the tasks in blocks of
``ITEMS`` items or ``ITEM_BYTES`` bytes, however many there are; documents are read
once for all blocks, and a task holds ``HOLD`` bytes of texts and one block at a
time.  Repeated rows give repeated findings, one for each; rows without doc_id or
item_id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch, documents, parts, small_batches

FEATURES = 1 << 14
RANK, EXTRA = 40, 8
BLOCK_FEATURES = 256
PASSAGE, STRIDE = 48, 16
COSINE = 0.3
FOUND, LIKELY, ANSWER_FOUND = 0.7, 0.5, 0.75
ANSWER = 8  # words
ITEMS, ITEM_BYTES = 5000, 8 << 20
HOLD = 16 << 20
SLOTS = 1 << 11  # places of a word in the table that bounds a common subsequence
BATCH = 128  # texts in a batch: its arrays should fit a core's cache


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and feature of each word, and the texts' word offsets."""
    data = tb.lower(data)
    starts, ends, first = tb.words(data, offsets, tb.NO_LETTER)
    h = tb.word_hashes(data, starts, ends)
    return h, (h >> np.uint64(64 - 14)).astype(np.int64), first


def pieces(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each run of ``size`` words (the last of a text may be
    shorter), and the texts' offsets among the runs."""
    per = -(-np.diff(first) // size)
    bounds = np.concatenate([[0], np.cumsum(per)])
    step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)
    return np.repeat(first[:-1], per) + step * size, bounds


def slots(begin: np.ndarray, end: np.ndarray, f: np.ndarray, width: int) -> np.ndarray:
    """The features of each run of words, filled up to ``width`` with FEATURES,
    which stands for no word."""
    at = begin[:, None] + np.arange(width)
    return np.where(at < end[:, None], f[np.minimum(at, len(f) - 1)], FEATURES)


def with_none(rows: np.ndarray) -> np.ndarray:
    """One row of zeros more, for no word."""
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def gathered(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of places the sum of the rows there."""
    out = np.zeros((len(at), rows.shape[1]), rows.dtype)
    for j in range(at.shape[1]):
        out += rows.take(at[:, j], axis=0)
    return out


def _count(batches):
    total, number = np.zeros(FEATURES, np.int64), 0
    for batch in parts(batches, BATCH):
        _, f, first = tokens(*tb.column(batch.column("text")))
        begin, _ = pieces(first, PASSAGE)
        if len(begin):
            passage = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(f))))
            pair = passage * FEATURES + f
            pair = np.sort(pair.astype(np.int32) if len(begin) * FEATURES < 1 << 31 else pair)
            new = np.append(True, pair[1:] != pair[:-1])
            total += np.bincount(pair[new] % FEATURES, minlength=FEATURES)
            number += len(begin)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], number))], ["feature", "n"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """log(passages / passages with the feature) for each feature: one row a
    feature comes to the driver, a fixed number."""
    rows = texts.mapInArrow(_count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(FEATURES)
    total = 1.0
    for r in rows:
        if r.feature < 0:
            total = max(r.n, 1)
        else:
            n[r.feature] = r.n
    return np.log((total + 1) / (n + 1)).astype(np.float32)


def spread(total: np.ndarray, f: np.ndarray, passage: np.ndarray, z: np.ndarray) -> None:
    """Adds to the row of each feature the rows of the passages that hold it:
    frequent features by one matrix product, of the others first every one's
    first place, then every one's second, and so on."""
    count = np.bincount(f, minlength=len(total))
    often = np.flatnonzero(count > 24)
    number = np.full(len(total), -1)
    number[often] = np.arange(len(often))
    own = number[f]
    dense = own >= 0
    held = np.bincount(own[dense] * len(z) + passage[dense], minlength=len(often) * len(z))
    total[often] += held.reshape(len(often), len(z)).astype(np.float32) @ z
    f, passage = f[~dense], passage[~dense]
    order = np.argsort(f.astype(np.uint16), kind="stable")
    count[often] = 0
    n = count[count > 0]
    turn = np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n)
    again = np.argsort(turn.astype(np.uint8), kind="stable")
    f, passage = f[order][again], passage[order][again]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(turn))])
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        total[f[low:high]] += z.take(passage[low:high], axis=0)


def _multiply(weights, seed: int):
    """This partition's share of A'A times the random matrix, A being the
    passages' normalised TF-IDF vectors."""

    def run(batches):
        idf = weights.value
        omega = np.random.default_rng(seed).standard_normal((FEATURES, RANK + EXTRA)).astype(np.float32)
        scaled = with_none(omega * idf[:, None])
        square = np.append(idf**2, np.float32(0))
        total = np.zeros((FEATURES, RANK + EXTRA), np.float32)
        for batch in parts(batches, BATCH):
            _, f, first = tokens(*tb.column(batch.column("text")))
            begin, _ = pieces(first, PASSAGE)
            ends = np.append(begin[1:], len(f))
            for low in range(0, len(begin), 1024):
                part, stop = begin[low : low + 1024], ends[low : low + 1024]
                own = f[part[0] : stop[-1]]
                z = np.empty((len(part), RANK + EXTRA), np.float32)
                for k in range(0, len(part), 128):
                    each = slots(part[k : k + 128], stop[k : k + 128], f, PASSAGE)
                    z[k : k + 128] = gathered(scaled, each) / (square[each].sum(axis=1) + np.float32(1e-9))[:, None]
                passage = np.repeat(np.arange(len(part)), stop - part)
                spread(total, own, passage, z)
        total *= idf[:, None]
        blocks = [b for b in range(FEATURES // BLOCK_FEATURES) if total[b * BLOCK_FEATURES : (b + 1) * BLOCK_FEATURES].any()]
        values = [total[b * BLOCK_FEATURES : (b + 1) * BLOCK_FEATURES].tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(values, pa.binary())], ["block", "sums"])

    return run


def _sum_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(sums, np.float32).astype(np.float64)
    for block, value in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([value.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])


def latent_space(texts: DataFrame, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """A row for each feature: its weight times its place in the space of the
    largest singular vectors, each on the scale of its singular value."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    schema = "block int, sums binary"
    share = texts.mapInArrow(_multiply(shared, seed), schema)
    # Two rounds: the first in parts of each block's sums, the second over few of them.
    n = FEATURES // BLOCK_FEATURES
    once = share.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).repartition(n, "block", "part").select("block", "sums").mapInArrow(_sum_blocks, schema)
    rows = once.repartition(n, "block").mapInArrow(_sum_blocks, schema).collect()
    y = np.zeros((FEATURES, RANK + EXTRA))
    for r in rows:
        y[r.block * BLOCK_FEATURES : (r.block + 1) * BLOCK_FEATURES] += np.frombuffer(r.sums, np.float32).reshape(BLOCK_FEATURES, -1)
    if not y.any():
        return np.zeros((FEATURES, RANK), np.float32)
    omega = np.random.default_rng(seed).standard_normal((FEATURES, RANK + EXTRA)).astype(np.float32).astype(float)
    shift = 1e-6 * np.linalg.norm(y)
    y += shift * omega
    inner = omega.T @ y
    root = np.linalg.cholesky((inner + inner.T) / 2 + 1e-9 * np.trace(inner) * np.eye(len(inner)))
    left, values, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    # The first direction is what all passages share; it tells none apart.
    return (idf[:, None] * left[:, 1 : RANK + 1] / values[None, 1 : RANK + 1]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def places(a: list[int]) -> dict[int, int]:
    """For each word of ``a`` a bit for each of its places."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def common(a: list[int], b: list[int], where: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a word of bits at a time;
    ``where``: places(a), if known."""
    where = places(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if x in where:
            hit = row & where[x]
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def passages(features: np.ndarray, first: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and direction of each overlapping passage."""
    begin, bounds = pieces(first, STRIDE)
    if not len(begin):
        return begin, begin, np.zeros((0, space.shape[1]), np.float32)
    sums = np.empty((len(begin), space.shape[1]), np.float32)
    ends = np.append(begin[1:], len(features))
    for low in range(0, len(begin), 512):
        sums[low : low + 512] = gathered(space, slots(begin[low : low + 512], ends[low : low + 512], features, STRIDE))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    number = np.diff(bounds)[text]
    place = np.arange(len(begin)) - bounds[text]
    whole = sums.copy()
    for k in range(1, PASSAGE // STRIDE):
        inside = np.flatnonzero(place + k < number)
        whole[inside] += sums[inside + k]
    # A passage that reaches the end of its text holds those that start in it.
    use = (place == 0) | (place + PASSAGE // STRIDE <= number)
    return begin[use], text[use], unit(whole[use])


class Bounds:
    """For passages and items an upper bound of the words that they have in
    common in order: how many of the item's words stand, in any order, within
    the item's margin around the passage."""

    def __init__(self, words: list[list[int]]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.margin = np.maximum(self.size // 2, 4)
        # Items share a table if their margins round up to the same power of two.
        self.kind = np.ceil(np.log2(self.margin)).astype(np.int64) if len(words) else self.size
        flat = np.array([x for w in words for x in w], np.uint64)
        slot = (flat >> np.uint64(20)).astype(np.int64) % SLOTS
        self.row = np.zeros(len(words), np.int64)  # among the items of its kind
        self.slots = {}  # by kind: a row of places for each item, filled up with SLOTS
        start = np.cumsum(self.size) - self.size
        for kind in np.unique(self.kind):
            own = np.flatnonzero(self.kind == kind)
            at = np.arange(self.size[own].max())
            self.row[own] = np.arange(len(own))
            self.slots[kind] = np.where(at < self.size[own, None], slot[np.minimum(start[own, None] + at, len(flat) - 1)], SLOTS)

    def enough(self, h: np.ndarray, begin: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs can share ``LIKELY`` of the item.  Passage ``row`` begins
        at ``begin`` among the words with hashes ``h``; its text reaches from
        ``floor`` to ``ceiling``."""
        out = np.zeros(len(row), bool)
        slot = (h >> np.uint64(20)).astype(np.int64) % SLOTS
        for kind in np.unique(self.kind[item]):
            table = np.zeros((len(begin), SLOTS + 1), np.uint8)
            some = np.flatnonzero(self.kind[item] == kind)
            used = np.unique(row[some])
            margin = 1 << int(kind)
            a = np.maximum(begin[used] - margin, floor[used])
            n = np.minimum(begin[used] + PASSAGE + margin, ceiling[used]) - a
            table[np.repeat(used, n), slot[tb.repeat_ranges(a, n)]] = 1
            flat = table.ravel()
            for part in range(0, len(some), 2048):
                pair = some[part : part + 2048]
                at = self.slots[kind].take(self.row[item[pair]], axis=0)
                at += row[pair, None] * (SLOTS + 1)
                out[pair] = flat.take(at).sum(axis=1, dtype=np.int32) >= LIKELY * self.size[item[pair]]
        return out


def _held(batches):
    """Lists of slices that hold about ``HOLD`` bytes of texts together."""
    group, size = [], 0
    for batch in parts(batches, BATCH):
        group.append(batch)
        size += batch.nbytes
        if size > HOLD:
            yield group
            group, size = [], 0
    if group:
        yield group


class Items:
    """A block of items, ready for the search."""

    def __init__(self, block):
        self.vectors, self.owner, self.words, self.ids = block
        self.bounds = Bounds(self.words)
        self.where = [places(w) for w in self.words]

    def hits(self, h: np.ndarray, f: np.ndarray, first: np.ndarray, directions: np.ndarray) -> list[tuple]:
        """Text, item, shares of the item and its answer, and cosine of all that is found."""
        begin, text, z = passages(f, first, directions)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for low in range(0, len(begin), 1024):
            cosine = z[low : low + 1024] @ self.vectors.T
            row, column = np.nonzero(cosine >= COSINE)
            if not len(row):
                continue
            own = text[low : low + 1024]
            hold = self.bounds.enough(h, begin[low : low + 1024], first[own], first[own + 1], row, self.owner[column])
            for k, j in zip(row[hold].tolist(), column[hold].tolist(), strict=True):
                doc, item = int(text[low + k]), int(self.owner[j])
                own = self.words[item]
                margin = max(len(own) // 2, 4)
                at = int(begin[low + k])
                span = h[max(at - margin, first[doc]) : min(at + PASSAGE + margin, first[doc + 1])].tolist()
                share = common(own, span, self.where[item]) / len(own)
                if share < LIKELY:
                    continue
                answer = own[-ANSWER:]
                said = common(answer, span) / len(answer)
                new = (share, said, float(cosine[k, j]))
                if new > best.get((doc, item), (0.0, 0.0, 0.0)):
                    best[doc, item] = new
        return [(doc, int(self.ids[item]), *v) for (doc, item), v in sorted(best.items()) if v[0] >= FOUND or v[1] >= ANSWER_FOUND]


def _search(space, blocks):
    def run(batches):
        directions, last = with_none(space.value), None
        for group in _held(batches):
            for k, block in enumerate(blocks):
                if last is None or last[0] != k:
                    last = None  # one block at a time
                    last = k, Items(block.value)
                    if len(blocks) > 1 and getattr(block, "_path", None):  # else each block's value would stay
                        block.__dict__.pop("_value", None)
                for batch in group:
                    found = last[1].hits(*tokens(*tb.column(batch.column("text"))), directions)
                    if not found:
                        continue
                    doc, item, share, said, cosine = (np.array(c) for c in zip(*found, strict=True))
                    columns = [np.asarray(batch.column("doc_id"))[doc], item, cosine, share, said]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "item_id", "cosine", "common", "answer"])

    return run


def _blocks(items: DataFrame):
    """The items, a bounded block after the other, in the order of their ids."""
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append(r)
        size += len(r.text)
        if len(block) == ITEMS or size > ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _prepare(rows: list, space: np.ndarray):
    """Directions of the items' passages, the items they belong to, the items' words and ids."""
    h, f, first = tokens(*tb.column(pa.array([r.text for r in rows], pa.large_string())))
    vectors, owner = [], []
    for k in range(len(rows)):
        low, high = int(first[k]), int(first[k + 1])
        for at in range(low, max(high - PASSAGE, low) + 1, STRIDE) if high > low else ():
            vectors.append(space[f[at : min(at + PASSAGE, high)]].sum(axis=0))
            owner.append(k)
    words = [h[first[k] : first[k + 1]].tolist() for k in range(len(rows))]
    vectors = unit(np.array(vectors)) if vectors else np.zeros((0, space.shape[1]))
    return vectors.astype(np.float32), np.array(owner, int), words, np.array([r.item_id for r in rows], np.int64)


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, item_id, cosine, common, answer`` for each document and item
    found in it: cosine of the best passage, shares of the item and of its
    answer that the document has in order."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = documents(docs)
    idf = document_frequencies(texts.select("text"))
    space = latent_space(texts.select("text"), idf)
    shared = spark.sparkContext.broadcast(space)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = [spark.sparkContext.broadcast(_prepare(rows, space)) for rows in _blocks(items)]
    return texts.mapInArrow(_search(shared, blocks), "doc_id long, item_id long, cosine double, common double, answer double")
