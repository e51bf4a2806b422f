"""Best-fit packing of token sequences.

``pieces`` cuts every document's ids into pieces of at most ``capacity`` tokens;
``pack`` puts the pieces into as few sequences of that capacity as it can.

Packing is best-fit decreasing in bulk-synchronous steps.  Full pieces fill a
sequence each and those over half the capacity open one each.  The others come in
classes by length, each from half the length of the last.  A step takes what is
unplaced of a class and the gaps that are left:

1. Documents and gaps are range-sorted by size.  A gap with room for several
   documents of the class offers as many equal slots.
2. Each range is swept once, upwards: a slot takes the longest document before it
   that has none, so each document gets the smallest slot that is left for it, its
   successor.  What a range leaves over, documents without a slot and slots
   without a document, is numbered.
3. The ranges' counts of these (two numbers a range) tell which number of one range
   meets which of a later one; they meet by an equi-join on the number of the match.
   So no slot is given twice, and no document has two.
4. Gaps shrink by what they took.  Where hardly anything fitted, the longest of the
   unplaced documents open as many sequences as their lengths fill at least.

Steps repeat until nothing of the class is left: some ten to forty in all, each of
two narrow shuffles, each written in the shared folder.  Only counts of ranges and
of classes come to the driver.

Every row is packed, repeated ones each for themselves; a null text is an empty
one, which has the final id alone; rows without doc_id are left out; other columns
are ignored.  Ties go to the row that was written first.  An empty table gives an
empty table.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, documents, parts, small_batches
from canvass.llm.words_bpe import encoder

#: Rows of a range that one task sweeps.
RANGE_ROWS = 200_000
#: The last class: lengths up to this share of the capacity.
SMALLEST = 128
#: A step that places a smaller share than this opens sequences.
FEW = 0.2
DOC, GAP = 0, 1
SWEPT = "doc long, length long, seq long, spare long, part int, number long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, last: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids, to
    which the id ``last`` is added.  ``tokenizer``: the path of a tokenizer file
    (under 2 MB, a fixed size), which the driver reads and broadcasts."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    end = np.array([last], "<u4").tobytes()

    def run(batches):
        encode = encoder(source.value).encode
        for batch in parts(batches):
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for piece, low in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[low : low + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, low // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _sweep(batches):
    """One range, upwards: pairs of a document and a slot, then what is left over,
    each kind numbered from the smallest."""
    part = TaskContext.get().partitionId()
    open_docs: list[tuple[int, int]] = []
    gaps = 0

    def rows(doc, length, seq, spare, number):
        columns = [pa.array(c, pa.int64()) for c in (doc, length, seq, spare)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(doc), pa.int32()), pa.array(number, pa.int64())], ["doc", "length", "seq", "spare", "part", "number"])

    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for key, kind, size in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "size")), strict=True):
            if kind == DOC:
                open_docs.append((key, size))
            elif open_docs:
                doc, length = open_docs.pop()
                for column, value in zip(out, (doc, length, key, size - length, None), strict=True):
                    column.append(value)
            else:
                for column, value in zip(out, (None, None, key, size, gaps), strict=True):
                    column.append(value)
                gaps += 1
        yield rows(*out)
    if open_docs:
        doc, length = zip(*open_docs, strict=True)
        yield rows(doc, length, [None] * len(doc), [None] * len(doc), range(len(doc)))


def matches(left: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """``left``: of each range its number, and how many slots and documents it
    left over.  Returns which numbers meet, (range of the documents, the highest
    of their numbers, range of the slots, the lowest of their numbers, how many:
    downwards there, upwards here), and how many documents of each range meet none
    (the lowest numbers).  The nearest range below that has documents comes first."""
    found, waiting = [], []
    for part, slots, docs in sorted(left):
        taken = 0
        while taken < slots and waiting:
            source, count = waiting.pop()
            n = min(count, slots - taken)
            found.append((source, count - 1, part, taken, n))
            taken += n
            if n < count:
                waiting.append((source, count - n))
        if docs:
            waiting.append((part, docs))
    return found, dict(waiting)


def longest(none: dict[int, int], want: int) -> dict[int, int]:
    """How many documents of each range stay below the ``want`` longest of all."""
    left = {}
    for part in sorted(none, reverse=True):
        taken = min(want, none[part])
        left[part] = none[part] - taken
        want -= taken
    return left


class _Packer:
    def __init__(self, spark: SparkSession, scratch: Scratch, capacity: int):
        self.spark, self.scratch, self.capacity = spark, scratch, capacity
        self.placed: list[DataFrame] = []
        self.gaps = self.table([], seq=pa.int64(), size=pa.int64())

    def table(self, rows: list[tuple[int, ...]], **kinds: pa.DataType) -> DataFrame:
        """A small table that needs no job."""
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return self.spark.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}))

    def place(self, pairs: DataFrame, opened: DataFrame) -> None:
        """``doc, length, seq``: this step's places, and the documents (``doc,
        length``) that open a sequence, which has their key.  Gaps shrink or begin."""
        begun = opened.withColumn("seq", F.col("doc"))
        placed = self.scratch.keep(pairs.unionByName(begun).withColumn("step", F.lit(len(self.placed))))
        self.placed.append(placed)
        size = F.when(F.col("doc") == F.col("seq"), self.capacity).otherwise(0) - F.col("length")
        changes = placed.select("seq", size.cast("long").alias("size"))
        before = self.gaps
        self.gaps = self.scratch.keep(before.unionByName(changes).groupBy("seq").agg(F.sum("size").alias("size")).where("size > 0"))
        if hasattr(before, "_scratch_path"):
            self.scratch.drop(before)

    def step(self, docs: DataFrame, n: int, least: int, most: int) -> tuple[DataFrame, int, int]:
        """One sweep over ``n`` documents (``doc, length``) of ``least`` to ``most``
        tokens.  Returns those that stay unplaced, how
        many these are, and a length that none of them is over."""
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / most), F.lit(n))).cast("int")
        wide = self.gaps.where(F.col("size") >= least).select(F.col("seq").alias("key"), F.lit(GAP).alias("kind"), F.floor(F.col("size") / slots).alias("size"), F.explode(F.sequence(F.lit(1), slots)).alias("slot"))
        items = docs.select(F.col("doc").alias("key"), F.lit(DOC).alias("kind"), F.col("length").alias("size"), F.lit(0).alias("slot")).unionByName(wide)
        order, ranges = ["size", "kind", "key", "slot"], -(-2 * n // RANGE_ROWS)
        dealt = items.repartitionByRange(ranges, *order) if ranges > 1 else items.repartition(1)
        swept = self.scratch.keep(dealt.sortWithinPartitions(*order).select("key", "kind", "size").mapInArrow(_sweep, SWEPT))
        over = swept.where("number IS NOT NULL").groupBy("part").agg(F.count("seq").alias("slots"), F.count("doc").alias("docs"), F.sum("length").alias("length"), F.max("length").alias("most")).collect()
        meet, none = matches([(r.part, r.slots, r.docs) for r in over])
        left = swept.where("number IS NOT NULL")
        pairs = swept.where("number IS NULL").select("doc", "length", "seq")
        if meet:
            # At most two rows a range.
            table, base = [], 0
            for source, high, part, low, count in meet:
                table.append((source, high - count + 1, high, part, low, low + count - 1, base))
                base += count
            known = F.broadcast(self.table(table, d_part=pa.int32(), d_low=pa.int64(), d_high=pa.int64(), s_part=pa.int32(), s_low=pa.int64(), s_high=pa.int64(), base=pa.int64()))
            of_docs = left.where("doc IS NOT NULL").join(known, (F.col("part") == F.col("d_part")) & F.col("number").between(F.col("d_low"), F.col("d_high"))).select("doc", "length", (F.col("base") + F.col("d_high") - F.col("number")).alias("match"))
            of_slots = left.where("doc IS NULL").join(known, (F.col("part") == F.col("s_part")) & F.col("number").between(F.col("s_low"), F.col("s_high"))).select("seq", (F.col("base") + F.col("number") - F.col("s_low")).alias("match"))
            pairs = pairs.unionByName(of_docs.join(of_slots, "match").select("doc", "length", "seq"))
        unplaced = sum(none.values())
        stay = none
        if n - unplaced < FEW * n:
            tokens = sum(none.get(r.part, 0) * r.length / r.docs for r in over if r.docs)
            stay = longest(none, max(1, math.ceil(tokens / self.capacity)))
        known = F.broadcast(self.table([(p, stay[p], c) for p, c in none.items()], part=pa.int32(), stay=pa.int64(), none=pa.int64()))
        rest = left.where("doc IS NOT NULL").join(known, "part").where("number < none")
        self.place(pairs, rest.where("number >= stay").select("doc", "length"))
        most = max((r.most for r in over if stay.get(r.part)), default=most)
        return rest.where("number < stay").select("doc", "length"), sum(stay.values()), most


def pack(items: DataFrame, capacity: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """``items``: with a ``length`` from 1 to ``capacity``.  Returns their columns
    with ``sequence_id`` and ``offset``: sequences are filled from 0 without gaps."""
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    items = scratch.keep(items.withColumn("_key", F.monotonically_increasing_id()))
    docs = items.select(F.col("_key").alias("doc"), "length")
    packer = _Packer(spark, scratch, capacity)
    whole = F.col("length") * 2 > capacity
    packer.place(docs.where("false").withColumn("seq", F.col("doc")), docs.where(whole))
    lows = [capacity // 2]
    while lows[-1] > max(1, capacity // SMALLEST):
        lows.append(lows[-1] // 2)
    lows[-1] = 0
    in_class = [(F.col("length") <= high) & (F.col("length") > low) for high, low in itertools.pairwise(lows)]
    found = docs.agg(*[f for c in in_class for f in (F.count_if(c), F.max(F.when(c, F.col("length"))))]).first() if in_class else []
    for low, which, n, high in zip(lows[1:], in_class, found[::2], found[1::2], strict=True):
        rest = docs.where(which)
        while n:
            rest, n, high = packer.step(rest, n, low + 1, high)
    placed = spark.read.schema(packer.placed[0].schema).parquet(*(p._scratch_path for p in packer.placed))
    # A sequence has at most as many pieces as tokens, so no window outgrows a task.
    before = Window.partitionBy("seq").orderBy("step", "doc").rowsBetween(Window.unboundedPreceding, -1)
    where = placed.select(F.col("doc").alias("_key"), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return items.join(where, "_key").drop("_key")
