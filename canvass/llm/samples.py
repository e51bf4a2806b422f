"""Bounded training samples, the same at every run and input size.

Only documents that are there and have a text can be chosen.  Their ids, labels
and lengths are written as one narrow table.  The number of documents of each
label gives the share of them that is looked at, by a hash of doc_id, so that a
few times as many as are wanted come to the driver, which takes those with the
least hashes: at most so many texts and characters a label.  Every label that a
document has is learned; where there are many, each has fewer texts.  Of a text over
``LONGEST`` characters it takes a part, at a place that follows from doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch

#: Characters that are learned from a text.
LONGEST = 50_000
#: Characters of all texts of the sample, shared out evenly between the labels.
CHARACTERS = 12_000_000
#: Texts of the whole sample at most, and of each label one at least; more
#: labels than this are an error, never left out.
TEXTS, LABELS = 9_600, 9_600
#: So many times the wanted ids are looked at.
SPARE = 3
#: And at least so many, so that by no chance none of a label's falls in the share.
LEAST = 40
HASHES = 1 << 32


def fold(parts: int) -> F.Column:
    """crc32 of the doc_id's decimal digits, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, target: str, parts: int, held_out: int, per_label: int) -> list[tuple[str, int]]:
    """At most ``per_label`` texts of each label of ``target`` (0 and 1) from
    outside the held-out fold: (text, label).  A document with two labels
    counts with the larger; null labels with none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold(parts) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("label"))
    there = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("size"))
    return _texts(docs, there.join(known, "doc_id"), per_label)


def languages(docs: DataFrame, parts: int, held_out: int, per_label: int) -> list[tuple[str, str]]:
    """The same for the language that documents name themselves.  Repeated rows
    that name several count with the last in the alphabet."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(parts) != held_out))
    return _texts(docs, known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"), F.length("text").alias("size")), per_label)


def _texts(docs: DataFrame, known: DataFrame, per_label: int) -> list[tuple[str, object]]:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sample")
    # Repeated rows are one from here on, as far as a task sees them; the rest meet in the counts.
    known = scratch.keep(known.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))))
    often = known.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).limit(LABELS + 1).collect()
    if not often:
        scratch.close()
        return []
    if len(often) > LABELS:
        raise ValueError(f"over {LABELS} labels")
    per_label = max(1, min(per_label, TEXTS // len(often)))
    shares = spark.createDataFrame([(r.label, min(HASHES, max(SPARE * per_label, LEAST) * HASHES // max(r.n, 1) + 1)) for r in often], f"label {dict(known.dtypes)['label']}, upto long")
    near = known.join(F.broadcast(shares), "label").where("hash < upto")
    near = near.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("hash").alias("hash"), F.min("size").alias("size")).collect()
    scratch.close()
    budget, taken, chosen = CHARACTERS // len(often), {}, []
    for r in sorted(near, key=lambda r: (r.hash, r.doc_id)):
        n, chars = taken.get(r.label, (0, 0))
        if n < per_label and chars < budget:
            taken[r.label] = n + 1, chars + min(r.size, LONGEST)
            chosen.append((r.doc_id, r.label))
    picks = spark.createDataFrame(chosen, f"doc_id long, label {dict(known.dtypes)['label']}")
    start = F.when(F.length("text") > LONGEST, 1 + F.pmod(F.xxhash64("doc_id"), F.length("text") - LONGEST)).otherwise(1).cast("int")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample's size is fixed, so it can be broadcast.
    found = texts.join(F.broadcast(picks), "doc_id").select("doc_id", "label", F.substring(F.col("text"), start, F.lit(LONGEST)).alias("text"))
    return [(r.text, r.label) for r in sorted(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect(), key=lambda r: r.doc_id)]
