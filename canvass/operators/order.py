"""Ranks, percentiles and shortest intervals of groups of any size.

Rows are range-partitioned by group and value and written in that order, so a
group that holds a third of all rows lies in many partitions.  The count of each
group in each partition (a row for each partition and group that meet) gives the
rank with which a partition begins; a row's rank is that plus its place there.  No
group comes together in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import storage


def _sorted(rows: DataFrame, by: list[str], value: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with a value, in order: ``*by, *keep, _value, _part, _at``; and for
    each group and partition where the group begins: ``*by, _part, _first`` (its
    first place), ``_before`` (rows of the group in earlier partitions), ``_n``
    (here) and ``_total``."""
    x = rows.where(F.col(value).isNotNull()).select(*by, *keep, F.col(value).alias("_value"))
    dealt = x.repartitionByRange(*by, "_value").sortWithinPartitions(*by, "_value") if by else x.repartitionByRange("_value").sortWithinPartitions("_value")
    x = storage.kept(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "order")
    counts = x.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    every = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "_n", "_first"))).alias("_all"))
    # A running sum over a group's partitions, of which there are few.
    running = F.aggregate("_all", F.array().cast("array<struct<_part:int,_first:bigint,_before:bigint,_n:bigint>>"), lambda a, p: F.concat(a, F.array(F.struct(p["_part"].alias("_part"), p["_first"].alias("_first"), F.when(F.size(a) == 0, F.lit(0).cast("long")).otherwise(F.element_at(a, -1)["_before"] + F.element_at(a, -1)["_n"]).alias("_before"), p["_n"].alias("_n")))))
    total = F.aggregate("_all", F.lit(0).cast("long"), lambda s, p: s + p["_n"])
    begins = every.select(*by, total.alias("_total"), F.inline(running))
    return x, begins


def _met(x: DataFrame, begins: DataFrame, by: list[str]) -> DataFrame:
    """Rows with where their group begins in their partition; null groups are groups."""
    same = F.col("x._part") == F.col("b._part")
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}"))
    return x.alias("x").join(begins.alias("b"), same)


def ranks(rows: DataFrame, by: list[str], value: str, keep: list[str] = ()) -> DataFrame:
    """``*by, *keep, <value>, rank, total``: ranks from 1 within the group, ties in
    some order, and the group's number of values.  Rows without a value are left out."""
    x, begins = _sorted(rows, by, value, list(keep))
    columns = [F.col(f"x.{c}") for c in [*by, *keep]]
    rank = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return _met(x, begins, by).select(*columns, F.col("_value").alias(value), rank.alias("rank"), F.col("_total").alias("total"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``*by, q``: per group an array of percentiles, interpolated between the two
    values around each.  Groups without a value aren't there."""
    x, begins = _sorted(rows, by, value, [])
    wanted = F.array(*(F.struct(F.lit(i).alias("_i"), (F.lit(float(s)) * (F.col("_total") - 1)).alias("_exact")) for i, s in enumerate(shares)))
    one = begins.withColumn("_w", F.explode(wanted)).select("*", "_w.*").withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_exact"), F.ceil("_exact")))))
    one = one.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    # At most two rows a group and share are looked up, by their places.
    places = one.select(*by, "_i", "_exact", "_rank", (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_at"))
    found = places.join(x.select("_at", "_value"), "_at")
    share = 1 - F.abs(F.col("_exact") - F.col("_rank"))
    each = found.groupBy(*by, "_i").agg(F.sum(F.col("_value") * share).alias("_q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q"))


def shortest_interval(draws: DataFrame, value: str, by: list[str], share: float) -> DataFrame:
    """Per group the shortest interval that holds this share of its draws: of
    equals the lowest.  Each value meets the one so many ranks above it."""
    x = ranks(draws, by, value)
    width = F.floor(F.col("total") * share)
    low = x.select(*by, F.col(value).alias("lo"), (F.col("rank") + width).alias("rank"))
    pairs = low.join(x.select(*by, F.col(value).alias("hi"), "rank"), [*by, "rank"])
    return pairs.groupBy(*by).agg(F.min_by(F.struct("lo", "hi"), F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo")).alias("h")).select(*by, "h.lo", "h.hi")
