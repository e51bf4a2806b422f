"""Upserts as pure functions of old and new rows: Parquet has no MERGE, so the
result replaces the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by ``order``; new rows win ties."""
    rest = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *rest).withColumn("_side", F.lit(0)).unionByName(new.select(*keys, *rest).withColumn("_side", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_side"))).alias("r"))
    return last.select(*keys, "r.*")


def merge_flags(old: DataFrame, new: DataFrame, keys: list[str], flags: list[str], order: str, seen: Observation | None = None) -> DataFrame:
    """Flags only rise (any true); other columns come from the last row.  The
    order of arrival and repeats make no difference.  ``seen`` observes how many
    keys of ``new`` were inserted, updated and found unchanged, as the result is
    written, without another pass."""
    rest = [c for c in old.columns if c not in keys and c not in flags]
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    own = F.struct(*flags, *rest)
    extra = [] if seen is None else [F.max(F.when(F.col("_side") == 0, own)).alias("_old"), F.max("_side").alias("_new")]
    out = both.groupBy(*keys).agg(*(F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags), F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_side"))).alias("r"), *extra)
    if seen is None:
        return out.select(*keys, *flags, "r.*")
    out = out.select(*keys, *flags, "r.*", "_old", "_new")
    known, same, came = F.col("_old").isNotNull(), F.col("_old").eqNullSafe(own), F.col("_new") == 1
    numbers = {"inserted": ~known, "updated": known & came & ~same, "unchanged": known & came & same}
    return out.observe(seen, *(F.count_if(c).alias(n) for n, c in numbers.items())).drop("_old", "_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new rows whose key is new."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def add_to_set(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Per key the sorted union of both sides' arrays."""
    both = old.select(key, column).unionByName(new.select(key, column))
    return both.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column))


def counters(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys of ``new`` a merge inserts, updates (a column
    differs; null equals null) and finds unchanged.  Keys are unique in each."""
    rest = [c for c in new.columns if c not in keys]
    both = new.select(*keys, F.struct(*rest).alias("new")).join(old.select(*keys, F.struct(*rest).alias("old")), keys, "left")
    same = F.col("new").eqNullSafe(F.col("old"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(count(F.col("old").isNull()).alias("inserted"), count(F.col("old").isNotNull() & ~same).alias("updated"), count(F.col("old").isNotNull() & same).alias("unchanged"))
