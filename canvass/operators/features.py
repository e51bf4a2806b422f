"""Feature matrices: imputation, scaling, coding, selection and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.operators import order


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the one row of an aggregate."""
    return rows.join(F.broadcast(one), F.lit(True))


def impute_median(rows: DataFrame, columns: list[str], fallback: float = 0.0, indicator: bool = True) -> DataFrame:
    """Missing values become the exact median (``fallback`` if all are missing),
    with a ``<column>_missing`` flag."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_x")) for c in columns))))
    found = order.percentiles(long, ["_name"], "_x", [0.5])
    medians = found.agg(*(F.coalesce(F.max(F.when(F.col("_name") == c, F.col("q")[0])), F.lit(fallback)).alias(f"_m_{c}") for c in columns))
    out = _beside(rows, medians)
    if indicator:
        out = out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))


def scaling(rows: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """One row of means and deviations, to keep and apply elsewhere."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", sd))))


def scale(rows: DataFrame, columns: list[str], parameters: DataFrame | None = None, sample: bool = False) -> DataFrame:
    """``<column>_scaled``; 0 where the deviation is 0."""
    out = _beside(rows, scaling(rows, columns, sample) if parameters is None else parameters)
    z = {f"{c}_scaled": F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(z).drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def codes(rows: DataFrame, column: str, first_seen: str | None = None) -> DataFrame:
    """``<column>_code``: 0, 1, ... by name, or by the least ``first_seen``; -1
    for null.  The codes are worked out over the different values alone."""
    values = rows.where(F.col(column).isNotNull()).groupBy(column).agg((F.min(first_seen) if first_seen else F.first(F.lit(0))).alias("_seen"))
    key = F.struct("_seen", column) if first_seen else F.struct(column)
    ranked = order.ranks(values.withColumn("_key", key), [], "_key", [column]).select(F.col(column).alias("_v"), (F.col("rank") - 1).cast("int").alias("_code"))
    return rows.join(ranked, F.col(column) == F.col("_v"), "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(-1))).drop("_v", "_code")


def select_spread(stats: DataFrame, kind: str, score: str, key: str, extra_score: str, wanted: int) -> DataFrame:
    """Of every kind the lowest, middle and highest by score, then the best of
    the rest until there are ``wanted``."""
    by = W.partitionBy(kind)
    x = stats.withColumns({"_k": F.row_number().over(by.orderBy(score, key)) - 1, "_n": F.count("*").over(by)})
    chosen = x.where((F.col("_n") < 3) | F.col("_k").isin(0) | (F.col("_k") == F.floor(F.col("_n") / 2)) | (F.col("_k") == F.col("_n") - 1)).drop("_k", "_n")
    rest = stats.join(chosen.select(key), key, "left_anti").select(*stats.columns).orderBy(F.desc_nulls_last(extra_score), key).limit(wanted)
    return chosen.withColumn("_r", F.lit(0)).unionByName(rest.withColumn("_r", F.lit(1))).orderBy("_r", F.desc_nulls_last(extra_score), key).limit(wanted).drop("_r")


def split(rows: DataFrame, group: str, key: str, share: float, order) -> DataFrame:
    """``validation``: of each group floor(n * share) rows, one at least, the
    first by ``order`` (a hash of the key)."""
    by = W.partitionBy(group)
    n = F.count("*").over(by)
    take = F.greatest(F.lit(1), F.floor(n * share))
    return rows.withColumn("validation", F.row_number().over(by.orderBy(order, key)) <= take)


SPECS = {"baseline": ["income"], "energy_burden": ["income", "burden"], "demographics": ["income", "burden", "age"], "property": ["income", "burden", "age", "area"]}


def matrix(rows: DataFrame, spec: str, outcome: str) -> DataFrame:
    """The columns of a model, rows with all of them and the outcome."""
    columns = SPECS[spec]
    return rows.select(outcome, *columns).dropna()


def columns_like(rows: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    """Names of the columns with this beginning and end, in their order."""
    return [c for c in rows.columns if c.startswith(prefix) and c.endswith(suffix)]


def inverted(names: dict) -> Column:
    """A map from each name to its index; of equal names the last index."""
    back = {name: index for index, name in names.items()}
    return F.create_map(*(F.lit(x) for pair in back.items() for x in pair))
