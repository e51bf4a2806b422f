"""Texts that contain other texts, joined by the rarest piece.

A text that contains another contains all its pieces of six letters (fewer for
shorter texts).  Each short text is looked up by the one of its pieces that the
fewest long texts of its group have, as counted; one of whose pieces no long text
has is looked up nowhere.  So a common street or house number draws nothing that a
rarer piece of the text wouldn't.  Texts are made distinct before any of this, and
a piece that is common all the same is dealt out over so many salted parts that
each has ``HOT`` long texts or so.

A text has as many rows of pieces as letters, which Spark's estimates don't know:
the joins of pieces are merges by a hint, lest a side be collected for a broadcast.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece, the most that a short text has; long texts of a piece that one part holds.
SIZES, HOT = (6, 3, 2, 1), 10_000


def _grams(c: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(none)


def asked(c: Column) -> Column:
    """The different pieces of a short text."""
    out = _grams(c, SIZES[-1])
    for n in reversed(SIZES[:-1]):
        out = F.when(F.length(c) >= n, _grams(c, n)).otherwise(out)
    return F.array_distinct(out)


def offered(c: Column, least: Column) -> Column:
    """The different pieces of a long text, small ones where a short text may ask
    for them: ``least`` is the length of the shortest of the group."""
    small = (F.when(least < larger, _grams(c, n)).otherwise(F.array().cast("array<string>")) for larger, n in itertools.pairwise(SIZES))
    return F.array_distinct(F.concat(_grams(c, SIZES[0]), *small))


def met(short: DataFrame, long: DataFrame, on: list[str]) -> DataFrame:
    """``*on, short, long``: distinct texts that agree in ``on`` and share the short
    one's rarest piece.  ``short`` and ``long``: ``*on`` and the text so named."""
    short = short.where("short <> ''").join(long.select(*on).distinct(), on, "left_semi").distinct()
    groups = short.groupBy(*on).agg(F.min(F.length("short")).alias("least"))
    long = long.distinct().join(groups, on)
    by = [*on, "piece"]
    pieces = short.select(*on, "short", F.explode(asked(F.col("short"))).alias("piece"))
    have = long.select(*on, "long", F.explode(offered(F.col("long"), F.col("least"))).alias("piece"))
    counts = have.hint("merge").join(pieces.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count("*").alias("n"))
    # Pieces that no long text has fall out of this join, and so the texts that ask for them.
    found = pieces.hint("merge").join(counts, by).groupBy(*on, "short").agg(F.count("*").alias("found"), F.min_by(F.struct("piece", "n"), F.struct("n", "piece")).alias("rarest"))
    found = found.where(F.col("found") == F.size(asked(F.col("short"))))
    parts = lambda n: F.ceil(n / HOT)
    left = found.select(*on, "short", F.col("rarest.piece").alias("piece"), F.explode(F.sequence(F.lit(1).cast("long"), parts(F.col("rarest.n")))).alias("part"))
    right = have.hint("merge").join(counts, by).select(*by, "long", (F.pmod(F.xxhash64("long"), parts(F.col("n"))) + 1).alias("part"))
    return left.hint("merge").join(right, [*by, "part"]).select(*on, "short", "long")


def containing(short: DataFrame, long: DataFrame, on: list[str]) -> DataFrame:
    """``*on, short, long``: every distinct pair of texts that agree in ``on`` and
    of which ``long`` contains ``short``.  Blank and null texts, and rows with a
    null in ``on``, meet none."""
    return met(short, long, on).where(F.col("long").contains(F.col("short")))


def either(own: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``*on, own, other``: the same for pairs one of whose texts contains the
    other.  Rows whose ``around`` is false look for longer texts alone."""
    side = lambda rows, text, name, k: rows.select(*on, F.lit(k).alias("around"), F.col(text).alias(name))
    back_own, back_other = own.where("around"), other.where("around")
    short = side(own, "own", "short", False).unionByName(side(back_other, "other", "short", True))
    long = side(other, "other", "long", False).unionByName(side(back_own, "own", "long", True))
    pairs = containing(short, long, [*on, "around"]).where("NOT around OR short <> long")
    text = lambda k: F.when(F.col("around") == k, F.col("long")).otherwise(F.col("short"))
    return pairs.select(*on, text(True).alias("own"), text(False).alias("other"))
