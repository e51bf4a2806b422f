"""Statistics over grouped rows: sufficient statistics by Spark, closed forms on
the few numbers that come of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300  # continued fraction
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def beta_i(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + an * d) or 1e-300)
            c = (1 + an / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square(table: list[list[float]]) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p-value of a contingency table, with
    Yates's correction for two by two."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    total = sum(rows)
    yates = 0.5 if len(rows) == len(cols) == 2 else 0.0
    value = 0.0
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            e = r * c / total
            gap = abs(table[i][j] - e)
            value += (gap - min(yates, gap)) ** 2 / e
    df = (len(rows) - 1) * (len(cols) - 1)
    return value, df, log_gamma_q(df / 2, value / 2)


def t_test(n1: float, mean1: float, var1: float, n2: float, mean2: float, var2: float) -> tuple[float, float]:
    """t and two-sided p of two samples with equal variance."""
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * var1 + (n2 - 1) * var2) / df
    t = (mean1 - mean2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return t, beta_i(df / (df + t * t), df / 2, 0.5)


def chi_square_of(rows: DataFrame, group: str, outcome: str) -> DataFrame:
    """One row: chi2, df, and the number of rows; for a table of any size, with
    Yates's correction for two by two.  All in groupings."""
    cells = rows.groupBy(group, outcome).agg(F.count("*").alias("o"))
    groups, outcomes = cells.select(group).distinct(), cells.select(outcome).distinct()
    # The spine has a row for each cell, not for each row of the input.
    full = groups.join(outcomes, F.lit(True)).join(cells, [group, outcome], "left").fillna(0, ["o"])
    total, by = W.partitionBy(), W.partitionBy(group)
    e = F.sum("o").over(by) * F.sum("o").over(W.partitionBy(outcome)) / F.sum("o").over(total)
    sizes = full.withColumns({"e": e, "r": F.size(F.collect_set(group).over(total)), "c": F.size(F.collect_set(outcome).over(total))})
    gap = F.abs(F.col("o") - F.col("e"))
    yates = F.when((F.col("r") == 2) & (F.col("c") == 2), F.least(F.lit(0.5), gap)).otherwise(0.0)
    one = sizes.withColumn("x", F.pow(gap - yates, 2) / F.col("e"))
    return one.agg(F.sum("x").alias("chi2"), ((F.max("r") - 1) * (F.max("c") - 1)).cast("int").alias("df"), F.sum("o").cast("long").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings."""
    two = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("total"))
    rest = [cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name)) for k, name in ((a, "i"), (b, "j"))]
    one = both.join(rest[0], F.lit(True)).join(rest[1], F.lit(True))
    expected = F.col("i") * F.col("j") / two(F.col("total"))
    return one.select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected)).alias("ari"))


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def r_hat(draws: DataFrame, value: str, chain: str, by: list[str]) -> DataFrame:
    """Per group the potential scale reduction over its chains, and their number."""
    per = draws.groupBy(*by, chain).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    out = per.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"), F.count("*").alias("chains"))
    return out.select(*by, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("r_hat"), "chains")


def bic(log_likelihood: float, k: int, d: int, n: int) -> tuple[float, float]:
    """BIC and AIC of a mixture of k full Gaussians in d dimensions."""
    p = k * d + k * d * (d + 1) // 2 + k - 1
    return p * math.log(n) - 2 * log_likelihood, 2 * p - 2 * log_likelihood


def ranked(models: DataFrame, score: str) -> DataFrame:
    """Adds ``rank``, 1 for the highest score and the mean rank for equals, and
    ``diff``, how far a model is behind the best.  Models are few: one task."""
    by = W.orderBy(F.desc(score))
    mean = F.rank().over(by) + (F.count("*").over(W.partitionBy(score)) - 1) / 2
    return models.withColumns({"rank": mean, "diff": F.max(score).over(W.partitionBy()) - F.col(score)})


def calibration(rows: DataFrame, p: str, y: str, groups: list[str]) -> DataFrame:
    """Per group: n, share right at 0.5, mean prediction, share observed.  Rows
    without a prediction don't count."""
    right = ((F.col(p) > 0.5) == F.col(y)).cast("int")
    return rows.where(F.col(p).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(p), 6).alias("mean_predicted"), F.round(F.avg(F.col(y).cast("int")), 6).alias("observed"))
