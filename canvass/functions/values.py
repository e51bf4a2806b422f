"""Numbers, dates and rules, as column expressions.  Missing values have one
form behind the loaders: null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The channels.
CHANNELS = ["email", "text_morning", "text_evening", "mailer", "letter"]


def number(c: Column) -> Column:
    """Null for null, NaN and the sentinel -1."""
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (c == -1), None).otherwise(c)


def text(c: Column) -> Column:
    """Null for null, blanks and the sentinel NA."""
    return F.when(F.trim(c).isin("", "NA", "nan", "NaN"), None).otherwise(c)


def currency(c: Column, default: float | None = None) -> Column:
    """'$1,234.50' as a number; what isn't one becomes ``default``."""
    value = F.regexp_replace(c, "[$,]", "").try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def timestamp(c: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss GMT-0000' or ISO 8601, else null; without a zone."""
    plain = F.regexp_replace(F.regexp_replace(c, r" GMT.*$", ""), "T", " ")
    return F.substring(plain, 1, 19).try_cast("timestamp_ntz")


def date_in_name(c: Column, strict: bool = True) -> Column:
    """The date of _YYYYMMDD in a campaign's name."""
    digits = F.regexp_extract(c, r"_(\d{8})(?:_|$)" if strict else r"(\d{8})", 1)
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return iso.try_cast("date")


def rate(a: Column, n: Column, scale: float = 1.0) -> Column:
    """a / n * scale, and 0 where n is 0 or null."""
    return F.when(n > 0, a / n * scale).otherwise(0.0)


def status(channel: Column, strong: Column, weak: Column) -> Column:
    """Unified status: engaged, received or no_engagement.  ``strong`` is a
    click, reply or response, ``weak`` an opening, delivery or reading."""
    known = channel.isin(CHANNELS)
    return F.when(known & F.coalesce(strong, F.lit(False)), "engaged").when(known & F.coalesce(weak, F.lit(False)), "received").otherwise("no_engagement")


def count_where(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def house_age(c: Column, year: int) -> Column:
    """struct<year_built, house_age> from a number that is either."""
    c = number(c)
    return F.struct(F.when(c > 1800, c).otherwise(year - c).cast("int").alias("year_built"), F.when(c > 1800, year - c).otherwise(c).cast("int").alias("house_age"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def burden_percent(c: Column) -> Column:
    """Energy burden in percent; fractions up to 1 are converted."""
    return F.when(c <= 1, c * 100).otherwise(c)


def age_bracket(c: Column) -> Column:
    n = number(c).cast("int")
    return F.when(n.isNotNull(), F.format_string("%d-%d", n, n + 1))


def flag(c: Column, yes: str, no: str) -> Column:
    return F.when(c == yes, True).when(c == no, False)


def silhouette_label(c: Column) -> Column:
    return F.when(c > 0.7, "Strong").when(c > 0.5, "Reasonable").when(c > 0.25, "Weak").otherwise("Poor")


def stability_label(c: Column) -> Column:
    return F.when(c > 0.85, "Highly Stable").when(c > 0.70, "Stable").when(c > 0.50, "Moderately Stable").otherwise("Unstable")


def ratio_text(a: Column, b: Column) -> Column:
    return F.concat_ws("/", a.cast("string"), b.cast("string"))


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def percent_text(c: Column) -> Column:
    """Three places; ``c`` is in percent already."""
    return F.format_string("%.3f%%", c.cast("double"))


def stamps(rows, *names: str):
    """Adds columns with the time of the query, one time for all rows."""
    return rows.withColumns({n: F.current_timestamp() for n in names})
