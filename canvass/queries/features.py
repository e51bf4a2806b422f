"""Feature matrices and what goes into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import values as V
from canvass.operators import features as X
from canvass.operators import rollups
from canvass.sources.domain import EXPOSURES, PARTICIPANTS, exposures, participants, table


def median_impute(spark, sf):
    p = X.impute_median(participants(spark, sf).select("participant_id", "income"), ["income"])
    return p.select("participant_id", F.round("income", 4).alias("income"), "income_missing")


MEDIAN = f"WITH {PARTICIPANTS} SELECT participant_id, round(coalesce(income, (SELECT median(income) FROM participants)), 4) AS income, CAST(income IS NULL AS INTEGER) AS income_missing FROM participants"


def _z(spark, sf, sample):
    p = X.scale(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], sample=sample)
    return p.select("c_custkey", F.round("c_acctbal_scaled", 6).alias("z"))


def zscore_pop(spark, sf):
    return _z(spark, sf, False)


def zscore_sample(spark, sf):
    return _z(spark, sf, True)


_Z = "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT {f}(c_acctbal) FROM customer), 6) AS z FROM customer"


def scale_with_stored(spark, sf):
    """Validation rows on the training rows' scale."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    train, rest = c.where("c_custkey % 5 <> 0"), c.where("c_custkey % 5 = 0")
    return X.scale(rest, ["c_acctbal"], X.scaling(train, ["c_acctbal"])).select("c_custkey", F.round("c_acctbal_scaled", 6).alias("z"))


STORED = "WITH t AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 5 <> 0) SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, t WHERE c_custkey % 5 = 0"


def category_codes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("segment"))
    c = X.codes(c.withColumn("seen", F.col("segment")), "segment")
    return X.codes(c, "seen", "c_custkey").select("c_custkey", "segment_code", F.col("seen_code").alias("seen_code"))


CODES = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment FROM customer), v AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS a, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS b FROM c WHERE segment IS NOT NULL GROUP BY segment)
SELECT c_custkey, CAST(coalesce(a, -1) AS INTEGER) AS segment_code, CAST(coalesce(b, -1) AS INTEGER) AS seen_code FROM c LEFT JOIN v USING (segment)"""


def stratified_selection(spark, sf):
    s = rollups.campaign_statistics(exposures(spark, sf)).where("total_sent >= 100").withColumn("kind", (F.col("campaign_id") % 4).cast("int"))
    return X.select_spread(s.select("campaign_id", "kind", "receive_rate", "engage_rate"), "kind", "receive_rate", "campaign_id", "engage_rate", 16)


SELECTION = f"""WITH {EXPOSURES}, s AS (SELECT campaign_id, CAST(campaign_id % 4 AS INTEGER) AS kind, round(count(*) FILTER (WHERE status IN ('received','engaged')) / CAST(count(*) AS DOUBLE), 6) AS receive_rate, round(count(*) FILTER (WHERE status = 'engaged') / CAST(count(*) AS DOUBLE), 6) AS engage_rate FROM exposures GROUP BY 1 HAVING count(*) >= 100),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY receive_rate, campaign_id) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM s),
c AS (SELECT campaign_id, kind, receive_rate, engage_rate, 0 AS r FROM k WHERE n < 3 OR k = 0 OR k = n // 2 OR k = n - 1)
SELECT campaign_id, kind, receive_rate, engage_rate FROM (SELECT * FROM c UNION ALL SELECT campaign_id, kind, receive_rate, engage_rate, 1 FROM s WHERE campaign_id NOT IN (SELECT campaign_id FROM c)) ORDER BY r, engage_rate DESC, campaign_id LIMIT 16"""


def stratified_split(spark, sf):
    """A fifth of each campaign's lines, chosen by an arithmetic hash."""
    t = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    s = X.split(t.distinct(), "l_suppkey", "line", 0.2, F.col("line") * 7919 % 10007)
    return s.groupBy("l_suppkey").agg(V.count_where(F.col("validation")).alias("validation"), F.count("*").alias("n"), F.sum(F.when(F.col("validation"), F.col("line"))).alias("checksum"))


SPLIT = """WITH t AS (SELECT DISTINCT l_suppkey, l_orderkey * 10 + l_linenumber AS line FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY line * 7919 % 10007, line) <= greatest(1, floor(count(*) OVER (PARTITION BY l_suppkey) * 0.2)) AS v FROM t)
SELECT l_suppkey, count(*) FILTER (WHERE v) AS validation, count(*) AS n, CAST(sum(line) FILTER (WHERE v) AS BIGINT) AS checksum FROM s GROUP BY 1"""


def fill_defaults(spark, sf):
    """Participants without exposures get zeros, without segment 'Unknown'."""
    n = table(spark, sf, "orders").where("o_totalprice > 250000").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").fillna(0, ["n", "mean"]).fillna("Unknown", ["segment"])


FILL = """WITH n AS (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, 'Unknown') AS segment, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM customer LEFT JOIN n ON c_custkey = o_custkey"""


def county_summary(spark, sf):
    p = participants(spark, sf)
    e = exposures(spark, sf).groupBy("participant_id").agg(F.max(F.col("clicked").cast("int")).alias("clicked"))
    g = p.join(e, "participant_id").groupBy("county").agg(F.count("*").alias("n"), F.avg("income").alias("income"), F.sum("clicked").alias("clicks"), F.avg("clicked").alias("rate"))
    return g.select("county", "n", F.round("income", 6).alias("income"), "clicks", F.round("rate", 6).alias("rate"))


COUNTY = f"""WITH {EXPOSURES}, {PARTICIPANTS}, e AS (SELECT participant_id, max(CAST(clicked AS INTEGER)) AS clicked FROM exposures GROUP BY 1)
SELECT county, count(*) AS n, round(avg(income), 6) AS income, CAST(sum(clicked) AS BIGINT) AS clicks, round(avg(clicked), 6) AS rate FROM participants JOIN e USING (participant_id) GROUP BY county"""


def variable_summary(spark, sf):
    """A row for each variable: mean, population deviation, least, greatest, number."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    t = table(spark, sf, "lineitem").select(*names).unpivot([], names, "variable", "value")
    return t.groupBy("variable").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


VARIABLES = """SELECT variable, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd, min(value) AS least, max(value) AS most, count(value) AS n FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON COLUMNS(*) INTO NAME variable VALUE value) GROUP BY 1"""


def feature_matrix(spark, sf):
    """Participants with their exposure features; what the rolls-up recompute
    keeps the suffix _exp."""
    e = rollups.participant_rollup(exposures(spark, sf)).select("participant_id", "campaign_count", "email_count", "engage_rate", F.col("ever_engaged").alias("ever_engaged_exp"), "channel_diversity")
    p = participants(spark, sf).withColumn("ever_engaged", F.col("segment") == "BUILDING")
    return p.join(e, "participant_id", "left").fillna(0, ["campaign_count", "email_count", "engage_rate", "channel_diversity"]).where("income IS NOT NULL").drop("zip")


MATRIX = f"""WITH {EXPOSURES}, {PARTICIPANTS}, e AS (SELECT participant_id, count(*) AS campaign_count, count(*) FILTER (WHERE channel = 'email') AS email_count, round(count(*) FILTER (WHERE status = 'engaged') / CAST(count(*) AS DOUBLE), 6) AS engage_rate, count(*) FILTER (WHERE status = 'engaged') > 0 AS ever_engaged_exp,
  CAST(bool_or(channel = 'email') AS INTEGER) + CAST(bool_or(channel LIKE 'text%') AS INTEGER) + CAST(bool_or(channel IN ('mailer','letter')) AS INTEGER) AS channel_diversity FROM exposures GROUP BY 1)
SELECT participant_id, county, income, segment, segment = 'BUILDING' AS ever_engaged, coalesce(campaign_count, 0) AS campaign_count, coalesce(email_count, 0) AS email_count, coalesce(engage_rate, 0) AS engage_rate, ever_engaged_exp, coalesce(channel_diversity, 0) AS channel_diversity
FROM participants LEFT JOIN e USING (participant_id) WHERE income IS NOT NULL"""

QUERIES = {
    "median_impute": (median_impute, MEDIAN),
    "zscore_pop": (zscore_pop, _Z.format(f="stddev_pop")),
    "zscore_sample": (zscore_sample, _Z.format(f="stddev_samp")),
    "scale_with_stored": (scale_with_stored, STORED),
    "category_codes": (category_codes, CODES),
    "stratified_selection": (stratified_selection, SELECTION),
    "stratified_split": (stratified_split, SPLIT),
    "fill_defaults": (fill_defaults, FILL),
    "county_summary": (county_summary, COUNTY),
    "variable_summary": (variable_summary, VARIABLES),
    "feature_matrix": (feature_matrix, MATRIX),
}
