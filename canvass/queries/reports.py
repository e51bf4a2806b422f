"""Small reports: type counts, model ranking, calibration, campaign performance,
formats, column selection, sync counters."""

from __future__ import annotations

import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import values as V
from canvass.operators import features, merge, order
from canvass.operators import statistics as S
from canvass.sources import files
from canvass.sources.domain import EXPOSURES, exposures, table
from canvass.streaming import sync


def type_counts(spark, sf):
    """How many rows bear each of the types in an array."""
    p = table(spark, sf, "part").select(F.explode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("type"))
    return p.groupBy("type").agg(F.count("*").alias("n"))


TYPE_COUNTS = "SELECT unnest(list_append(string_split(p_name, ' '), p_type)) AS type, count(*) AS n FROM part GROUP BY 1"


def model_ranks(spark, sf):
    """Models by expected predictive density, the highest first, equals sharing
    their mean rank; and how far each is behind the best."""
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(F.floor(F.avg("p_size")).cast("double").alias("elpd"))
    return S.ranked(p, "elpd").select("model", "elpd", "rank", "diff")


MODEL_RANKS = """WITH m AS (SELECT p_brand AS model, CAST(floor(avg(p_size)) AS DOUBLE) AS elpd FROM part GROUP BY 1)
SELECT model, elpd, rank() OVER (ORDER BY elpd DESC) + (count(*) OVER (PARTITION BY elpd) - 1) / 2 AS rank, max(elpd) OVER () - elpd AS diff FROM m"""


def calibration(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") / (F.col("value") + 20)).alias("p"), (F.col("user_id") % 3 > 0).alias("y"))
    return S.calibration(e, "p", "y", ["event_type"])


CALIBRATION = """WITH e AS (SELECT event_type, value / (value + 20) AS p, CAST(user_id % 3 > 0 AS INTEGER) AS y FROM events)
SELECT event_type, count(*) AS n, round(avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS INTEGER)), 6) AS accuracy, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed FROM e WHERE p IS NOT NULL GROUP BY 1"""


def campaign_performance(spark, sf):
    """Open, click and conversion rates of groups of campaigns: mean and shortest
    interval of 89 % over draws (here groups of parts)."""
    e = exposures(spark, sf).groupBy((F.col("campaign_id") % 5).alias("campaign"), (F.col("part_id") % 200).alias("draw"))
    e = e.agg(F.count("*").alias("n"), V.count_where(F.col("opened")).alias("o"), V.count_where(F.col("clicked")).alias("c")).where("o > 0")
    rates = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), r.alias("rate")) for m, r in (("open", F.col("o") / F.col("n")), ("click", F.col("c") / F.col("o")), ("conversion", F.col("c") / F.col("n"))))))
    draws = e.select("campaign", rates)
    means = draws.groupBy("campaign", "measure").agg(F.round(F.avg("rate"), 6).alias("mean"))
    span = order.shortest_interval(draws, "rate", ["campaign", "measure"], 0.89)
    return means.join(span, ["campaign", "measure"]).select("campaign", "measure", "mean", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


PERFORMANCE = f"""WITH {EXPOSURES}, e AS (SELECT campaign_id % 5 AS campaign, part_id % 200 AS draw, count(*) AS n, count(*) FILTER (WHERE opened) AS o, count(*) FILTER (WHERE clicked) AS c FROM exposures GROUP BY 1, 2 HAVING o > 0),
d AS (SELECT campaign, 'open' AS measure, o / n AS rate FROM e UNION ALL SELECT campaign, 'click', c / o FROM e UNION ALL SELECT campaign, 'conversion', c / n FROM e),
x AS (SELECT *, row_number() OVER (PARTITION BY campaign, measure ORDER BY rate) AS k, CAST(floor(count(*) OVER (PARTITION BY campaign, measure) * 0.89) AS BIGINT) AS w, avg(rate) OVER (PARTITION BY campaign, measure) AS m FROM d)
SELECT a.campaign, a.measure, round(a.m, 6) AS mean, round(a.rate, 6) AS lo, round(b.rate, 6) AS hi FROM x a JOIN x b ON a.campaign = b.campaign AND a.measure = b.measure AND b.k = a.k + a.w
QUALIFY row_number() OVER (PARTITION BY a.campaign, a.measure ORDER BY b.rate - a.rate, a.rate) = 1"""


def format_values(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k, V.ratio_text(k % 7, k % 11).alias("ratio"), V.money_text(F.col("p_retailprice") * 1000).alias("money"), V.percent_text((k % 1000) / 8.0).alias("percent"))


FORMATS = "SELECT p_partkey, (p_partkey % 7) || '/' || (p_partkey % 11) AS ratio, '$' || format('{:,.2f}', p_retailprice * 1000) AS money, format('{:.3f}%', (p_partkey % 1000) / 8.0) AS percent FROM part"


def column_selection(spark, sf):
    """Counts by type as columns, chosen by prefix and suffix, an internal column dropped."""
    e = table(spark, sf, "events")
    wide = e.groupBy("user_id").agg(*(V.count_where(F.col("event_type") == t).alias(f"msgtype_{t}_count") for t in ("click", "error", "signup")), F.max("event_id").alias("_id"), F.max("value").alias("msgtype_value"))
    return wide.drop("_id").select("user_id", *features.columns_like(wide, "msgtype_", "_count"))


SELECTION = "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS msgtype_{t}_count" for t in ("click", "error", "signup")) + " FROM events GROUP BY 1"


def invert_lookup(spark, sf):
    """Names by index turned into index by name; the first element of a list,
    and whether there is one."""
    codes = features.inverted({i: t for i, t in enumerate(("click", "error", "signup"))})
    e = table(spark, sf, "events")
    kept = F.filter(F.split("event_type", "i"), lambda x: F.length(x) > 2)
    return e.select("event_id", F.try_element_at(codes, F.col("event_type")).alias("code"), F.try_element_at(kept, F.lit(1)).alias("first"), (F.size(kept) > 0).alias("has_any"))


INVERT = """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'signup' THEN 2 END AS code, list_filter(string_split(event_type, 'i'), lambda x: length(x) > 2)[1] AS first,
  len(list_filter(string_split(event_type, 'i'), lambda x: length(x) > 2)) > 0 AS has_any FROM events"""


def person_ids(spark, sf):
    """Customers by e-mail, else by the parts of their name."""
    c = table(spark, sf, "customer")
    kind = F.col("c_custkey") % 3
    email = F.when(kind == 0, F.concat(F.lit(" C"), F.col("c_custkey").cast("string"), F.lit("@E.org "))).when(kind == 1, F.lit("no address"))
    first, last = F.when(kind != 2, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(F.lit(" ")), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return c.select("c_custkey", files.person_id(email, first, last).alias("person_id"))


PERSON_IDS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@e.org' ELSE nullif(trim(concat_ws(' ', CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, CASE WHEN c_custkey % 5 <> 0 THEN c_name END)), '') END AS person_id FROM customer"""


def sync_counters(spark, sf):
    """Rows that a merge inserts, updates and leaves as they are."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return merge.counters(old, new, ["o_orderkey"])


COUNTERS = """SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS inserted, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 AND o_orderstatus <> 'X') AS updated,
  count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0) AS unchanged FROM orders WHERE o_orderkey % 2 = 0"""


def incremental_sync(spark, sf):
    """Stale campaigns alone are fetched again and merged."""
    now = datetime.datetime(2024, 1, 2)
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    at = F.when(k % 9 != 0, F.lit(now) - F.make_interval(hours=k % 48))
    old = s.select(k.alias("campaign_id"), F.col("s_name").alias("name"), at.cast("timestamp_ntz").alias("synced_at"))
    fetched = s.where("s_suppkey % 2 = 0").select(k.alias("campaign_id"), F.upper("s_name").alias("name"), F.lit(now).cast("timestamp_ntz").alias("synced_at"))
    out = sync.refresh(old, fetched, ["campaign_id"], 24, now)
    return out.select("campaign_id", "name", (F.col("synced_at") == F.lit(now).cast("timestamp_ntz")).alias("fresh"))


INCREMENTAL = """SELECT s_suppkey AS campaign_id, CASE WHEN stale AND s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name,
  CASE WHEN stale AND s_suppkey % 2 = 0 THEN true WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 48 = 0 END AS fresh FROM (SELECT *, s_suppkey % 9 = 0 OR s_suppkey % 48 > 24 AS stale FROM supplier)"""


def cache_keys(spark, sf):
    """The name of a group's prepared data: a digest of its sorted campaign ids."""
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(files.cache_key(F.col("s_suppkey")).alias("key"))


CACHE_KEYS = "SELECT s_nationkey, md5(string_agg(CAST(s_suppkey AS VARCHAR), '_' ORDER BY CAST(s_suppkey AS VARCHAR))) AS key FROM supplier GROUP BY 1"


def phase_comparison(spark, sf):
    """How well three labellings go with an outcome: chi-square of each, the
    clearest first."""
    c = table(spark, sf, "customer").withColumn("outcome", F.col("c_acctbal") > 5000)
    names = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string"), "parity": (F.col("c_custkey") % 2).cast("string")}
    rows = c.select("outcome", F.inline(F.array(*(F.struct(F.lit(n).alias("phase"), label.alias("label")) for n, label in names.items()))))
    cells = rows.groupBy("phase", "label", "outcome").agg(F.count("*").alias("n"))
    grid = cells.groupBy("phase", "label").agg(F.sum(F.when(F.col("outcome"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("t"))
    all_ = W.partitionBy("phase")
    rate = F.sum("a").over(all_) / F.sum("t").over(all_)
    return (
        grid.withColumn("r", rate)
        .groupBy("phase")
        .agg(F.count("*").alias("labels"), F.round(F.sum(F.pow(F.col("a") - F.col("t") * F.col("r"), 2) / (F.col("t") * F.col("r") * (1 - F.col("r")))), 6).alias("chi2"), F.round(F.max(F.col("a") / F.col("t")) - F.min(F.col("a") / F.col("t")), 6).alias("spread"))
        .orderBy(F.desc("chi2"), "phase")
    )


PHASES = """WITH r AS (SELECT 'segment' AS phase, c_mktsegment AS label, c_acctbal > 5000 AS y FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), c_acctbal > 5000 FROM customer UNION ALL SELECT 'parity', CAST(c_custkey % 2 AS VARCHAR), c_acctbal > 5000 FROM customer),
g AS (SELECT phase, label, count(*) FILTER (WHERE y) AS a, count(*) AS t FROM r GROUP BY 1, 2), h AS (SELECT *, sum(a) OVER (PARTITION BY phase) / sum(t) OVER (PARTITION BY phase) AS p FROM g)
SELECT phase, count(*) AS labels, round(sum((a - t * p) * (a - t * p) / (t * p * (1 - p))), 6) AS chi2, round(max(a / t) - min(a / t), 6) AS spread FROM h GROUP BY 1"""

QUERIES = {
    "type_counts": (type_counts, TYPE_COUNTS),
    "model_ranks": (model_ranks, MODEL_RANKS),
    "calibration": (calibration, CALIBRATION),
    "campaign_performance": (campaign_performance, PERFORMANCE),
    "format_values": (format_values, FORMATS),
    "column_selection": (column_selection, SELECTION),
    "invert_lookup": (invert_lookup, INVERT),
    "person_ids": (person_ids, PERSON_IDS),
    "sync_counters": (sync_counters, COUNTERS),
    "incremental_sync": (incremental_sync, INCREMENTAL),
    "cache_keys": (cache_keys, CACHE_KEYS),
    "phase_comparison": (phase_comparison, PHASES),
}
