"""Dashboard questions: totals, rankings, funnels, histograms, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import values as V
from canvass.sources.domain import CAMPAIGNS, EXPOSURES, PARTICIPANTS, campaigns, exposures, participants, table


def channel_totals(spark, sf):
    """Every channel, also those without exposures, and all together."""
    e = exposures(spark, sf)
    sums = [F.count("*").alias("sent"), V.count_where(F.col("opened")).alias("opened"), V.count_where(F.col("clicked")).alias("clicked"), F.round(F.coalesce(F.sum("savings"), F.lit(0.0)), 2).alias("savings")]
    spine = spark.createDataFrame([(c,) for c in [*V.CHANNELS, "phone"]], "channel string")
    per = spine.join(e.groupBy("channel").agg(*sums), "channel", "left").fillna(0)
    return per.unionByName(e.agg(*sums).select(F.lit("all").alias("channel"), "sent", "opened", "clicked", "savings"))


CHANNEL_TOTALS = f"""WITH {EXPOSURES}, s AS (SELECT unnest(['email','text_morning','text_evening','mailer','letter','phone']) AS channel),
g AS (SELECT channel, count(*) AS sent, count(*) FILTER (WHERE opened) AS opened, count(*) FILTER (WHERE clicked) AS clicked, round(sum(savings), 2) AS savings FROM exposures GROUP BY channel)
SELECT channel, coalesce(sent, 0) AS sent, coalesce(opened, 0) AS opened, coalesce(clicked, 0) AS clicked, coalesce(savings, 0) AS savings FROM s LEFT JOIN g USING (channel)
UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE opened), count(*) FILTER (WHERE clicked), round(sum(savings), 2) FROM exposures"""


def zip_engagement_top20(spark, sf):
    e, p = exposures(spark, sf), participants(spark, sf).where("zip IS NOT NULL")
    per = e.join(p, "participant_id").groupBy("zip").agg(F.count("*").alias("total"), V.count_where(F.col("opened")).alias("opened"), V.count_where(F.col("clicked")).alias("clicked"))
    return per.where("total >= 10").orderBy(F.desc("opened"), "zip").limit(20)


ZIP_TOP = f"""WITH {EXPOSURES}, {PARTICIPANTS} SELECT zip, count(*) AS total, count(*) FILTER (WHERE opened) AS opened, count(*) FILTER (WHERE clicked) AS clicked
FROM exposures JOIN participants USING (participant_id) WHERE zip IS NOT NULL GROUP BY zip HAVING count(*) >= 10 ORDER BY opened DESC, zip LIMIT 20"""


def county_top10(spark, sf):
    return participants(spark, sf).groupBy("county").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "county").limit(10)


COUNTY_TOP = f"WITH {PARTICIPANTS} SELECT county, count(*) AS n FROM participants GROUP BY county ORDER BY n DESC, county LIMIT 10"


def quality_distribution(spark, sf):
    o = table(spark, sf, "orders")
    q = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "good")
    return o.groupBy(q.alias("quality")).agg(F.count("*").alias("n")).where("quality IS NOT NULL")


QUALITY = "SELECT CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'good' END AS quality, count(*) AS n FROM orders GROUP BY 1 HAVING quality IS NOT NULL"


def conversion_funnel(spark, sf):
    """Signups per step of the funnel, in percent with half-even rounding."""
    e = table(spark, sf, "events")
    users = lambda t: F.countDistinct(F.when(F.col("event_type") == t, F.col("user_id")))
    f = e.agg(F.countDistinct("user_id").alias("participants"), users("view").alias("viewers"), users("click").alias("clickers"), users("signup").alias("applicants"))
    pct = lambda a, b: F.bround(V.rate(F.col(a), F.col(b), 100.0), 2)
    return f.withColumns({"view_pct": pct("viewers", "participants"), "click_pct": pct("clickers", "viewers"), "conversion_pct": pct("applicants", "participants"), "ratio": F.concat_ws("/", F.col("applicants").cast("string"), F.col("participants").cast("string"))})


FUNNEL = """WITH f AS (SELECT count(DISTINCT user_id) AS participants, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers,
  count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clickers, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS applicants FROM events)
SELECT *, round_even(CASE WHEN participants > 0 THEN viewers / participants * 100.0 ELSE 0.0 END, 2) AS view_pct, round_even(CASE WHEN viewers > 0 THEN clickers / viewers * 100.0 ELSE 0.0 END, 2) AS click_pct,
  round_even(CASE WHEN participants > 0 THEN applicants / participants * 100.0 ELSE 0.0 END, 2) AS conversion_pct, applicants || '/' || participants AS ratio FROM f"""


def ctr_ranking(spark, sf):
    """The ten campaigns most opened and the ten with the best click rate."""
    e = exposures(spark, sf).where("channel = 'email'").groupBy("campaign_id").agg(V.count_where(F.col("opened")).alias("opened"), V.count_where(F.col("clicked")).alias("clicked"), F.count("*").alias("counted"))
    c = campaigns(spark, sf).join(e, "campaign_id", "left")
    c = c.withColumns({"opened": F.coalesce("opened", F.lit(0)), "clicked": F.coalesce("clicked", F.lit(0)), "sent": F.coalesce(F.nullif(F.col("counted"), F.lit(0)), F.round("budget").cast("long"))})
    c = c.withColumn("ctr", F.round(V.rate(F.col("clicked"), F.col("opened"), 100.0), 1)).select("campaign_id", "name", "opened", "clicked", "sent", "ctr")
    return c.orderBy(F.desc("opened"), "campaign_id").limit(10).withColumn("board", F.lit("opened")).unionByName(c.orderBy(F.desc("ctr"), "campaign_id").limit(10).withColumn("board", F.lit("ctr")))


CTR = f"""WITH {EXPOSURES}, {CAMPAIGNS}, e AS (SELECT campaign_id, count(*) FILTER (WHERE opened) AS opened, count(*) FILTER (WHERE clicked) AS clicked, count(*) AS counted FROM exposures WHERE channel = 'email' GROUP BY 1),
c AS (SELECT campaign_id, name, coalesce(opened, 0) AS opened, coalesce(clicked, 0) AS clicked, coalesce(nullif(counted, 0), CAST(round(budget) AS BIGINT)) AS sent,
  round(CASE WHEN coalesce(opened, 0) > 0 THEN coalesce(clicked, 0) / opened * 100.0 ELSE 0.0 END, 1) AS ctr FROM campaigns LEFT JOIN e USING (campaign_id))
(SELECT *, 'opened' AS board FROM c ORDER BY opened DESC, campaign_id LIMIT 10) UNION ALL (SELECT *, 'ctr' AS board FROM c ORDER BY ctr DESC, campaign_id LIMIT 10)"""


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page by a total order; a page past the end is empty."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def paged_campaigns(spark, sf):
    c = campaigns(spark, sf)
    pages = c.agg(F.ceil(F.count("*") / 12).cast("long").alias("pages"))
    third = page(c, 3, 12, F.desc("budget"), "campaign_id")
    # The one-row count is read beside the page's twelve rows.
    return third.select("campaign_id", "name", F.round("budget", 2).alias("budget")).join(pages, F.lit(True))


PAGED = f"WITH {CAMPAIGNS}, p AS (SELECT CAST(ceil(count(*) / 12) AS BIGINT) AS pages FROM campaigns) SELECT campaign_id, name, round(budget, 2) AS budget, pages FROM (SELECT * FROM campaigns ORDER BY budget DESC, campaign_id LIMIT 12 OFFSET 24), p"


def recent_across_channels(spark, sf):
    """The latest twenty of both sources: each gives its own latest twenty."""
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("sent_at"))
    e = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("sent_at"))
    top = [x.orderBy(F.desc_nulls_last("sent_at"), "id").limit(20) for x in (o, e)]
    return reduce(DataFrame.unionByName, top).orderBy(F.desc_nulls_last("sent_at"), "kind", "id").limit(20)


RECENT = """SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS sent_at FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY sent_at DESC NULLS LAST, kind, id LIMIT 20"""


def histogram(rows: DataFrame, value: str, second: str, bins: int = 10) -> DataFrame:
    """Equal bins from the least to the greatest value, the last one closed;
    missing values count as 0; ``second`` marks rows counted beside all."""
    x = rows.select(F.coalesce(F.col(value), F.lit(0)).cast("double").alias("x"), F.col(second).alias("s"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))
    # ``ends`` is one row.
    binned = x.join(F.broadcast(ends), F.lit(True)).withColumn("bin", F.greatest(F.lit(0), F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1))).cast("int"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("total"), V.count_where(F.col("s")).alias("marked"))
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends), F.lit(True))
    out = spine.join(counts, "bin", "left").fillna(0, ["total", "marked"])
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 4).alias("from"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 4).alias("to"), "total", "marked")


def savings_histogram(spark, sf):
    return histogram(exposures(spark, sf), "savings", "opened")


HISTOGRAM = f"""WITH {EXPOSURES}, x AS (SELECT CAST(coalesce(savings, 0) AS DOUBLE) AS x, opened FROM exposures), e AS (SELECT min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 10 ELSE 1.0 END AS w FROM x),
c AS (SELECT CAST(greatest(0, least(floor((x - lo) / w), 9)) AS INTEGER) AS bin, count(*) AS total, count(*) FILTER (WHERE opened) AS marked FROM x, e GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, round(lo + r.range * w, 4) AS "from", round(lo + (r.range + 1) * w, 4) AS "to", coalesce(total, 0) AS total, coalesce(marked, 0) AS marked FROM range(10) r CROSS JOIN e LEFT JOIN c ON c.bin = r.range"""


def share_of_total(spark, sf):
    e = exposures(spark, sf).groupBy("channel").agg(F.count("*").alias("n"))
    return e.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 4))


SHARE = f"WITH {EXPOSURES} SELECT channel, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM exposures GROUP BY channel"


def threshold_share(spark, sf):
    """How many lines are discounted by over 6 %, and statistics of quantity."""
    t = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return t.agg(V.count_where(F.col("l_discount") > 0.06).alias("high"), F.round(V.count_where(F.col("l_discount") > 0.06) * 100 / F.count("*"), 4).alias("pct"), F.round(F.avg(q), 4).alias("mean"), F.median(q).alias("median"), F.round(F.stddev_samp(q), 4).alias("sd"))


THRESHOLD = "SELECT count(*) FILTER (WHERE l_discount > 0.06) AS high, round(count(*) FILTER (WHERE l_discount > 0.06) * 100.0 / count(*), 4) AS pct, round(avg(l_quantity), 4) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 4) AS sd FROM lineitem"


def try_cast_sum(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").try_cast("int")), F.lit(0)).alias("total"))


TRY_CAST = "SELECT event_type, CAST(coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)), 0) AS BIGINT) AS total FROM events GROUP BY event_type"


def yes_no_export(spark, sf):
    """The flat export of view events: Yes/No flags, blanks for null."""
    from canvass.functions import text as T

    e = table(spark, sf, "events").where("event_type IN ('view', 'click')")
    n = F.get_json_object("props", "$.k")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("sent_on"), T.yes_no(F.col("event_type") == "click").alias("clicked"), F.when(F.col("value") > 50, 1).otherwise(0).alias("high"), F.coalesce(F.when(F.length(n) > 1, n), F.lit("")).alias("k"))


YES_NO = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS sent_on, CASE WHEN event_type = 'click' THEN 'Yes' ELSE 'No' END AS clicked, CASE WHEN value > 50 THEN 1 ELSE 0 END AS high,
  CASE WHEN length(json_extract_string(props, '$.k')) > 1 THEN json_extract_string(props, '$.k') ELSE '' END AS k FROM events WHERE event_type IN ('view', 'click')"""


def array_length_stats(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_type"))).alias("a"))
    u = table(spark, sf, "customer").join(e, F.col("c_custkey") == F.col("user_id"), "left")
    n = F.size(F.coalesce("a", F.array().cast("array<string>")))
    return u.agg(F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"))


ARRAY_STATS = """WITH e AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_type <> 'error') AS a FROM events GROUP BY 1)
SELECT CAST(sum(coalesce(len(a), 0)) AS BIGINT) AS total, round(avg(coalesce(len(a), 0)), 6) AS mean, CAST(max(coalesce(len(a), 0)) AS INTEGER) AS most FROM customer LEFT JOIN e ON c_custkey = user_id"""


def schema_profile(spark, sf):
    """Per column of customer: nulls, different values, least and greatest."""
    t = table(spark, sf, "customer")
    cols = t.columns
    one = t.agg(*(x for c in cols for x in (F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_0"), F.countDistinct(c).alias(f"{c}_1"))))
    entries = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_0").alias("nulls"), F.col(f"{c}_1").alias("different")) for c in cols))
    return one.select(F.inline(entries))


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS different FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))

QUERIES = {
    "channel_totals": (channel_totals, CHANNEL_TOTALS),
    "zip_engagement_top20": (zip_engagement_top20, ZIP_TOP),
    "county_top10": (county_top10, COUNTY_TOP),
    "quality_distribution": (quality_distribution, QUALITY),
    "conversion_funnel": (conversion_funnel, FUNNEL),
    "ctr_ranking": (ctr_ranking, CTR),
    "paged_campaigns": (paged_campaigns, PAGED),
    "recent_across_channels": (recent_across_channels, RECENT),
    "savings_histogram": (savings_histogram, HISTOGRAM),
    "share_of_total": (share_of_total, SHARE),
    "threshold_share": (threshold_share, THRESHOLD),
    "try_cast_sum": (try_cast_sum, TRY_CAST),
    "yes_no_export": (yes_no_export, YES_NO),
    "array_length_stats": (array_length_stats, ARRAY_STATS),
    "schema_profile": (schema_profile, PROFILE),
}
