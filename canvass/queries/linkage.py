"""Linkage, lookups and joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import text as T
from canvass.functions import values as V
from canvass.operators import linkage
from canvass.sources.domain import CAMPAIGNS, PARTICIPANTS, campaigns, participants, table


def _parcels(spark, sf):
    p = table(spark, sf, "part")
    county = F.concat(F.lit("C"), (F.col("p_partkey") % 5).cast("string")).alias("county")
    zip_ = (F.lit(43000) + F.col("p_partkey") % 50).cast("string").alias("zip")
    res = p.select(county, F.col("p_partkey").alias("parcel_id"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_name", F.lit("Street")).alias("address"), zip_)
    phone = F.concat(F.lit("614"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    dem = p.select(county, F.col("p_partkey").alias("parcel_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("@example.org")).alias("email"), F.upper("p_name").alias("full_name"), phone.alias("phone"), zip_)
    kind = F.col("p_partkey") % 7
    name = F.split("p_name", " ")
    size = F.col("p_size").cast("string")
    address = F.when(kind == 2, F.concat_ws(" ", size, "p_name", F.lit("Street"))).when(kind == 3, F.concat_ws(" ", size, F.upper("p_name"), F.lit("ST."))).when(kind == 5, F.concat_ws(" ", size, "p_name", F.lit("Stre")))
    con = p.select(
        F.col("p_partkey").alias("contact_id"), county, F.when(kind == 0, F.concat(F.lit(" P"), F.col("p_partkey").cast("string"), F.lit("@Example.org"))).alias("email"),
        F.when(kind == 4, name[0]).alias("first"), F.when(kind == 4, name[1]).alias("last"),
        F.when(kind == 1, F.concat(F.lit("1-("), F.substring(phone, 1, 3), F.lit(") "), F.substring(phone, 4, 7))).alias("phone"), address.alias("address"), zip_,
    )
    return con, dem, res


_PARCELS = """res AS (SELECT 'C' || p_partkey % 5 AS county, p_partkey AS parcel_id, p_size || ' ' || p_name || ' Street' AS address, 43000 + p_partkey % 50 AS zip,
  regexp_replace(lower(p_size || ' ' || p_name || ' Street'), '\\bstreet\\b', 'st', 'g') AS k, lower(p_name) AS full_name, '614' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS phone, 'p' || p_partkey || '@example.org' AS email FROM part),
con AS (SELECT p_partkey AS contact_id, 'C' || p_partkey % 5 AS county, 43000 + p_partkey % 50 AS zip, CASE WHEN p_partkey % 7 = 0 THEN 'p' || p_partkey || '@example.org' END AS email, CASE WHEN p_partkey % 7 = 1 THEN '614' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS phone,
  CASE WHEN p_partkey % 7 = 4 THEN lower(p_name) END AS full_name, CASE p_partkey % 7 WHEN 2 THEN p_size || ' ' || p_name || ' Street' WHEN 3 THEN p_size || ' ' || upper(p_name) || ' ST.' WHEN 5 THEN p_size || ' ' || p_name || ' Stre' END AS address,
  CASE p_partkey % 7 WHEN 2 THEN lower(p_size || ' ' || p_name || ' st') WHEN 3 THEN lower(p_size || ' ' || p_name || ' st') WHEN 5 THEN lower(p_size || ' ' || p_name || ' stre') END AS k FROM part),
f AS (SELECT c.contact_id, r.county, r.parcel_id, c.k AS a, r.k AS b, trim(regexp_replace(c.k, '^\\d+', '')) AS x, trim(regexp_replace(r.k, '^\\d+', '')) AS y, c.phone AS p1, r.phone AS p2 FROM con c JOIN res r ON c.county = r.county AND c.zip = r.zip AND regexp_extract(c.k, '^(\\d+)', 1) = regexp_extract(r.k, '^(\\d+)', 1)),
g AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN CAST(least(length(x), length(y)) AS DOUBLE) / greatest(length(x), length(y)) ELSE 0.0 END AS s FROM f)"""


def cascade_best_match(spark, sf):
    con, dem, res = _parcels(spark, sf)
    m = linkage.match(con, dem, res)
    return m.select("contact_id", "quality", "match_county", "parcel_id", "priority", "method", F.round("score", 6).alias("score"), "confidence")


CASCADE = f"""WITH {_PARCELS}, h AS (
  SELECT contact_id, r.county, parcel_id, 1 AS priority, 'email' AS method, 'demographic' AS quality, 1.0 AS score FROM con c JOIN res r ON c.county = r.county AND c.email = r.email
  UNION ALL SELECT contact_id, r.county, parcel_id, 2, 'name_exact', 'demographic', 1.0 FROM con c JOIN res r ON c.county = r.county AND c.zip = r.zip AND contains(r.full_name, c.full_name)
  UNION ALL SELECT contact_id, r.county, parcel_id, 3, 'phone', 'demographic', 1.0 FROM con c JOIN res r ON c.county = r.county AND c.phone = r.phone
  UNION ALL SELECT contact_id, r.county, parcel_id, 4, 'address_exact', 'exact', 1.0 FROM con c JOIN res r ON c.county = r.county AND c.zip = r.zip AND c.address = r.address
  UNION ALL SELECT contact_id, r.county, parcel_id, 5, 'address_normalized', 'good', 1.0 FROM con c JOIN res r ON c.county = r.county AND c.zip = r.zip AND c.k = r.k
  UNION ALL SELECT contact_id, county, parcel_id, 8, printf('fuzzy_%.2f', s), 'fuzzy', s FROM g WHERE s > 0.7),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY priority, score DESC, county, parcel_id) = 1)
SELECT c.contact_id, coalesce(quality, 'no_match') AS quality, b.county AS match_county, parcel_id, priority, method, round(CAST(score AS DOUBLE), 6) AS score,
  CAST(CASE WHEN regexp_matches(method, 'exact|email|phone') THEN 1.0 WHEN method IS NOT NULL THEN 0.8 END AS DOUBLE) AS confidence FROM con c LEFT JOIN b USING (contact_id)"""


def score_cascade_match(spark, sf):
    con, dem, res = _parcels(spark, sf)
    return linkage.score_cascade(con, dem, res).withColumn("score", F.round("score", 6))


SCORE_CASCADE = f"""WITH {_PARCELS}, h AS (SELECT contact_id, county, parcel_id, 1 AS kind, 'address' AS method, s AS score FROM g WHERE s > 0.7
  UNION ALL SELECT contact_id, r.county, parcel_id, 2, 'phone', 1.0 FROM con c JOIN res r ON c.county = r.county AND c.phone = r.phone)
SELECT contact_id, county, parcel_id, method, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN score = 1 THEN 'good' ELSE 'fuzzy' END AS quality FROM h
QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY CASE WHEN kind = 2 THEN 1 ELSE 2 END, score DESC, kind, county, parcel_id) = 1"""


def match_report(spark, sf):
    """What the cascade came to, by method, with shares of all contacts."""
    m = cascade_best_match(spark, sf).groupBy("quality", F.regexp_replace(F.coalesce("method", F.lit("none")), r"_\d.*$", "").alias("method")).agg(F.count("*").alias("n"))
    return m.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 4))


MATCH_REPORT = f"""WITH m AS ({CASCADE}) SELECT quality, regexp_replace(coalesce(method, 'none'), '_\\d.*$', '') AS method, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM m GROUP BY 1, 2"""


def multi_county_rank(spark, sf):
    p = participants(spark, sf).select((F.col("participant_id") % 97).alias("zip"), F.col("county"))
    return linkage.zip_counties(p).select("zip", "county", "n", F.col("county_rank").cast("long").alias("county_rank"))


MULTI_COUNTY = f"WITH {PARTICIPANTS} SELECT participant_id % 97 AS zip, county, count(*) AS n, row_number() OVER (PARTITION BY participant_id % 97 ORDER BY count(*) DESC, county) AS county_rank FROM participants GROUP BY 1, 2"

_RANGES = [(0, 19, "FRANCE"), (40, 59, "CHINA")]


def range_resolution(spark, sf):
    """ZIP to county: the only one; else the range's; else the first but one; else the first."""
    p = participants(spark, sf).select((F.col("participant_id") % 700).cast("int").alias("zip"), "county")
    z = p.groupBy("zip").agg(F.countDistinct("county").alias("n"), F.min("county").alias("first"), F.min(F.when(F.col("county") != "ALGERIA", F.col("county"))).alias("other"))
    r = spark.createDataFrame(_RANGES, "lo int, hi int, ranged string")
    z = z.join(F.broadcast(r), F.col("zip").between(F.col("lo"), F.col("hi")), "left")  # two rows
    return z.select("zip", "n", F.when(F.col("n") == 1, F.col("first")).otherwise(F.coalesce("ranged", "other", "first")).alias("county"))


RANGES = f"""WITH {PARTICIPANTS}, z AS (SELECT CAST(participant_id % 700 AS INTEGER) AS zip, count(DISTINCT county) AS n, min(county) AS first, min(CASE WHEN county <> 'ALGERIA' THEN county END) AS other FROM participants GROUP BY 1)
SELECT zip, n, CASE WHEN n = 1 THEN first ELSE coalesce(CASE WHEN zip BETWEEN 0 AND 19 THEN 'FRANCE' WHEN zip BETWEEN 40 AND 59 THEN 'CHINA' END, other, first) END AS county FROM z"""


def best_snapshot(spark, sf):
    """A customer's best order as contact record: score 2, 2, 1, 1; the first of equals."""
    o = table(spark, sf, "orders")
    score = F.when(F.col("o_orderstatus") == "F", 2).otherwise(0) + F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(0) + F.when(F.col("o_totalprice") > 200000, 1).otherwise(0) + F.when(F.month("o_orderdate") > 6, 1).otherwise(0)
    s = o.withColumn("score", score)
    return s.groupBy("o_custkey").agg(F.max("score").alias("score"), F.max_by("o_orderkey", F.struct("score", (-F.col("o_orderkey")).alias("k"))).alias("order"))


SNAPSHOT = """WITH s AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS score FROM orders)
SELECT o_custkey, CAST(score AS INTEGER) AS score, o_orderkey AS "order" FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1"""


def left_join_suffix_merge(spark, sf):
    p = participants(spark, sf).select("participant_id", "county", F.col("income").alias("amount"))
    e = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count("*").alias("n"))
    return p.join(e.withColumnRenamed("amount", "amount_exp"), F.col("participant_id") == F.col("o_custkey"), "left").select("participant_id", "county", "amount", "amount_exp", "n")


LEFT_JOIN = f"WITH {PARTICIPANTS}, e AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS amount_exp, count(*) AS n FROM orders GROUP BY 1) SELECT participant_id, county, income AS amount, amount_exp, n FROM participants LEFT JOIN e ON participant_id = o_custkey"


def join_fallback_group_mean(spark, sf):
    """A missing income is the mean of its ZIP code; sentinels don't count."""
    p = participants(spark, sf)
    means = p.groupBy("zip").agg(F.avg("income").alias("mean"))
    return p.join(means, "zip", "left").select("participant_id", "zip", F.round(F.coalesce("income", "mean"), 4).alias("income"), F.col("income").isNull().alias("imputed"))


FALLBACK = f"WITH {PARTICIPANTS}, m AS (SELECT zip, avg(income) AS mean FROM participants GROUP BY zip) SELECT participant_id, zip, round(coalesce(income, mean), 4) AS income, income IS NULL AS imputed FROM participants LEFT JOIN m USING (zip)"


def lookup_default_unknown(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lpad((F.col("c_nationkey") * 7 % 40).cast("string"), 5, "0").alias("zip5"))
    lookup = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip5"), F.col("n_name").alias("county"))
    return linkage.county_of_zip(c, lookup, "Unknown").groupBy("county").agg(F.count("*").alias("n"))


LOOKUP = "SELECT coalesce(n_name, 'Unknown') AS county, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey * 7 % 40 = n_nationkey GROUP BY 1"


def coalesce_lookup_priority(spark, sf):
    """County by three lookups in order: own field, city, ZIP code."""
    c = table(spark, sf, "customer")
    own = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment"))
    city = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("city"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("by_city"))
    zips = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("by_zip"))
    out = c.withColumn("city", F.col("c_custkey") % 400).join(city, "city", "left").join(zips, "c_nationkey", "left")
    return out.select("c_custkey", F.coalesce(own, F.col("by_city"), F.col("by_zip")).alias("county"), F.when(own.isNotNull(), "field").when(F.col("by_city").isNotNull(), "city").otherwise("zip").alias("found_by"))


PRIORITY = """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) END, 'S' || s_nationkey, n_name) AS county, CASE WHEN c_custkey % 3 = 0 THEN 'field' WHEN s_nationkey IS NOT NULL THEN 'city' ELSE 'zip' END AS found_by
FROM customer LEFT JOIN supplier ON c_custkey % 400 = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey"""


def anti_unmatched(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


ANTI = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"


def semi_overlap(spark, sf):
    """Contacts of both sources, of the first alone and of the second alone."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    counts = [a.intersect(b), a.subtract(b), b.subtract(a)]
    rows = [x.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, x in zip(("both", "orders", "events"), counts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


SEMI = """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT DISTINCT user_id AS id FROM events)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'orders', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'events', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""


def parcel_attach(spark, sf):
    """The last order of each customer, attached to customers by id."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "r.o_orderkey", "r.o_orderstatus")


ATTACH = """WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN l ON c_custkey = o_custkey"""


def zip_overlap_counts(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("zip")).distinct()
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("zip")).join(s, "zip", "left_semi").groupBy("zip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zip")


ZIP_OVERLAP = "SELECT c_nationkey AS zip, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1 ORDER BY n DESC, zip"


def coverage_report(spark, sf):
    p = participants(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("participant_id")).distinct().withColumn("seen", F.lit(True))
    g = p.join(o, "participant_id", "left").groupBy("county").agg(F.countDistinct("participant_id").alias("contacts"), V.count_where(F.col("seen")).alias("matched"), V.count_where(F.col("income").isNotNull()).alias("with_income"))
    return g.withColumn("pct", F.round(V.rate(F.col("matched"), F.col("contacts"), 100.0), 4))


COVERAGE = f"""WITH {PARTICIPANTS}, o AS (SELECT DISTINCT o_custkey FROM orders) SELECT county, count(DISTINCT participant_id) AS contacts, count(o_custkey) AS matched, count(income) AS with_income,
  round(count(o_custkey) * 100.0 / count(DISTINCT participant_id), 4) AS pct FROM participants LEFT JOIN o ON participant_id = o_custkey GROUP BY county"""


def projection_conform(spark, sf):
    """Two sources in one shape: names joined, statistics nested and read back."""
    c = campaigns(spark, sf)
    c = c.select("campaign_id", F.concat_ws(" - ", "agency", "name").alias("label"), F.struct(F.col("budget").alias("sent"), F.struct(F.floor("budget").alias("unique")).alias("opened")).alias("statistics"))
    return c.select("campaign_id", "label", F.round("statistics.sent", 2).alias("sent"), F.col("statistics.opened.unique").alias("opened"))


CONFORM = f"WITH {CAMPAIGNS} SELECT campaign_id, agency || ' - ' || name AS label, round(budget, 2) AS sent, CAST(floor(budget) AS BIGINT) AS opened FROM campaigns"


def name_match(spark, sf):
    p = table(spark, sf, "part")
    w = F.split("p_name", " ")
    first, last = T.person(F.initcap(w[0])), T.person(F.upper(w[1]))
    full = T.person(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit(" Jr."))).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", w[1], w[0])).otherwise(F.lit("someone else")))
    return p.select("p_partkey", T.name_match(first, last, full).alias("kind")).where("kind IS NOT NULL")


NAME_MATCH = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'exact' ELSE 'fuzzy' END AS kind FROM part WHERE p_partkey % 3 < 2"

QUERIES = {
    "cascade_best_match": (cascade_best_match, CASCADE),
    "score_cascade_match": (score_cascade_match, SCORE_CASCADE),
    "match_report": (match_report, MATCH_REPORT),
    "multi_county_rank": (multi_county_rank, MULTI_COUNTY),
    "range_resolution": (range_resolution, RANGES),
    "best_snapshot": (best_snapshot, SNAPSHOT),
    "left_join_suffix_merge": (left_join_suffix_merge, LEFT_JOIN),
    "join_fallback_group_mean": (join_fallback_group_mean, FALLBACK),
    "lookup_default_unknown": (lookup_default_unknown, LOOKUP),
    "coalesce_lookup_priority": (coalesce_lookup_priority, PRIORITY),
    "anti_unmatched": (anti_unmatched, ANTI),
    "semi_overlap": (semi_overlap, SEMI),
    "parcel_attach": (parcel_attach, ATTACH),
    "zip_overlap_counts": (zip_overlap_counts, ZIP_OVERLAP),
    "coverage_report": (coverage_report, COVERAGE),
    "projection_conform": (projection_conform, CONFORM),
    "name_match": (name_match, NAME_MATCH),
}
