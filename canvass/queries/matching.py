"""Matching over several counties, by name and by address key, and what comes of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import places
from canvass.functions import text as T
from canvass.operators import linkage
from canvass.queries.linkage import _PARCELS, _parcels
from canvass.sources import files
from canvass.sources.domain import table

_COUNTY = "'K' || (p_partkey // 50) % 3"


def _wide(spark, sf):
    """Parcels whose ZIP codes lie in three counties each; some contacts have no
    ZIP code, some an address and a phone, some an address and a name."""
    con, dem, res = _parcels(spark, sf)
    county = lambda key: F.concat(F.lit("K"), (F.floor(F.col(key) / 50) % 3).cast("string"))
    con = con.withColumn("county", county("contact_id")).withColumn("zip", F.when(F.col("contact_id") % 11 != 0, F.col("zip")))
    return con, dem.withColumn("county", county("parcel_id")), res.withColumn("county", county("parcel_id"))


_WIDE = _PARCELS.split(",\nf AS")[0].replace("'C' || p_partkey % 5", _COUNTY).replace("43000 + p_partkey % 50 AS zip, CASE", "CASE WHEN p_partkey % 11 <> 0 THEN 43000 + p_partkey % 50 END AS zip, CASE")
_NAMED = "CASE WHEN contains(r.full_name, c.full_name) THEN 'name_exact' WHEN contains(r.full_name, split_part(c.full_name, ' ', 2)) AND (contains(r.full_name, split_part(c.full_name, ' ', 1)) OR starts_with(r.full_name, c.full_name[1])) THEN 'name_fuzzy' END"
_SCORE = "CASE WHEN c.k = r.k THEN 1.0 WHEN contains(trim(regexp_replace(c.k, '^\\d+', '')), trim(regexp_replace(r.k, '^\\d+', ''))) OR contains(trim(regexp_replace(r.k, '^\\d+', '')), trim(regexp_replace(c.k, '^\\d+', ''))) THEN CAST(least(length(trim(regexp_replace(c.k, '^\\d+', ''))), length(trim(regexp_replace(r.k, '^\\d+', '')))) AS DOUBLE) / greatest(length(trim(regexp_replace(c.k, '^\\d+', ''))), length(trim(regexp_replace(r.k, '^\\d+', '')))) ELSE 0.0 END"
_HOUSE = "regexp_extract(c.k, '^(\\d+)', 1) = regexp_extract(r.k, '^(\\d+)', 1)"


def county_cascade_match(spark, sf):
    """Contacts in the counties of their ZIP code, the one with most parcels first."""
    found = linkage.match_counties(*_wide(spark, sf))
    return found.select("contact_id", F.col("county").alias("match_county"), "parcel_id", "priority", "method", "quality", F.round("score", 6).alias("score"))


COUNTY_CASCADE = f"""WITH {_WIDE}, zc AS (SELECT zip, county, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, county) AS county_rank FROM res GROUP BY 1, 2),
h AS (SELECT contact_id, r.county, parcel_id, 0 AS county_rank, 1 AS priority, 'email' AS method, 'demographic' AS quality, 1.0 AS score FROM con c JOIN res r ON c.email = r.email WHERE c.zip IS NULL
  UNION ALL SELECT contact_id, r.county, parcel_id, county_rank, 1, 'email', 'demographic', 1.0 FROM con c JOIN res r ON c.email = r.email JOIN zc ON zc.zip = c.zip AND zc.county = r.county
  UNION ALL SELECT contact_id, r.county, parcel_id, county_rank, 2, {_NAMED}, 'demographic', 1.0 FROM con c JOIN res r ON c.zip = r.zip JOIN zc ON zc.zip = r.zip AND zc.county = r.county WHERE {_NAMED} IS NOT NULL
  UNION ALL SELECT contact_id, r.county, parcel_id, county_rank, 3, 'phone', 'demographic', 1.0 FROM con c JOIN res r ON c.phone = r.phone JOIN zc ON zc.zip = c.zip AND zc.county = r.county
  UNION ALL SELECT contact_id, r.county, parcel_id, county_rank, 4, 'address_exact', 'exact', 1.0 FROM con c JOIN res r ON c.zip = r.zip AND c.address = r.address JOIN zc ON zc.zip = r.zip AND zc.county = r.county
  UNION ALL SELECT contact_id, r.county, parcel_id, county_rank, 5, 'address_normalized', 'good', 1.0 FROM con c JOIN res r ON c.zip = r.zip AND c.k = r.k JOIN zc ON zc.zip = r.zip AND zc.county = r.county
  UNION ALL SELECT contact_id, r.county, parcel_id, county_rank, 8, printf('fuzzy_%.2f', {_SCORE}), 'fuzzy', {_SCORE} FROM con c JOIN res r ON c.zip = r.zip AND {_HOUSE} JOIN zc ON zc.zip = r.zip AND zc.county = r.county WHERE {_SCORE} > 0.7)
SELECT contact_id, county AS match_county, parcel_id, priority, method, quality, round(CAST(score AS DOUBLE), 6) AS score FROM h
QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY county_rank, county, priority, score DESC, parcel_id) = 1"""


def all_county_match(spark, sf):
    """The score cascade in all counties at once."""
    con, dem, res = _wide(spark, sf)
    kind, name = F.col("contact_id") % 7, F.split("p_name", " ")
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("contact_id"), "p_name")
    phone = F.concat(F.lit("614"), F.lpad(F.col("contact_id").cast("string"), 7, "0"))
    con = con.join(names, "contact_id").withColumns({"phone": F.when(kind.isin(1, 2), phone), "first": F.when(kind.isin(3, 4), name[0]), "last": F.when(kind.isin(3, 4), name[1])}).drop("p_name")
    out = linkage.score_cascade(con, dem, res, all_counties=True)
    return out.withColumn("score", F.round("score", 6)).withColumnRenamed("county", "match_county")


_ALL = _WIDE.replace("CASE WHEN p_partkey % 7 = 1 THEN '614'", "CASE WHEN p_partkey % 7 IN (1, 2) THEN '614'").replace("CASE WHEN p_partkey % 7 = 4 THEN lower", "CASE WHEN p_partkey % 7 IN (3, 4) THEN lower")
ALL_COUNTY = f"""WITH {_ALL}, g AS (SELECT contact_id, r.county, parcel_id, c.phone = r.phone AS same_phone, {_NAMED} AS named, {_SCORE} AS s FROM con c JOIN res r ON {_HOUSE} AND (c.zip IS NULL OR c.zip = r.zip) WHERE {_SCORE} > 0.7),
h AS (SELECT contact_id, county, parcel_id, 0 AS kind, 'address_phone' AS method, s AS score FROM g WHERE same_phone UNION ALL SELECT contact_id, county, parcel_id, 1, 'address', s FROM g
  UNION ALL SELECT contact_id, r.county, parcel_id, 2, 'phone', 1.0 FROM con c JOIN res r ON c.phone = r.phone
  UNION ALL SELECT contact_id, county, parcel_id, 3, 'name_address', CASE WHEN s = 1 AND named = 'name_exact' THEN 1.0 ELSE s * 0.9 END FROM g WHERE named IS NOT NULL),
o AS (SELECT *, CASE WHEN kind = 0 AND score = 1 THEN 0 WHEN kind = 2 THEN 1 ELSE 2 END AS f FROM h)
SELECT contact_id, county AS match_county, parcel_id, method, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN score = 1 THEN 'good' ELSE 'fuzzy' END AS quality FROM o
QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY f = 2, CASE WHEN f < 2 THEN 0 ELSE -score END, county, f, kind, parcel_id) = 1"""


def name_key_match(spark, sf):
    """Names FIRST LAST within a county, those of the ZIP code first; half of the
    contacts are written LAST, FIRST."""
    con, dem, _ = _wide(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("contact_id"), "p_name")
    word = F.split("p_name", " ")
    full = F.when(F.col("contact_id") % 2 == 0, F.concat(word[1], F.lit(", "), word[0])).otherwise(F.col("p_name"))
    parts = T.person_parts(full)
    zip_ = F.when(F.col("contact_id") % 3 == 0, "43999").otherwise(F.col("zip"))
    own = con.join(p, "contact_id").select("contact_id", "county", parts["first"].alias("first"), parts["last"].alias("last"), zip_.alias("zip"))
    return linkage.name_key_match(own, dem)


NAME_KEY = f"""WITH {_WIDE}, n AS (SELECT p_partkey AS contact_id, {_COUNTY} AS county, lower(p_name) AS full_name, CASE WHEN p_partkey % 3 = 0 THEN 43999 WHEN p_partkey % 11 <> 0 THEN 43000 + p_partkey % 50 END AS zip FROM part)
SELECT contact_id, n.county, parcel_id, coalesce(n.zip = r.zip, false) AS with_zip FROM n JOIN res r ON n.county = r.county AND n.full_name = r.full_name
QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY coalesce(n.zip = r.zip, false) DESC, parcel_id) = 1"""


def parcel_join(spark, sf):
    """Demographic and property records of one parcel, columns that both have told
    apart by a suffix; the last record of a parcel counts."""
    p = table(spark, sf, "part")
    demo = p.select((F.col("p_partkey") % 500).alias("parcel_id"), F.col("p_partkey").alias("record"), F.col("p_name").alias("owner"), F.col("p_size").alias("score"))
    prop = p.where("p_partkey % 3 <> 0").select((F.col("p_partkey") % 700).alias("parcel_id"), F.col("p_partkey").alias("record"), F.col("p_brand").alias("kind"), F.col("p_retailprice").alias("score"))
    out = linkage.parcel_records(demo, prop, "parcel_id", "record")
    return out.select("parcel_id", "owner", "kind", "score_demo", F.round("score_prop", 2).alias("score_prop"), "record_demo", "record_prop")


PARCEL_JOIN = """WITH d AS (SELECT p_partkey % 500 AS parcel_id, p_partkey AS record, p_name AS owner, p_size AS score FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey DESC) = 1),
r AS (SELECT p_partkey % 700 AS parcel_id, p_partkey AS record, p_brand AS kind, p_retailprice AS score FROM part WHERE p_partkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey DESC) = 1)
SELECT parcel_id, owner, kind, d.score AS score_demo, round(CAST(r.score AS DOUBLE), 2) AS score_prop, d.record AS record_demo, r.record AS record_prop FROM d JOIN r USING (parcel_id)"""


def route_hyphen_match(spark, sf):
    """State routes written in several ways, and streets with and without a hyphen."""
    p = table(spark, sf, "part")
    n, word = F.col("p_partkey").cast("string"), F.split("p_name", " ")
    county, route = F.concat(F.lit("C"), (F.col("p_partkey") % 40).cast("string")), F.col("p_partkey") % 2 == 0
    zip_ = F.lit("43001")
    res = p.select(county.alias("county"), F.col("p_partkey").alias("parcel_id"), F.when(route, F.concat(F.lit("STATE ROUTE "), F.col("p_partkey") + 100000)).otherwise(F.concat(n, F.lit(" "), word[0], F.lit(" "), word[1], n, F.lit(" Road"))).alias("address"), zip_.alias("zip"))
    con = p.select(F.col("p_partkey").alias("contact_id"), county.alias("county"), *(F.lit(None).cast("string").alias(c) for c in ("email", "first", "last", "phone")), F.when(route, F.concat(F.lit("OH-"), F.col("p_partkey") + 100000)).otherwise(F.concat(n, F.lit(" "), word[0], F.lit("-"), word[1], n, F.lit(" rd"))).alias("address"), F.lit("45000").alias("zip"))
    dem = res.select("county", "parcel_id", *(F.lit(None).cast("string").alias(c) for c in ("email", "full_name", "phone")), "zip")
    return linkage.match(con, dem, res).select("contact_id", "match_county", "parcel_id", "priority", "method", "quality")


ROUTE_HYPHEN = """SELECT p_partkey AS contact_id, 'C' || p_partkey % 40 AS match_county, p_partkey AS parcel_id, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 7 END AS priority, CASE WHEN p_partkey % 2 = 0 THEN 'state_route' ELSE 'hyphenated' END AS method, 'good' AS quality FROM part"""


def address_key_join(spark, sf):
    """Addresses of letters and digits alone, left joined; rows may fan out."""
    p = table(spark, sf, "part")
    own = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("-", F.col("p_size").cast("string"), F.replace("p_name", F.lit(" "), F.lit("."))))
    left = p.select(F.col("p_partkey").alias("contact_id"), T.address_key(F.coalesce(own, F.concat_ws(" ", F.col("p_size").cast("string"), F.upper("p_name")))).alias("key"))
    right = p.where("p_partkey % 4 <> 0").select(T.address_key(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name")).alias("key"), F.col("p_partkey").alias("parcel_id"))
    # Counted by key first: a key of many contacts and parcels makes no row a pair.
    found = right.where("key IS NOT NULL").groupBy("key").agg(F.count("parcel_id").alias("n"), F.min("parcel_id").alias("first_parcel"))
    return left.join(found, "key", "left").groupBy("contact_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.min("first_parcel").alias("first_parcel"))


ADDRESS_KEY = """WITH k AS (SELECT p_partkey, regexp_replace(upper(p_size || p_name), '[^A-Z0-9]', '', 'g') AS key FROM part)
SELECT a.p_partkey AS contact_id, count(b.p_partkey) AS n, min(b.p_partkey) AS first_parcel FROM k a LEFT JOIN (SELECT * FROM k WHERE p_partkey % 4 <> 0) b USING (key) GROUP BY 1"""

_CITIES = [*places.CITY_COUNTY, "nowhere", "elsewhere"]


def county_resolution(spark, sf):
    """County by own field, else city, else ZIP code; the city from the first of
    four columns that isn't empty."""
    k = F.col("c_custkey")
    city = F.element_at(F.array(*map(F.lit, _CITIES)), (k % len(_CITIES) + 1).cast("int"))
    at = lambda i: F.when(k % 4 == i, F.concat(F.lit(" "), F.upper(city))).otherwise(F.when(k % 3 == 0, "").cast("string"))
    zips = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("by_zip"))
    c = table(spark, sf, "customer").select(k, "c_nationkey", F.when(k % 10 == 0, "OwnCounty").alias("own"), places.first_text(*(at(i) for i in range(4))).alias("city"))
    c = c.withColumn("by_city", places.county_of_city(F.col("city"))).join(zips, "c_nationkey", "left")
    found = F.when(F.col("own").isNotNull(), "field").when(F.col("by_city").isNotNull(), "city").when(F.col("by_zip").isNotNull(), "zip").otherwise("none")
    return c.select("c_custkey", F.coalesce("own", "by_city", "by_zip", F.lit("Unknown")).alias("county"), found.alias("found_by"))


COUNTY_RESOLUTION = f"""WITH m(i, county) AS (VALUES {', '.join(f"({i}, '{places.CITY_COUNTY[c]}')" for i, c in enumerate(_CITIES) if c in places.CITY_COUNTY)})
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'OwnCounty' END, county, n_name, 'Unknown') AS county, CASE WHEN c_custkey % 10 = 0 THEN 'field' WHEN county IS NOT NULL THEN 'city' WHEN n_name IS NOT NULL THEN 'zip' ELSE 'none' END AS found_by
FROM customer LEFT JOIN m ON i = c_custkey % {len(_CITIES)} LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20"""


def zips_of_counties(spark, sf):
    """The different ZIP codes of a county's parcels."""
    _, _, res = _wide(spark, sf)
    return res.select("county", "zip").distinct().groupBy("county").agg(F.count("*").alias("n"), F.min("zip").alias("first"), F.max("zip").alias("last"))


ZIPS_OF = f"SELECT {_COUNTY} AS county, count(DISTINCT p_partkey % 50) AS n, CAST(min(43000 + p_partkey % 50) AS VARCHAR) AS first, CAST(max(43000 + p_partkey % 50) AS VARCHAR) AS last FROM part GROUP BY 1"


def matched_export(spark, sf):
    """The nine columns of matched contacts; rows without a name are left out."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    rows = p.select(
        F.when(k % 5 != 0, F.col("p_name")).alias("name"), F.col("p_brand").alias("campaign"), F.concat(F.lit("K"), (k % 3).cast("string")).alias("county"), (k % 2 == 0).alias("opened"), (k % 4 == 0).alias("clicked"),
        F.when(k % 8 != 0, k % 16 == 1).alias("applied"), F.when(k % 6 != 0, F.col("p_size")).cast("int").alias("age"), F.when(k % 7 != 0, (k * 10).cast("int")).alias("income"), (1900 + k % 100).cast("int").alias("year_built"),
    )
    return files.matched(rows)


MATCHED = """SELECT p_name AS "Name", p_brand AS "Campaign", 'K' || p_partkey % 3 AS "County", CASE WHEN p_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Opened", CASE WHEN p_partkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS "Clicked",
  CASE WHEN p_partkey % 16 = 1 THEN 'Yes' ELSE 'No' END AS "Applied", CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS "Age", CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey * 10 AS VARCHAR) ELSE '' END AS "Income", CAST(1900 + p_partkey % 100 AS VARCHAR) AS "YearBuilt"
FROM part WHERE p_partkey % 5 <> 0"""

QUERIES = {
    "county_cascade_match": (county_cascade_match, COUNTY_CASCADE),
    "parcel_join": (parcel_join, PARCEL_JOIN),
    "route_hyphen_match": (route_hyphen_match, ROUTE_HYPHEN),
    "all_county_match": (all_county_match, ALL_COUNTY),
    "name_key_match": (name_key_match, NAME_KEY),
    "address_key_join": (address_key_join, ADDRESS_KEY),
    "county_resolution": (county_resolution, COUNTY_RESOLUTION),
    "zips_of_counties": (zips_of_counties, ZIPS_OF),
    "matched_export": (matched_export, MATCHED),
}
