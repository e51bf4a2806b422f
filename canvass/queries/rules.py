"""Normalisers, parsers, predicates and rules over the driver's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import text as T
from canvass.functions import values as V
from canvass.sources.domain import table

_ADDRESS = "CASE p_partkey % 4 WHEN 0 THEN p_size || '  North ' || p_name || ' Street' WHEN 1 THEN p_size || ' ' || p_name || ' Avenue, Southwest.' WHEN 2 THEN ' ' || upper(p_size || ' ' || p_name) || ' BOULEVARD' ELSE p_size || ' Streeter ' || p_name || ' Highway' END"


def _address():
    size, name, k = F.col("p_size").cast("string"), F.col("p_name"), F.col("p_partkey") % 4
    return (
        F.when(k == 0, F.concat(size, F.lit("  North "), name, F.lit(" Street"))).when(k == 1, F.concat(size, F.lit(" "), name, F.lit(" Avenue, Southwest.")))
        .when(k == 2, F.concat(F.lit(" "), F.upper(F.concat(size, F.lit(" "), name)), F.lit(" BOULEVARD"))).otherwise(F.concat(size, F.lit(" Streeter "), name, F.lit(" Highway")))
    )


def normalize_address(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", _address().alias("a"))
    n = T.address(F.col("a"))
    return p.select("p_partkey", n.alias("normal"), T.house_number(n).alias("house"), T.address_rest(n).alias("rest"), T.address_key(F.col("a")).alias("key"), T.address_upper(F.col("a"), [("STREET", "ST"), ("AVENUE", "AV"), ("BOULEVARD", "BLVD")]).alias("upper"), T.address_upper(F.col("a"), [(" STREET", " ST")], bounded=False).alias("loose"))


NORMALIZE_ADDRESS = rf"""WITH p AS (SELECT p_partkey, {_ADDRESS} AS a FROM part),
n AS (SELECT p_partkey, a, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(a)), '[,.]', '', 'g'), '\bstreet\b', 'st', 'g'), '\bavenue\b', 'ave', 'g'), '\bboulevard\b', 'blvd', 'g'), '\bhighway\b', 'hwy', 'g'), '\bnorth\b', 'n', 'g'), '\bsouthwest\b', 'sw', 'g'), '\s+', ' ', 'g')) AS normal FROM p)
SELECT p_partkey, normal, regexp_extract(normal, '^(\d+)', 1) AS house, trim(regexp_replace(normal, '^\d+', '')) AS rest, regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') AS key,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(upper(a)), '[.,]', '', 'g'), '\bSTREET\b', 'ST', 'g'), '\bAVENUE\b', 'AV', 'g'), '\bBOULEVARD\b', 'BLVD', 'g'), '\s+', ' ', 'g')) AS upper,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(upper(a)), '[.,]', '', 'g'), ' STREET', ' ST', 'g'), '\s+', ' ', 'g')) AS loose FROM n"""


def normalize_phone(spark, sf):
    d = F.concat(F.lit("614"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("1"), d)).when(k == 1, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).when(k == 2, F.concat(d, F.lit(".0"))).when(k == 3, F.substring(d, 4, 7)).otherwise(d)
    c = table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", T.phone(F.col("raw")).alias("phone"), T.phone_last10(F.col("raw")).alias("last10"), T.phone_last10(F.col("raw"), None).alias("digits"), T.email(F.concat(F.lit(" A"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "@Ex.ORG ").otherwise(" at ex"))).alias("email"))


NORMALIZE_PHONE = r"""WITH c AS (SELECT c_custkey, '614' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS d FROM customer),
r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '1' || d WHEN 1 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] WHEN 2 THEN d || '.0' WHEN 3 THEN d[4:10] ELSE d END AS raw FROM c),
n AS (SELECT *, regexp_replace(regexp_replace(raw, '\.0$', ''), '\D', '', 'g') AS x, regexp_replace(raw, '\D', '', 'g') AS y FROM r)
SELECT c_custkey, CASE WHEN length(x) = 11 AND starts_with(x, '1') THEN x[2:11] ELSE x END AS phone, CASE WHEN length(y) >= 10 THEN right(y, 10) ELSE '' END AS last10, CASE WHEN length(y) >= 10 THEN right(y, 10) ELSE y END AS digits,
  CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '@ex.org' END AS email FROM n"""


def normalize_zip(spark, sf):
    n = (F.lit(43000) + F.col("c_custkey") % 1000).cast("string")
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, F.concat(n, F.lit(".0"))).when(k == 1, F.concat(n, F.lit("-1234"))).when(k == 2, F.substring(n, 2, 4)).when(k == 3, F.lit("n/a")).when(k == 4, F.lit("")).otherwise(n)
    c = table(spark, sf, "customer").select("c_custkey", raw.alias("z"))
    z = F.col("z")
    number = T.zip_number(T.zip_head(z))
    return c.select("c_custkey", T.zip_digits(z).alias("digits"), T.zip_padded(z).alias("padded"), T.zip_head(z).alias("head"), number.alias("number"), F.coalesce(number.between(43000, 45999), F.lit(False)).alias("ohio"))


NORMALIZE_ZIP = r"""WITH c AS (SELECT c_custkey, CAST(43000 + c_custkey % 1000 AS VARCHAR) AS n FROM customer), r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN n || '.0' WHEN 1 THEN n || '-1234' WHEN 2 THEN n[2:5] WHEN 3 THEN 'n/a' WHEN 4 THEN '' ELSE n END AS z FROM c),
h AS (SELECT *, regexp_replace(z, '(\.0|-.*)$', '')[1:5] AS head FROM r)
SELECT c_custkey, nullif(regexp_replace(z, '\D', '', 'g')[1:5], '') AS digits, CASE WHEN length(z) < 5 THEN lpad(z, 5, '0') ELSE z END AS padded, head, TRY_CAST(head AS INTEGER) AS number, coalesce(TRY_CAST(head AS INTEGER) BETWEEN 43000 AND 45999, false) AS ohio FROM h"""


def route_variations(spark, sf):
    p = table(spark, sf, "part")
    kind = F.element_at(F.array(*map(F.lit, ["OH-", "us ", "SR - ", "State Route ", "Main St "])), (F.col("p_partkey") % 5 + 1).cast("int"))
    a = F.concat(kind, F.col("p_size").cast("string"))
    return p.select("p_partkey", F.array_join(T.route_variations(a), "|").alias("forms"))


ROUTES = """WITH p AS (SELECT p_partkey, ['OH-','us ','SR - ','State Route ','Main St '][p_partkey % 5 + 1] || p_size AS a, p_partkey % 5 AS k, p_size AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN a || '|OH ' || n || '|SR ' || n || '|STATE ROUTE ' || n WHEN 1 THEN a || '|US ' || n || '|US HIGHWAY ' || n || '|US-' || n WHEN 2 THEN a || '|SR ' || n || '|STATE ROUTE ' || n || '|OH ' || n ELSE a END AS forms FROM p"""


def hyphen_variations(spark, sf):
    p = table(spark, sf, "part")
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    a = F.when(k == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" Rd"))).when(k == 1, F.concat(n, F.lit("-"), n, F.lit(" Oak St"))).when(k == 2, F.concat(F.lit("A-B-"), n)).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.array_join(T.hyphen_variations(a), "|").alias("forms"))


HYPHENS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') || ' Rd|' || p_name || ' Rd|' || split_part(p_name, ' ', 2) || ' Rd|' || split_part(p_name, ' ', 1)
  WHEN 1 THEN p_size || '-' || p_size || ' Oak St' WHEN 2 THEN 'A-B-' || p_size || '|A B ' || p_size ELSE p_name END AS forms FROM part"""

_NAMES = ["MVCAP_Daily_Cost_", "OHCAC_Summer_Crisis_", "IMPACT_Webinar_", "COAD_Your_Home_Selected_", "Acme_Monthly_Savings_", "OHCA_Improve_", "Plain_"]


def _campaign_name():
    day = F.concat(F.lit("202505"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"))
    kind = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return F.concat(kind, F.when(F.col("s_suppkey") % 11 == 0, F.lit("undated")).otherwise(day), F.when(F.col("s_suppkey") % 5 == 0, F.lit(" (copy)")).otherwise(""))


_NAME_SQL = f"{_NAMES!r}[s_suppkey % 7 + 1] || CASE WHEN s_suppkey % 11 = 0 THEN 'undated' ELSE '202505' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') END || CASE WHEN s_suppkey % 5 = 0 THEN ' (copy)' ELSE '' END"


def agency_from_name(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", _campaign_name().alias("name"))
    n = F.col("name")
    return s.select("s_suppkey", T.agency(n).alias("agency"), T.keyword(n).alias("keyword"), T.category(n).alias("category"), V.date_in_name(n).cast("string").alias("strict_day"), V.date_in_name(n, False).cast("string").alias("day"), F.coalesce(F.month(V.date_in_name(n, False)), F.lit(6)).alias("month"), F.weekday(V.date_in_name(n, False)).alias("weekday"))


AGENCY = rf"""WITH s AS (SELECT s_suppkey, {_NAME_SQL} AS name, upper({_NAME_SQL}) AS u, lower({_NAME_SQL}) AS l FROM supplier),
d AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(name, '\d{{8}}') THEN regexp_replace(regexp_extract(name, '(\d{{8}})', 1), '(....)(..)(..)', '\1-\2-\3') END AS DATE) AS d, TRY_CAST(CASE WHEN regexp_matches(name, '_\d{{8}}(_|$)') THEN regexp_replace(regexp_extract(name, '(\d{{8}})', 1), '(....)(..)(..)', '\1-\2-\3') END AS DATE) AS sd FROM s)
SELECT s_suppkey, CASE WHEN contains(u, 'OHCAC') THEN 'OHCAC' WHEN contains(u, 'MVCAP') THEN 'MVCAP' WHEN contains(u, 'IMPACT') THEN 'IMPACT' WHEN contains(u, 'COAD') THEN 'COAD' END AS agency,
  CASE WHEN contains(l, 'webinar') THEN 'webinar' WHEN contains(l, 'crisis') THEN 'crisis' WHEN contains(l, 'savings') THEN 'savings' WHEN contains(l, 'daily_cost') THEN 'daily_cost' WHEN contains(l, 'monthly') THEN 'monthly' WHEN contains(l, 'improve') THEN 'improve' WHEN contains(l, 'surge') THEN 'surge' END AS keyword,
  CASE s_suppkey % 7 WHEN 0 THEN 'cost_framing' WHEN 1 THEN 'urgency' WHEN 2 THEN 'event' WHEN 3 THEN 'personalization' WHEN 4 THEN 'savings_framing' WHEN 5 THEN 'improvement' ELSE 'other' END AS category,
  CAST(sd AS VARCHAR) AS strict_day, CAST(d AS VARCHAR) AS day, CAST(coalesce(month(d), 6) AS INTEGER) AS month, CAST(isodow(d) - 1 AS INTEGER) AS weekday FROM d"""


def template_extract(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", _campaign_name().alias("name"))
    subject = F.concat(F.lit("Dear  {{First"), F.col("s_suppkey").cast("string"), F.lit("}} of {{City}} "))
    return s.select("s_suppkey", T.template(F.col("name")).alias("template"), T.subject(subject).alias("subject"), T.file_name(F.concat(F.lit(".a/b:"), F.col("name"), F.lit("? "))).alias("file"), T.shortened(F.col("name"), 12).alias("short"))


TEMPLATE = rf"""WITH s AS (SELECT s_suppkey, {_NAME_SQL} AS name FROM supplier)
SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(name, '^(OHCAC?|IMPACT|MVCAP|COAD)_', ''), '_\d{{8}}.*$', ''), '\s*\(copy\)$', '')) AS template, 'Dear {{{{VAR}}}} of {{{{VAR}}}}' AS subject,
  replace(('a_b_' || name || '_')[1:50], ' ', '_') AS file, CASE WHEN length(name) > 12 THEN name[1:12] || '...' ELSE name END AS short FROM s"""


def sms_name_parse(spark, sf):
    s = table(spark, sf, "supplier")
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Text"), n, F.lit("_Time_Running_Out_IMPACT_morning"))).when(k == 1, F.concat(F.lit("Text"), n, F.lit("_Money_OHCAC"))).when(k == 2, F.concat(F.lit("Text"), n, F.lit("_Improvements"))).otherwise(F.lit("Other_name"))
    return s.select("s_suppkey", T.sms_name(name).alias("p")).select("s_suppkey", "p.*")


SMS = """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN CAST(s_suppkey AS INTEGER) END AS number, CASE s_suppkey % 4 WHEN 0 THEN 'Time_Running_Out' WHEN 1 THEN 'Money' WHEN 2 THEN 'Improvements' END AS message_key,
  CASE s_suppkey % 4 WHEN 0 THEN 'IMPACT' WHEN 1 THEN 'OHCAC' WHEN 2 THEN 'NA' END AS agency, CASE s_suppkey % 4 WHEN 0 THEN 'morning' END AS time_variant FROM supplier"""


def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


_strip = "html"
for _tag in ("script", "style", "head", "title"):
    _strip = rf"regexp_replace({_strip}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"
_strip = f"regexp_replace({_strip}, '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _strip = f"replace({_strip}, '{_e}', '{_c}')"
HTML = rf"SELECT page_id, trim(regexp_replace({_strip}, '\s+', ' ', 'g')) AS text FROM pages"


def currency_parse(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).when(k == 1, F.lit("")).when(k == 2, F.lit("-1")).when(k == 3, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", V.currency(raw).alias("value"), V.currency(raw, -1.0).alias("with_default"), V.number(V.currency(raw, -1.0)).alias("known"))


CURRENCY = """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN round(o_totalprice, 2) WHEN 2 THEN -1.0 WHEN 4 THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, v AS value, coalesce(v, -1.0) AS with_default, nullif(coalesce(v, -1.0), -1.0) AS known FROM v"""


def timestamp_parse(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT-0000"))).when(k == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.date_format("o_orderdate", "HH:mm:ss"), F.lit("Z"))).when(k == 2, F.lit("soon")).otherwise(F.lit(None))
    t = V.timestamp(raw)
    return o.select("o_orderkey", t.alias("at"), F.expr("datediff(date'2000-01-01', o_orderdate)").cast("long").alias("days"), F.date_format(t, "yyyy-MM-dd").alias("day"))


TIMESTAMP = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN date_trunc('second', o_orderdate) END AS "at", date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""


def yes_no_flags(spark, sf):
    e = table(spark, sf, "events")
    raw = F.element_at(F.array(*map(F.lit, ["Yes", " yes ", "No", "", "YES"])), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", T.yes(raw).alias("loose"), (raw == "Yes").alias("strict"), T.yes_no(T.yes(raw)).alias("out"))


YES_FLAGS = """WITH r AS (SELECT event_id, ['Yes', ' yes ', 'No', '', 'YES'][event_id % 5 + 1] AS x FROM events) SELECT event_id, lower(trim(x)) = 'yes' AS loose, x = 'Yes' AS strict, CASE WHEN lower(trim(x)) = 'yes' THEN 'Yes' ELSE 'No' END AS out FROM r"""


def null_canonical(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 4
    n = F.when(k == 0, F.lit(-1.0)).when(k == 1, F.lit(float("nan"))).when(k == 2, None).otherwise(F.col("c_acctbal"))
    t = F.when(k == 0, F.lit("NA")).when(k == 1, F.lit(" ")).when(k == 2, None).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", V.number(n).alias("number"), V.text(t).alias("text"))


NULLS = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_acctbal END AS number, CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment END AS text FROM customer"


def predicate_suite(spark, sf):
    """Each predicate counted, all in one pass (``pushed_filters`` has filters that reach the scan)."""
    o = table(spark, sf, "orders")
    tests = {
        "equal": F.col("o_orderstatus") == "F", "known": F.col("o_orderpriority").isNotNull(), "in": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "or": (F.col("o_totalprice") > 400000) | (F.col("o_orderstatus") == "P"), "range": F.col("o_totalprice").between(100000, 200000),
        "before": F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "pattern": F.col("o_orderpriority").rlike("(?i)urgent"), "member": F.array_contains(F.array(F.lit("F"), F.lit("O")), F.col("o_orderstatus")),
    }
    one = o.agg(*(V.count_where(c).alias(n) for n, c in tests.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("predicate"), F.col(n).alias("n")) for n in tests))))


PREDICATES = """SELECT unnest(['equal','known','in','or','range','before','pattern','member']) AS predicate, unnest([count(*) FILTER (WHERE o_orderstatus = 'F'), count(o_orderpriority), count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')),
  count(*) FILTER (WHERE o_totalprice > 400000 OR o_orderstatus = 'P'), count(*) FILTER (WHERE o_totalprice BETWEEN 100000 AND 200000), count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01'), count(*) FILTER (WHERE regexp_matches(o_orderpriority, '(?i)urgent')), count(*) FILTER (WHERE o_orderstatus IN ('F','O'))]) AS n FROM orders"""


def pushed_filters(spark, sf):
    """Equality, membership, range and time as one filter, which the scan applies to its row groups."""
    o = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(100000, 200000) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


PUSHED = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1"


def filter_modes(spark, sf):
    """mode 'engaged': viewed or clicked; then users with at least 20 rows."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click") & F.col("value").isNotNull())
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most")).where("n >= 20")


FILTER_MODES = "SELECT user_id, count(*) AS n, round(max(value), 4) AS most FROM events WHERE event_type IN ('view','click') AND value IS NOT NULL GROUP BY user_id HAVING count(*) >= 20"


def page_then_filter(spark, sf):
    """A page is cut first and filtered then, so it can be short."""
    return table(spark, sf, "events").orderBy("ts", "event_id").offset(100).limit(50).where("event_type <> 'error'").select("event_id", "event_type")


PAGE_FILTER = "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100) WHERE event_type <> 'error'"


def house_age_rule(spark, sf):
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit(1900) + F.col("p_size")).when(F.col("p_partkey") % 3 == 1, F.col("p_size")).otherwise(-1)
    h = V.house_age(raw, 2025)
    return p.select("p_partkey", h.alias("h"), V.age_bracket(raw).alias("bracket"), F.round(V.burden_percent(F.col("p_size") / 40), 6).alias("burden"), V.flag(F.substring("p_type", 1, 1), "E", "S").alias("owner")).select("p_partkey", "h.*", "bracket", "burden", "owner")


HOUSE_AGE = """WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 1900 + p_size WHEN 1 THEN p_size END AS a FROM part)
SELECT p_partkey, CAST(CASE WHEN a > 1800 THEN a ELSE 2025 - a END AS INTEGER) AS year_built, CAST(CASE WHEN a > 1800 THEN 2025 - a ELSE a END AS INTEGER) AS house_age, a || '-' || (a + 1) AS bracket,
  round(CASE WHEN p_size / 40.0 <= 1 THEN p_size / 40.0 * 100 ELSE p_size / 40.0 END, 6) AS burden, CASE p_type[1] WHEN 'E' THEN true WHEN 'S' THEN false END AS owner FROM p"""


def inverse_logit(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(V.logistic(F.col("value") / 50 - 1), 6).alias("p"), F.round(F.exp(F.col("value") / 100), 6).alias("odds_ratio"))


INVERSE_LOGIT = "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 6) AS p, round(exp(value / 100), 6) AS odds_ratio FROM events"


def entropy_maxprob(spark, sf):
    """Of each user's shares of event types: entropy and the largest."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").count()
    n = e.groupBy("user_id").agg(F.collect_list(F.col("count").cast("double")).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    n = n.withColumn("p", F.transform("c", lambda x: x / total))
    return n.select("user_id", F.round(-F.aggregate("p", F.lit(0.0), lambda a, x: a + x * F.log(x)), 6).alias("entropy"), F.round(F.array_max("p"), 6).alias("max_prob"))


ENTROPY = "WITH e AS (SELECT user_id, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) SELECT user_id, round(-sum(CAST(p AS DOUBLE) * ln(CAST(p AS DOUBLE))), 6) AS entropy, round(max(CAST(p AS DOUBLE)), 6) AS max_prob FROM e GROUP BY user_id"


def pct_diff(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("b"))
    return e.select("event_type", F.round((F.col("a") - F.col("b")) / (F.col("b") + 1e-10) * 100, 5).alias("pct"))


PCT_DIFF = "WITH e AS (SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS a, avg(CASE WHEN user_id % 2 = 1 THEN value END) AS b FROM events GROUP BY 1) SELECT event_type, round((a - b) / (b + 1e-10) * 100, 5) AS pct FROM e"

QUERIES = {
    "normalize_address": (normalize_address, NORMALIZE_ADDRESS),
    "normalize_phone": (normalize_phone, NORMALIZE_PHONE),
    "normalize_zip": (normalize_zip, NORMALIZE_ZIP),
    "route_variations": (route_variations, ROUTES),
    "hyphen_variations": (hyphen_variations, HYPHENS),
    "agency_from_name": (agency_from_name, AGENCY),
    "template_extract": (template_extract, TEMPLATE),
    "sms_name_parse": (sms_name_parse, SMS),
    "html_to_text": (html_to_text, HTML),
    "currency_parse": (currency_parse, CURRENCY),
    "timestamp_parse": (timestamp_parse, TIMESTAMP),
    "yes_no_flags": (yes_no_flags, YES_FLAGS),
    "null_canonical": (null_canonical, NULLS),
    "predicate_suite": (predicate_suite, PREDICATES),
    "pushed_filters": (pushed_filters, PUSHED),
    "filter_modes": (filter_modes, FILTER_MODES),
    "page_then_filter": (page_then_filter, PAGE_FILTER),
    "house_age_rule": (house_age_rule, HOUSE_AGE),
    "inverse_logit": (inverse_logit, INVERSE_LOGIT),
    "entropy_maxprob": (entropy_maxprob, ENTROPY),
    "pct_diff": (pct_diff, PCT_DIFF),
}
