"""Statistics of clusters, outcomes and posterior draws."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass import storage
from canvass.functions import values as V
from canvass.operators import order
from canvass.operators import statistics as S
from canvass.sources.domain import exposures, participants, table


def _outcomes(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "toxic", "lang", "source", "n_chars")


def chi_square_yates(spark, sf):
    """Of toxic against quality (two by two) and of toxic against language."""
    o = _outcomes(spark, sf)
    rows = [S.chi_square_of(o, g, "toxic").select(F.lit(g).alias("by"), F.round("chi2", 5).alias("chi2"), "df", "n") for g in ("quality", "lang")]
    return rows[0].unionByName(rows[1])


_CHI = """SELECT '{g}' AS by, round(sum(power(gap - CASE WHEN r = 2 AND c = 2 THEN least(0.5, gap) ELSE 0 END, 2) / e), 5) AS chi2, CAST((max(r) - 1) * (max(c) - 1) AS INTEGER) AS df, CAST(sum(o) AS BIGINT) AS n FROM (
  SELECT o, e, abs(o - e) AS gap, r, c FROM (SELECT coalesce(o, 0) AS o, sum(coalesce(o, 0)) OVER (PARTITION BY g) * sum(coalesce(o, 0)) OVER (PARTITION BY t) / sum(coalesce(o, 0)) OVER () AS e, (SELECT count(DISTINCT {g}) FROM x) AS r, (SELECT count(DISTINCT toxic) FROM x) AS c
  FROM (SELECT DISTINCT {g} AS g FROM x) CROSS JOIN (SELECT DISTINCT toxic AS t FROM x) LEFT JOIN (SELECT {g} AS g, toxic AS t, count(*) AS o FROM x GROUP BY 1, 2) USING (g, t)))"""
CHI = "WITH x AS (SELECT * FROM labels JOIN documents USING (doc_id)) " + _CHI.format(g="quality") + " UNION ALL " + _CHI.format(g="lang")


def t_test(spark, sf):
    """Lengths of toxic against other documents, and of good against bad."""
    o = _outcomes(spark, sf)
    out = []
    for g in ("toxic", "quality"):
        m = lambda k, f: f(F.when(F.col(g) == k, F.col("n_chars")))  # noqa: E731, B023
        one = o.agg(m(1, F.count).alias("n1"), m(1, F.avg).alias("m1"), m(1, F.var_samp).alias("v1"), m(0, F.count).alias("n0"), m(0, F.avg).alias("m0"), m(0, F.var_samp).alias("v0"))
        pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
        t = (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))
        out.append(one.select(F.lit(g).alias("by"), F.round("m1", 3).alias("high"), F.round("m0", 3).alias("low"), F.round(t, 5).alias("t"), (F.col("n1") + F.col("n0") - 2).alias("df")))
    return out[0].unionByName(out[1])


_T = """SELECT '{g}' AS by, round(m1, 3) AS high, round(m0, 3) AS low, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 5) AS t, n1 + n0 - 2 AS df FROM (
  SELECT count(*) FILTER (WHERE {g} = 1) AS n1, avg(n_chars) FILTER (WHERE {g} = 1) AS m1, var_samp(n_chars) FILTER (WHERE {g} = 1) AS v1, count(*) FILTER (WHERE {g} = 0) AS n0, avg(n_chars) FILTER (WHERE {g} = 0) AS m0, var_samp(n_chars) FILTER (WHERE {g} = 0) AS v0 FROM labels JOIN documents USING (doc_id))"""
T_TEST = _T.format(g="toxic") + " UNION ALL " + _T.format(g="quality")


def silhouette_exact(spark, sf):
    """Mean silhouette (Euclidean) per label over all vectors.  Distances of all
    pairs are the definition, and they are taken, block against block."""
    from canvass.operators import clusters

    points = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    s = clusters.silhouette(points, "vec_id", "x", "label")
    return s.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


SILHOUETTE = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS s FROM e a CROSS JOIN e b GROUP BY ALL),
m AS (SELECT d.*, CASE WHEN own = other THEN s / nullif(n.n - 1, 0) ELSE s / n.n END AS mean FROM d JOIN n ON d.other = n.label),
q AS (SELECT vec_id, own, max(mean) FILTER (WHERE own = other) AS a, min(mean) FILTER (WHERE own <> other) AS b FROM m GROUP BY 1, 2)
SELECT own AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q GROUP BY 1"""


def adjusted_rand(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 7).alias("other"), F.when(F.col("vec_id") % 10 == 0, 99).otherwise(F.col("label")).alias("near"))
    rows = [S.adjusted_rand(e, "label", k).select(F.lit(k).alias("against"), F.round("ari", 8).alias("ari")) for k in ("other", "near")]
    out = rows[0].unionByName(rows[1])
    return out.withColumn("stability", V.stability_label(F.col("ari")))


_ARI = """SELECT '{k}' AS against, round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 8) AS ari FROM (SELECT
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM e GROUP BY label, {k})) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM e GROUP BY label)) AS i,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM e GROUP BY {k})) AS j, (SELECT count(*) * (count(*) - 1) / 2 FROM e) AS t)"""
ARI = "WITH e AS (SELECT label, vec_id % 7 AS other, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS near FROM embeddings), a AS (" + _ARI.format(k="other") + " UNION ALL " + _ARI.format(k="near") + ") SELECT *, CASE WHEN ari > 0.85 THEN 'Highly Stable' WHEN ari > 0.7 THEN 'Stable' WHEN ari > 0.5 THEN 'Moderately Stable' ELSE 'Unstable' END AS stability FROM a"


def hdi_interval(spark, sf):
    e = table(spark, sf, "events")
    return order.shortest_interval(e, "value", ["event_type"], 0.94).select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


HDI = """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, CAST(floor(count(*) OVER (PARTITION BY event_type) * 0.94) AS BIGINT) AS w FROM events),
p AS (SELECT a.event_type, a.value AS lo, b.value AS hi FROM x a JOIN x b ON a.event_type = b.event_type AND b.k = a.k + a.w)
SELECT event_type, round(lo, 6) AS lo, round(hi, 6) AS hi FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY hi - lo, lo) = 1"""


def segment_contrast(spark, sf):
    """How often one type's draw is above another's, draw by draw."""
    e = order.ranks(table(spark, sf, "events"), ["event_type"], "event_id", ["value"]).withColumnRenamed("rank", "draw")
    a, b = e.select("draw", F.col("event_type").alias("one"), F.col("value").alias("x")), e.select("draw", F.col("event_type").alias("other"), F.col("value").alias("y"))
    return a.join(b, "draw").where("one < other").groupBy("one", "other").agg(F.round(F.avg((F.col("x") > F.col("y")).cast("int")), 6).alias("p_higher"), F.count("*").alias("draws"))


CONTRAST = """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS draw FROM events)
SELECT a.event_type AS one, b.event_type AS other, round(avg(CAST(a.value > b.value AS INTEGER)), 6) AS p_higher, count(*) AS draws FROM e a JOIN e b USING (draw) WHERE a.event_type < b.event_type GROUP BY 1, 2"""


def odds_ratio(spark, sf):
    """Mean, spread, odds ratio and whether the middle 89 % exclude zero."""
    e = table(spark, sf, "events").select("event_type", ((F.col("value") - 20) / 100).alias("b"))
    g = e.groupBy("event_type").agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("sd"))
    g = g.join(order.percentiles(e, ["event_type"], "b", [0.055, 0.945]), "event_type")
    return g.select("event_type", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.exp("mean"), 6).alias("odds_ratio"), F.round((F.exp("mean") - 1) * 100, 4).alias("pct_effect"), (F.col("q")[0] * F.col("q")[1] > 0).alias("credible"))


ODDS = """SELECT event_type, round(avg(b), 6) AS mean, round(stddev_pop(b), 6) AS sd, round(exp(avg(b)), 6) AS odds_ratio, round((exp(avg(b)) - 1) * 100, 4) AS pct_effect, quantile_cont(b, 0.055) * quantile_cont(b, 0.945) > 0 AS credible FROM (SELECT event_type, (value - 20) / 100 AS b FROM events) GROUP BY 1"""


def rhat(spark, sf):
    e = table(spark, sf, "events").withColumn("chain", F.col("user_id") % 4)
    r = S.r_hat(e, "value", "chain", ["event_type"])
    return r.select("event_type", F.round("r_hat", 6).alias("r_hat"), "chains", (F.col("r_hat") < 1.01).alias("converged"))


RHAT = """WITH c AS (SELECT event_type, user_id % 4 AS chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT event_type, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS r, count(*) AS chains FROM c GROUP BY 1)
SELECT event_type, round(r, 6) AS r_hat, chains, r < 1.01 AS converged FROM g"""


def percentile_interval(spark, sf):
    e = table(spark, sf, "events")
    q = order.percentiles(e, ["event_type"], "value", [0.03, 0.5, 0.97])
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")).join(q, "event_type").select("event_type", "mean", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("lo", "mid", "hi"))))


PERCENTILE = "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.03), 6) AS lo, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.97), 6) AS hi FROM events GROUP BY 1"


def cluster_outcome(spark, sf):
    c = table(spark, sf, "customer").withColumn("cluster", F.col("c_custkey") % 6)
    g = c.groupBy("cluster").agg(V.count_where(F.col("c_acctbal") < 0).alias("engaged"), F.round(F.avg((F.col("c_acctbal") < 0).cast("int")), 6).alias("rate"), F.count("*").alias("n"))
    return g.withColumn("pct_of_total", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 4))


OUTCOME = "SELECT c_custkey % 6 AS cluster, count(*) FILTER (WHERE c_acctbal < 0) AS engaged, round(avg(CAST(c_acctbal < 0 AS INTEGER)), 6) AS rate, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct_of_total FROM customer GROUP BY 1"


def cluster_profile_mode(spark, sf):
    """Mean of the number and mode of the category, ties to the first by name."""
    c = table(spark, sf, "customer").withColumn("cluster", F.col("c_custkey") % 6)
    counts = c.groupBy("cluster", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    return counts.groupBy("cluster").agg(F.round(F.sum("s") / F.sum("n"), 4).alias("mean"), F.min_by("c_mktsegment", F.struct((-F.col("n")).alias("k"), "c_mktsegment")).alias("mode"))


PROFILE_MODE = """WITH k AS (SELECT c_custkey % 6 AS cluster, c_mktsegment AS m, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1, 2), t AS (SELECT cluster, round(sum(s) / sum(n), 4) AS mean FROM k GROUP BY 1)
SELECT cluster, mean, m AS mode FROM k JOIN t USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, m) = 1"""


def binned_confidence(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.col("value") / 100)
    b = F.when(F.col("p") <= 0.5, "(0,.5]").when(F.col("p") <= 0.7, "(.5,.7]").when(F.col("p") <= 0.9, "(.7,.9]").otherwise("(.9,1]")
    return e.where("p > 0 AND p <= 1").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "click").cast("int")), 6).alias("rate"))


BINNED = "SELECT CASE WHEN value / 100 <= 0.5 THEN '(0,.5]' WHEN value / 100 <= 0.7 THEN '(.5,.7]' WHEN value / 100 <= 0.9 THEN '(.7,.9]' ELSE '(.9,1]' END AS bin, count(*) AS n, round(avg(CAST(event_type = 'click' AS INTEGER)), 6) AS rate FROM events WHERE value > 0 AND value <= 100 GROUP BY 1"

def best_k(spark, sf):
    """Customers of each segment cut into 2 to 6 regions: the number whose regions
    part their balances best (by the variance ratio), and the share explained."""
    c = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", F.col("c_acctbal").alias("y"), F.explode(F.sequence(F.lit(2), F.lit(6))).alias("k"))
    cells = c.groupBy("c_mktsegment", "k", F.floor(F.col("c_nationkey") * F.col("k") / 25).alias("region")).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    g = cells.groupBy(F.col("c_mktsegment").alias("phase"), "k").agg(F.sum("n").alias("n"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("total"))
    g = g.withColumns({"ratio": (F.col("total") - F.col("within")) / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k"))), "share": 1 - F.col("within") / F.col("total")})
    best = g.groupBy("phase").agg(F.max_by(F.struct("k", "share"), F.struct("ratio", (-F.col("k")).alias("j"))).alias("b"))
    return best.select("phase", F.col("b.k").alias("best_k"), F.round("b.share", 6).alias("share"), V.silhouette_label(F.col("b.share")).alias("label"))


BEST_K = """WITH c AS (SELECT c_mktsegment AS phase, c_nationkey, CAST(c_acctbal AS DOUBLE) AS y, CAST(unnest(range(2, 7)) AS INTEGER) AS k FROM customer),
cells AS (SELECT phase, k, floor(c_nationkey * k / 25) AS region, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM c GROUP BY ALL),
g AS (SELECT phase, k, sum(n) AS n, sum(q - s * s / n) AS within, sum(q) - sum(s) * sum(s) / sum(n) AS total FROM cells GROUP BY 1, 2)
SELECT phase, k AS best_k, round(1 - within / total, 6) AS share, CASE WHEN 1 - within / total > 0.7 THEN 'Strong' WHEN 1 - within / total > 0.5 THEN 'Reasonable' WHEN 1 - within / total > 0.25 THEN 'Weak' ELSE 'Poor' END AS label
FROM g QUALIFY row_number() OVER (PARTITION BY phase ORDER BY (total - within) / (k - 1) / (within / (n - k)) DESC, k) = 1"""


def posterior_summary(spark, sf):
    """Four chains for a logistic model of toxic documents by language: mean, spread,
    shortest interval, odds ratio, and whether the chains agree (R-hat, effective draws)."""
    from canvass.operators import bayes

    o = _outcomes(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("successes"))
    grouped = o.select(F.array(F.lit(1.0), *((F.col("lang") == x).cast("double") for x in ("de", "es", "fr"))).alias("x"), F.col("n").cast("double").alias("n"), F.col("successes").cast("double").alias("successes"))
    draws = bayes.sample_chains(grouped, 4, [-2.0, 0.0, 0.0, 0.0], [1.0, 0.5, 0.5, 0.5], draws=1000)
    draws = storage.kept(draws, "draws")
    means = draws.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    found = means.join(order.shortest_interval(draws, "value", ["param"], 0.94), "param").join(S.r_hat(draws, "value", "chain", ["param"]), "param").join(bayes.effective_size(draws), "param")
    name = F.element_at(F.array(*map(F.lit, ("intercept", "de", "es", "fr"))), F.col("param") + 1)
    return found.select(name.alias("param"), *(F.round(c, 4).alias(c) for c in ("mean", "sd", "lo", "hi", "r_hat")), F.round(F.exp("mean"), 4).alias("odds_ratio"), ((F.col("r_hat") < 1.01) & (F.col("ess") > 400)).alias("converged"))


def parameter_join(spark, sf):
    """Parameters of a fitted model beside the campaign that the number in their
    name stands for."""
    p = table(spark, sf, "part").select(F.format_string("alpha_open[%d]", "p_partkey").alias("name"), ((F.col("p_size") - 25) / 10).alias("mean"))
    p = p.withColumn("index", F.regexp_extract("name", r"^[a-z_]+\[(\d+)\]$", 1).try_cast("long"))
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("index"), F.col("s_name").alias("campaign"), (F.col("s_acctbal") / 10000).alias("observed"))
    return p.join(c, "index").select("index", "name", "campaign", F.round("mean", 4).alias("mean"), F.round(F.col("observed") - V.logistic(F.col("mean")), 6).alias("gap"))


PARAMETERS = """SELECT p_partkey AS index, 'alpha_open[' || p_partkey || ']' AS name, s_name AS campaign, round((p_size - 25) / 10, 4) AS mean, round(CAST(s_acctbal AS DOUBLE) / 10000 - 1 / (1 + exp(-(p_size - 25) / 10)), 6) AS gap FROM part JOIN supplier ON s_suppkey = p_partkey"""


def category_importance(spark, sf):
    """Effects by category of their name, those whose interval excludes zero marked."""
    p = table(spark, sf, "part").select(F.concat(F.element_at(F.array(*map(F.lit, ["alpha_open[", "msg_type_effect_open[", "month_effect_open[", "beta_cost_open[", "mu["])), (F.col("p_partkey") % 5 + 1).cast("int")), "p_partkey", F.lit("]")).alias("name"), ((F.col("p_size") - 25) / 10).alias("mean"), (F.col("p_retailprice") / 1000).alias("sd"))
    n = F.col("name")
    cat = F.when(n.startswith("alpha_open["), "campaign_intercept").when(n.startswith("msg_type_effect_open"), "message_type").when(n.startswith("month_effect_open"), "temporal").when(n.startswith("beta_") & n.contains("_open"), "offer_characteristic").otherwise("other")
    sure = ((F.col("mean") - 1.6 * F.col("sd")) * (F.col("mean") + 1.6 * F.col("sd"))) > 0
    g = p.groupBy(cat.alias("category")).agg(F.round(F.max(F.abs("mean")), 6).alias("most"), F.round(F.avg(F.abs("mean")), 6).alias("mean"), F.round(F.avg(sure.cast("int")) * 100, 4).alias("pct_significant"), F.count("*").alias("n"))
    return g.orderBy(F.desc("mean"))


IMPORTANCE = """SELECT ['campaign_intercept','message_type','temporal','offer_characteristic','other'][p_partkey % 5 + 1] AS category, round(max(abs(m)), 6) AS most, round(avg(abs(m)), 6) AS mean, round(avg(CAST((m - 1.6 * s) * (m + 1.6 * s) > 0 AS INTEGER)) * 100, 4) AS pct_significant, count(*) AS n
FROM (SELECT p_partkey, CAST(p_size - 25 AS DOUBLE) / 10 AS m, p_retailprice / 1000 AS s FROM part) GROUP BY 1"""

_SEGMENTS = [("low income, high burden", -0.8, 1.1), ("low income, low burden", -0.8, -0.5), ("high income, low burden", 1.2, -0.5)]


def segment_grid(spark, sf):
    """Each segment's predicted rate over the draws, and a grid of burdens."""
    s = spark.createDataFrame(_SEGMENTS, "segment string, income double, burden double")
    grid = s.where("segment = 'low income, high burden'").select("income", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(F.format_string("burden %d", "i").alias("segment"), "income", (F.col("i") / 2 - 1).alias("burden"))
    draws = table(spark, sf, "events").where("event_type = 'click'").select(((F.col("value") - 20) / 100).alias("b"), F.col("event_id").alias("draw"))
    p = V.logistic(-1 + F.col("b") * F.col("income") + 0.3 * F.col("burden"))
    # The segments are eight literal rows, sent to every draw.
    rows = draws.join(F.broadcast(s.unionByName(grid)), F.lit(True)).select("segment", p.alias("p"))
    return rows.groupBy("segment").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("sd"))


SEGMENT_GRID = """WITH s(segment, income, burden) AS (VALUES ('low income, high burden', -0.8, 1.1), ('low income, low burden', -0.8, -0.5), ('high income, low burden', 1.2, -0.5), ('burden 0', -0.8, -1.0), ('burden 1', -0.8, -0.5), ('burden 2', -0.8, 0.0), ('burden 3', -0.8, 0.5), ('burden 4', -0.8, 1.0)),
p AS (SELECT segment, 1 / (1 + exp(-(-1 + (value - 20) / 100 * CAST(income AS DOUBLE) + 0.3::DOUBLE * CAST(burden AS DOUBLE)))) AS p FROM s CROSS JOIN (SELECT value FROM events WHERE event_type = 'click'))
SELECT segment, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS sd FROM p GROUP BY 1"""


def profile_zscore(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    w = W.partitionBy()
    return g.select("c_mktsegment", F.round((F.col("m") - F.avg("m").over(w)) / F.stddev_samp("m").over(w), 5).alias("z"))


PROFILE_Z = "WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, round((m - avg(m) OVER ()) / stddev_samp(m) OVER (), 5) AS z FROM g"


def cumulative_share(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    rows = W.orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, 0)
    return g.select("o_orderpriority", F.round(F.sum("v").over(rows) / F.sum("v").over(W.partitionBy()), 8).alias("share"))


CUMULATIVE = "WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, round(sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 8) AS share FROM g"


def median_split(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.avg("c_acctbal").alias("r"))
    m = g.agg(F.median("r").alias("m"))
    return g.join(F.broadcast(m), F.lit(True)).select("cluster", F.when(F.col("r") > F.col("m"), "high").otherwise("low").alias("side"))


MEDIAN_SPLIT = "WITH g AS (SELECT c_nationkey AS cluster, avg(c_acctbal) AS r FROM customer GROUP BY 1) SELECT cluster, CASE WHEN r > (SELECT median(r) FROM g) THEN 'high' ELSE 'low' END AS side FROM g"


def kmeans_sweep(spark, sf):
    from canvass.operators import clusters

    return clusters.kmeans_sweep(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", range(2, 6))


def gmm_bic(spark, sf):
    from canvass.operators import clusters

    return clusters.gmm_sweep(table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 6).alias("embedding")), "embedding", range(2, 5))


def _prototype_rows(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("balance"), "c_mktsegment", (F.col("c_nationkey") % 5).cast("string").alias("region"))


def kprototypes(spark, sf):
    from canvass.operators import clusters

    return clusters.kprototypes(_prototype_rows(spark, sf), "c_custkey", ["balance"], ["c_mktsegment", "region"], k=3)[0]


def kprototypes_sweep(spark, sf):
    from canvass.operators import clusters

    return clusters.kprototypes_sweep(_prototype_rows(spark, sf), "c_custkey", ["balance"], ["c_mktsegment", "region"], range(2, 5), starts=4, rounds=10)


def _mixed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 11).cast("double").alias("n"), "c_mktsegment")


def famd_variance(spark, sf):
    from canvass.operators import famd

    found = famd.fit(_mixed(spark, sf), ["c_acctbal", "n"], ["c_mktsegment"], 5)
    total = 0.0
    rows = [(i + 1, round(float(s), 8), round(total := total + float(s), 8)) for i, s in enumerate(found.shares)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")


def famd_coordinates(spark, sf):
    """Where customers lie on the first axes of their balance, number and segment."""
    from canvass.operators import famd

    c = _mixed(spark, sf)
    found = famd.coordinates(c, "c_custkey", famd.fit(c, ["c_acctbal", "n"], ["c_mktsegment"], 3))
    return found.select("c_custkey", *(F.round(f"f{j}", 6).alias(f"f{j}") for j in range(3)))


def logistic_map(spark, sf):
    from canvass.operators import bayes

    x = _outcomes(spark, sf).select(F.col("toxic").cast("double").alias("y"), F.log1p("n_chars").alias("length"), (F.col("lang") == "en").cast("double").alias("english"))
    return bayes.logistic_map(x, "y", ["length", "english"], intercept=(-3.5, 1.0), slope=(0.0, 0.5))


def messaging_effectiveness(spark, sf):
    """Opening, and clicking once opened: effects of campaigns around their mean, of
    message type, place and month, and of the savings named."""
    from canvass.operators import hierarchy

    e = exposures(spark, sf).join(participants(spark, sf), "participant_id")
    e = e.select("campaign_id", "channel", "county", F.month("sent_at").alias("month"), "savings", "opened", "clicked")
    found = hierarchy.two_stages(e, "opened", "clicked", "campaign_id", {"channel": 0.5, "county": 0.3, "month": 0.2}, {"savings": 0.3}, close=1e-3)
    return found.select("stage", "kind", "name", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def dirichlet_mixture(spark, sf):
    """Customers' likeliest component of a mixture that finds the number itself."""
    from canvass.operators import mixture

    c = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 5000, (F.col("c_nationkey") / 12).cast("double")).alias("x"))
    model, _ = mixture.fit(c, "x", components=10, rounds=25)
    found = mixture.predict(c, "c_custkey", "x", model)
    return found.select("c_custkey", "component", F.round("probability", 4).alias("probability"), F.round("entropy", 4).alias("entropy"))


def loo_comparison(spark, sf):
    """Two models of customers' balances, one mean for all and one for each segment,
    ranked by leave-one-out density over draws of their posteriors."""
    from canvass.operators import bayes

    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("y"))
    spread = c.agg(F.stddev_samp("y").alias("s"))
    u = lambda j: (F.pmod(F.xxhash64("draw", "segment", F.lit(j)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    models = c.select("c_custkey", "y", F.explode(F.array(F.struct(F.lit("one mean").alias("model"), F.lit("").alias("segment")), F.struct(F.lit("by segment").alias("model"), F.col("c_mktsegment").alias("segment")))).alias("m")).select("c_custkey", "y", "m.*")
    # A row a model, segment and draw: some thousand, whatever the number of customers.
    means = models.groupBy("model", "segment").agg(F.avg("y").alias("mean"), F.count("*").alias("n")).join(F.broadcast(spread), F.lit(True)).select("*", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("draw"))
    draws = means.select("model", "segment", "s", (F.col("mean") + F.col("s") / F.sqrt("n") * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))).alias("mu"))
    # A row a model and segment, with all draws of it.
    draws = draws.groupBy("model", "segment").agg(F.first("s").alias("s"), F.sort_array(F.collect_list("mu")).alias("mu"))
    log_lik = F.transform("mu", lambda m: -0.5 * F.pow((F.col("y") - m) / F.col("s"), 2) - F.log("s") - 0.9189385332046727)
    each = bayes.loo_rows(models.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey").join(F.broadcast(draws), ["model", "segment"]).select("model", "c_custkey", log_lik.alias("l")), ["model", "c_custkey"], "l")
    ranked = S.ranked(bayes.loo_total(each, "model"), "elpd")
    return ranked.select("model", F.round("elpd", 4).alias("elpd"), F.round("se", 4).alias("se"), F.round("worst_k", 3).alias("worst_k"), "unsure", "rank", F.round("diff", 4).alias("diff"))


def bootstrap_ari(spark, sf):
    """Whether k-means on resamples finds the clusters of all rows again."""
    from canvass.operators import clusters

    found = clusters.bootstrap_stability(table(spark, sf, "embeddings"), "vec_id", "embedding", 3, times=5)
    return found.withColumn("stability", V.stability_label(F.col("ari")))


def cluster_memberships(spark, sf):
    """Customers' likeliest component and its probabilities, for a later model."""
    from canvass.operators import clusters

    c = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 5000, (F.col("c_nationkey") / 12).cast("double")).alias("x"))
    return clusters.memberships(c, "c_custkey", "x", 3)


def pca_coordinates(spark, sf):
    from canvass.operators import clusters

    return clusters.principal_axes(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


def gower_to_segments(spark, sf):
    """Gower distance of customers to the first customer of each segment."""
    from canvass.operators import clusters

    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("income"), (F.col("c_nationkey") * 2).cast("double").alias("place"), "c_mktsegment")
    # One row a segment, of which there are five.
    first = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey")).select("c_custkey").join(c, "c_custkey")
    return clusters.gower(c, "c_custkey", ["income", "place"], ["c_mktsegment"], first).select("a", "b", F.round("distance", 6).alias("distance"))


GOWER = """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS income, CAST(c_nationkey * 2 AS DOUBLE) AS place, c_mktsegment AS m FROM customer),
s AS (SELECT max(income) - min(income) AS si, max(place) - min(place) AS sp FROM c), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY m ORDER BY c_custkey) = 1)
SELECT c.c_custkey AS a, f.c_custkey AS b, round((coalesce(abs(c.income - f.income) / si, 0) + abs(c.place - f.place) / sp + CAST(c.m <> f.m AS INTEGER)) / (2 + CAST(c.income IS NOT NULL AND f.income IS NOT NULL AS INTEGER)), 6) AS distance FROM c, f, s"""

QUERIES = {
    "chi_square_yates": (chi_square_yates, CHI),
    "t_test": (t_test, T_TEST),
    "silhouette_exact": (silhouette_exact, SILHOUETTE),
    "adjusted_rand": (adjusted_rand, ARI),
    "hdi_interval": (hdi_interval, HDI),
    "segment_contrast": (segment_contrast, CONTRAST),
    "odds_ratio": (odds_ratio, ODDS),
    "rhat": (rhat, RHAT),
    "percentile_interval": (percentile_interval, PERCENTILE),
    "cluster_outcome": (cluster_outcome, OUTCOME),
    "cluster_profile_mode": (cluster_profile_mode, PROFILE_MODE),
    "binned_confidence": (binned_confidence, BINNED),
    "best_k": (best_k, BEST_K),
    "posterior_summary": (posterior_summary, None),
    "parameter_join": (parameter_join, PARAMETERS),
    "category_importance": (category_importance, IMPORTANCE),
    "segment_grid": (segment_grid, SEGMENT_GRID),
    "profile_zscore": (profile_zscore, PROFILE_Z),
    "cumulative_share": (cumulative_share, CUMULATIVE),
    "median_split": (median_split, MEDIAN_SPLIT),
    "kmeans_sweep": (kmeans_sweep, None),
    "gmm_bic": (gmm_bic, None),
    "kprototypes": (kprototypes, None),
    "kprototypes_sweep": (kprototypes_sweep, None),
    "famd_variance": (famd_variance, None),
    "famd_coordinates": (famd_coordinates, None),
    "logistic_map": (logistic_map, None),
    "messaging_effectiveness": (messaging_effectiveness, None),
    "dirichlet_mixture": (dirichlet_mixture, None),
    "loo_comparison": (loo_comparison, None),
    "bootstrap_ari": (bootstrap_ari, None),
    "cluster_memberships": (cluster_memberships, None),
    "pca_coordinates": (pca_coordinates, None),
    "gower_to_segments": (gower_to_segments, GOWER),
}
