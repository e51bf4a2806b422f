"""Containment joins and county cascades against plain loops, exports, stability."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.operators import clusters, containment, linkage
from canvass.queries import matching, rules
from canvass.sources import files

from .conftest import SMALL


@pytest.mark.parametrize("seed", [1, 2])
def test_either_contains(spark, monkeypatch, seed):
    monkeypatch.setattr(containment, "HOT", 3)  # salted pieces
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab -") for _ in range(r.choice([1, 2, 3, 5, 6, 7, 9])))
    own = [(r.choice("XY"), word(), r.random() < 0.7) for _ in range(80)]
    other = [(r.choice("XY"), word(), r.random() < 0.7) for _ in range(80)]
    a = spark.createDataFrame([*own, ("X", None, True), ("X", "", True), (None, "ab", True)], "county string, own string, around boolean")
    b = spark.createDataFrame([*other, ("X", None, True), ("X", "", True), (None, "ab", True)], "county string, other string, around boolean")
    got = containment.either(a, b, ["county"]).collect()
    want = {(c, x, y) for c, x, f in own for d, y, g in other if c == d and (x in y or (f and g and y in x))}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_one_house_number_on_half_the_parcels(spark):
    """What meets before it is compared stays in proportion to the input."""
    streets = [f"{a} {b} {c}" for a in ("long", "old", "new", "far") for b in ("meadow", "oak", "mill", "elm") for c in ("road", "lane", "court")]
    n = 4000
    parcels = spark.range(n).select(F.lit("").alias("county"), F.when(F.col("id") % 2 == 0, "1").otherwise((F.col("id") % 500).cast("string")).alias("house"), F.concat(F.element_at(F.array(*map(F.lit, streets)), (F.col("id") % len(streets)).cast("int") + 1), F.lit(" "), F.md5(F.col("id").cast("string"))).alias("long"))
    contacts = parcels.select("county", "house", F.substring("long", 1, 30).alias("short"))
    assert containment.met(contacts, parcels, ["county", "house"]).count() < 3 * n


def test_names_without_zip_and_routes(spark):
    con = spark.createDataFrame([(1, "A", None, "Ann", "Lee", None, None, None), (2, "A", None, None, None, None, "5 Oh-56", "43001"), (3, "A", None, None, None, None, "9 Mc-Rae Road", "43001")], "contact_id int, county string, email string, first string, last string, phone string, address string, zip string")
    dem = spark.createDataFrame([("A", 1, None, "ANN LEESON", None, "43009"), ("B", 2, None, "ANN LEE", None, "43009")], "county string, parcel_id int, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([("A", 7, "SR 56", "43002"), ("A", 8, "9 Mc Rae Road Apt 2", "43002")], "county string, parcel_id int, address string, zip string")
    got = {r.contact_id: (r.method, r.parcel_id) for r in linkage.match(con, dem, res).collect()}
    assert got == {1: ("name_exact", 1), 2: ("state_route", 7), 3: ("hyphenated", 8)}


def test_a_whole_route_comes_before_a_part_of_it(spark, tmp_path):
    """Route 1000400 holds the digits of 100040, and both lie in one county."""
    keys = [5, 40, 45, 900400]
    spark.createDataFrame([(k, "red gear") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.contact_id, r.match_county, r.parcel_id, r.method) for r in matching.route_hyphen_match(spark, str(tmp_path)).collect()}
    assert got == {(k, f"C{k % 40}", k, "hyphenated" if k % 2 else "state_route") for k in keys}
    con = spark.createDataFrame([(1, None, "a@b", None, None, None, "OH-560", None), (2, None, "a@b", None, None, None, "OH-5", None)], "contact_id int, county string, email string, first string, last string, phone string, address string, zip string")
    dem = spark.createDataFrame([], "county string, parcel_id int, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([("A", 1, "SR 56", "43001"), ("A", 2, "SR 560", "43001")], "county string, parcel_id int, address string, zip string")
    # Of two texts that each hold the route in part, the least parcel, as before.
    assert {(r.contact_id, r.parcel_id) for r in linkage.match_counties(con, dem, res).collect()} == {(1, 2), (2, 1)}


def test_counties_in_order(spark):
    contact = "contact_id int, county string, email string, first string, last string, phone string, address string, zip string"
    con = spark.createDataFrame([(1, None, "a@b", None, None, None, "1 Elm Street", "43001"), (2, None, "a@b", None, None, None, "1 Elm Street", None), (3, None, None, None, None, None, "1 Elm Street", None)], contact)
    dem = spark.createDataFrame([("A", 1, "a@b", None, None, "43001")], "county string, parcel_id int, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([("A", 1, "2 Oak Street", "43001"), ("B", 2, "1 Elm Street", "43001"), ("B", 3, "3 Elm Street", "43001")], "county string, parcel_id int, address string, zip string")
    got = {r.contact_id: (r.county, r.parcel_id, r.method) for r in linkage.match_counties(con, dem, res).collect()}
    # B has more parcels, so its address comes before A's e-mail; without a ZIP code and an e-mail nothing is tried.
    assert got == {1: ("B", 2, "address_exact"), 2: ("A", 1, "email")}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("Ann", "c", "A", True, None, False, 30, None, 1990), (" ", "c", "A", True, True, True, 1, 1, 1), (None, "c", "A", True, True, True, 1, 1, 1)], "name string, campaign string, county string, opened boolean, clicked boolean, applied boolean, age int, income int, year_built int")
    files.write_matched(rows, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == files.MATCHED and [tuple(r) for r in back.collect()] == [("Ann", "c", "A", "Yes", "No", "No", "30", None, "1990")]
    files.write_json(spark.createDataFrame([("x", ["b", "a"]), ("x", ["a", "c"]), (None, ["z"])], "campaign_id string, types array<string>"), str(tmp_path / "j"))
    assert [tuple(r) for r in files.read_classifications(spark, str(tmp_path / "j")).collect()] == [("x", ["a", "b", "c"])]


def test_stability_axes_memberships(spark):
    r = np.random.default_rng(0)
    points = np.concatenate([r.normal(0, 0.1, (40, 2)), r.normal(5, 0.1, (40, 2))])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, x array<double>")
    assert all(row.ari == 1 for row in clusters.bootstrap_stability(frame, "id", "x", 2, times=3).collect())
    got = clusters.principal_axes(frame, "id", "x").orderBy("id").collect()
    centred = points - points.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    v = v * np.sign(v[np.arange(2), np.abs(v).argmax(1)])[:, None]
    assert np.allclose([[a.c0, a.c1] for a in got], points @ v.T, atol=1e-6)
    soft = clusters.memberships(frame, "id", "x", 2).orderBy("id").collect()
    assert len({s.cluster_hard for s in soft[:40]}) == 1 and soft[0].cluster_hard != soft[-1].cluster_hard
    assert all((s.cluster_prob_0 > 0.5) == (s.cluster_hard == 0) for s in soft)


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rules.pushed_filters(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    for part in ("EqualTo(o_orderstatus,F)", "In(o_orderpriority", "GreaterThanOrEqual(o_totalprice", "LessThan(o_orderdate"):
        assert part in pushed
    assert plan.split("ReadSchema: struct<")[1].split(">")[0].count(":") == 4
