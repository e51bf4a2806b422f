"""That what a query does grows with its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canvass import storage
from canvass.operators import bayes, clusters, containment, hierarchy, linkage
from canvass.queries import matching

from .conftest import SMALL

CONTACT = "contact_id long, county string, email string, first string, last string, phone string, address string, zip string"


def below_join(frame):
    """Whether the right side of the plan's join is grouped before it joins."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" in plan[plan.index("Join") :]


def test_alike_parcels_meet_a_contact_once(spark):
    con = spark.createDataFrame([(i, "A", "a@b", "Ann", "Lee", "6145550100", "1 Elm Street", "43001") for i in range(20)], CONTACT)
    dem = spark.createDataFrame([("A", i, "a@b", "ann lee", "6145550100", "43001") for i in range(5, 45)], "county string, parcel_id long, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([("A", i, "1 Elm Street", "43001") for i in range(5, 45)], "county string, parcel_id long, address string, zip string")
    hits = linkage.candidates(con, dem, res).collect()
    assert len(hits) < 20 * 10 and {h.parcel_id for h in hits} == {5}
    assert {(r.parcel_id, r.method) for r in linkage.score_cascade(con, dem, res).collect()} == {(5, "address_phone")}


@pytest.mark.parametrize("every", [True, False])
def test_contacts_and_parcels_of_one_address_are_one_pair(spark, monkeypatch, every):
    """Whatever their phones and names are, and with a ZIP code or without."""
    pairs, alike = [], linkage._alike
    monkeypatch.setattr(linkage, "_alike", lambda own, other: (rows := alike(own, other), pairs.append(rows.count()))[0])
    con = spark.createDataFrame([(i, "A", None, "Ann", f"Lee{i}", f"61455501{i:02}", "1 Elm Street", "43001" if i % 2 else None) for i in range(30)], CONTACT)
    dem = spark.createDataFrame([("A", i, None, f"ann lee{i}", f"61455501{i:02}", "43001") for i in range(5, 45)], "county string, parcel_id long, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([("A", i, "1 Elm St.", "43001") for i in range(5, 45)], "county string, parcel_id long, address string, zip string")
    got = {(r.contact_id, r.parcel_id, r.method) for r in linkage.score_cascade(con, dem, res, all_counties=every).collect()}
    assert got == {(i, 5, "address") if i < 5 else (i, i, "address_phone") for i in range(30)}
    assert pairs == [2]


def test_names_are_grouped_before_they_join(spark):
    con = spark.createDataFrame([(1, "A", "Ann", "Lee", "43001"), (2, "A", "Ann", "Lee", "43009"), (3, "A", "Ann", "Lee", None), (4, "B", "Ann", "Lee", None)], "contact_id long, county string, first string, last string, zip string")
    dem = spark.createDataFrame([("A", 7, "ANN LEE", "43001"), ("A", 8, "ANN LEE", "43001"), ("A", 5, "ANN LEE", "43002")], "county string, parcel_id long, full_name string, zip string")
    found = linkage.name_key_match(con, dem)
    assert below_join(found)
    assert sorted(map(tuple, found.collect())) == [(1, "A", 7, True), (2, "A", 5, False), (3, "A", 5, False)]


def test_address_keys_are_counted_before_they_join(spark):
    assert below_join(matching.address_key_join(spark, SMALL))


def test_pieces_are_not_collected_for_a_broadcast(spark):
    rows = spark.range(50).select(F.lit("A").alias("county"), F.md5(F.col("id").cast("string")).alias("text"))
    plan = containment.met(rows.select("county", F.col("text").alias("short")), rows.select("county", F.col("text").alias("long")), ["county"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 4


def test_loo_of_rows_is_that_of_groups(spark):
    r = np.random.default_rng(3)
    l = r.normal(-1, 0.5, (12, 60))
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(l)] + [(99, [None])], "i long, l array<double>")
    long = wide.select("i", F.explode("l").alias("l"))
    got = {x.i: (x.elpd, x.k) for x in bayes.loo_rows(wide, ["i"], "l").collect()}
    want = {x.i: (x.elpd, x.k) for x in bayes.loo(long, ["i"], "l").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_blocks_of_the_silhouette_are_large():
    assert [clusters._blocks(n, None) for n in (0, 2000, 12_000, 100_000, 1_600_000)] == [1, 1, 6, 8, 100]


def test_a_task_sums_its_rows_by_start_and_cluster():
    batch = pa.RecordBatch.from_pydict({"n0": [0.0, 1.0, 9.0], "c0": ["x", None, "y"], "one": [1, 1, 1]})
    prototypes = {4: [({"v": 0.0}, {"c": "x"}), ({"v": 9.0}, {"c": "y"})]}
    (out,) = clusters._assigned(prototypes, ["v"], ["c"], 1.5)(iter([batch]))
    got = {tuple(r.values()) for r in out.to_pylist()}
    assert got == {(4, 0, -1, None, 2, 2.5), (4, 0, 0, None, 2, 1.0), (4, 1, -1, None, 1, 0.0), (4, 1, 0, None, 1, 9.0), (4, 0, 1, "x", 1, 0.0), (4, 0, 1, None, 1, 0.0), (4, 1, 1, "y", 1, 0.0)}


def test_rows_of_both_stages_are_written_once(spark, monkeypatch):
    names, kept = [], storage.kept
    monkeypatch.setattr(storage, "kept", lambda rows, name="step": names.append(name) or kept(rows, name))
    rows = spark.range(300).select((F.col("id") % 5).alias("g"), (F.col("id") % 3 == 0).alias("opened"), (F.col("id") % 6 == 0).alias("clicked"), (F.col("id") % 2).cast("string").alias("f"))
    assert hierarchy.two_stages(rows, "opened", "clicked", "g", {"f": 0.5}, {}, rounds=2).count() == 2 * (3 + 1 + 5)
    assert names.count("observed") == 1 and "model" not in names
