"""Whole jobs: star schema from files, merges, and the stream against the batch."""

import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from canvass.operators import merge
from canvass.plans import phases, star_schema
from canvass.sources import files
from canvass.streaming import sync
from canvass.streaming.table import KeyedTable

from .conftest import SMALL


def write_campaign(folder, cid, name, rows):
    lines = [",".join(files.EXPORT)]
    for r in rows:
        lines.append(",".join(f'"{r.get(c, "")}"' for c in files.EXPORT))
    (folder / f"campaign_{cid}_{name}.csv").write_text("\n".join(lines) + "\n")


def test_star_schema(spark, tmp_path):
    write_campaign(tmp_path, "a1", "MVCAP_Daily_Cost_20250514", [{"email": "A@e.org", "opened": "Yes", "clicked": " yes ", "kwh": "11000", "zip": "43001.0"}, {"cell": "614-555-0100"}, {"city": "nowhere"}, {"email": "a@e.org", "opened": "No"}])
    write_campaign(tmp_path, "b2", "Other_x", [{"email": "a@e.org", "address": "12 Main Street", "annual_savings": "$1,200.50"}])
    zips = spark.createDataFrame([("43001", "A")], "zip5 string, county string")
    dem = spark.createDataFrame([("A", 1, "a@e.org", "x", None, "43001")], "county string, parcel_id long, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([], "county string, parcel_id long, address string, zip string")
    out = star_schema.build(spark, str(tmp_path), zips, dem, res)
    c = {r["campaign_id"]: r for r in out["campaigns"].collect()}
    assert (c["a1"]["agency"], c["a1"]["category"], str(c["a1"]["sent_at"]), c["a1"]["total_sent"]) == ("MVCAP", "cost_framing", "2025-05-14", 2)
    assert c["b2"]["agency"] is None
    assert c["b2"]["sent_at"] is None
    p = {r["participant_id"]: r for r in out["participants"].collect()}
    assert set(p) == {"a@e.org", "6145550100"}
    assert p["a@e.org"]["source_campaigns"] == ["a1", "b2"]
    assert p["a@e.org"]["address"] == "12 Main Street"
    assert out["exposures"].count() == 3


def test_phases(spark, tmp_path):
    """A dry run writes nothing and counts the same; phases go one by one."""
    (tmp_path / "in").mkdir()
    write_campaign(tmp_path / "in", "a1", "MVCAP_Daily_Cost_20250514", [{"email": "A@e.org", "opened": "Yes", "zip": "43001"}, {"cell": "614-555-0100"}])
    zips = spark.createDataFrame([("43001", "A")], "zip5 string, county string")
    dem = spark.createDataFrame([("A", 1, "a@e.org", "x", None, "43001")], "county string, parcel_id long, email string, full_name string, phone string, zip string")
    res = spark.createDataFrame([], "county string, parcel_id long, address string, zip string")
    build = phases.Build(spark, str(tmp_path / "in"), str(tmp_path / "out"), zips, dem, res)
    want = {"campaigns": 1, "exposures": 2, "people": 2, "matches": 2, "participants": 2, "statistics": 1}
    assert build.run(dry=True) == want and not (tmp_path / "out").exists()
    assert build.run(("import",)) == {k: want[k] for k in ("campaigns", "exposures", "people")}
    assert build.run(("stats", "match")) == {k: want[k] for k in ("matches", "statistics")}
    assert build.run(("summarize",)) == {"participants": 2}
    assert {r.participant_id: r.quality for r in build.table("participants").collect()} == {"a@e.org": "demographic", "6145550100": "no_county"}
    with pytest.raises(ValueError, match="phase"):
        build.run(("import", "mail"))


def test_export_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_campaign(tmp_path / "in", "a1", "N_20250101", [{"email": "a@e.org", "opened": "Yes", "annual_cost": "$5"}])
    rows = files.read_campaigns(spark, str(tmp_path / "in"))
    files.write_export(files.typed(rows), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert (back["opened"], back["clicked"], back["email"]) == ("Yes", "No", "a@e.org")
    people = spark.createDataFrame([("A@e.org", "Ann", "B"), ("a@e.org", "Amy", "A")], "email string, customer_name string, county string")
    e = files.enriched(rows, people).collect()
    assert [(r["customer_name"], r["opened"]) for r in e] == [("Amy", 1)]


def test_merges(spark):
    old = spark.createDataFrame([(1, True, "a", 1), (2, False, "b", 1)], "k int, f boolean, v string, t int")
    new = spark.createDataFrame([(1, False, "c", 2), (3, True, "d", 2)], "k int, f boolean, v string, t int")
    flags = sorted(map(tuple, merge.merge_flags(old, new, ["k"], ["f"], "t").select("k", "f", "v", "t").collect()))
    assert flags == [(1, True, "c", 2), (2, False, "b", 1), (3, True, "d", 2)]
    assert flags == sorted(map(tuple, merge.merge_flags(merge.merge_flags(old, new, ["k"], ["f"], "t").select(*old.columns), new, ["k"], ["f"], "t").select("k", "f", "v", "t").collect()))
    assert sorted(r["k"] for r in merge.insert_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    assert {r["k"]: r["v"] for r in merge.upsert(old, new, ["k"], "t").collect()} == {1: "c", 2: "b", 3: "d"}


def test_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SMALL)
    q = sync.fold_stream(stream).writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    order = lambda d: sorted(map(tuple, d.select("user_id", "event_type", "high", "very_high", "n").collect()))
    assert order(spark.table("folded")) == order(sync.fold_events(spark.read.parquet(f"{SMALL}/events.parquet")))


def test_stream_forgets_old_events(spark, tmp_path):
    """With a watermark a repeat within it counts once, and old state goes."""
    at = lambda minute: datetime.datetime(2025, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    for k, rows in enumerate([[(1, 1, "a", 60.0, at(0)), (2, 1, "a", 95.0, at(5))], [(1, 1, "a", 60.0, at(8)), (3, 2, "a", 1.0, at(600))], [(4, 2, "a", 1.0, at(605))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    q = sync.fold_stream(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("late").select("user_id", "n").collect())) == [(1, 2), (2, 2)]
    state = q.lastProgress["stateOperators"][-1]
    assert state["operatorName"] == "dedupeWithinWatermark" and state["numRowsTotal"] == 2


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Batches, a replay, a crash before the manifest, late rows; what is written
    follows the batch."""
    target, keys = f"{tmp_path}/t", ["k"]
    t = KeyedTable(spark, target, keys, buckets=16)
    fold = lambda old, new, seen: merge.merge_flags(old, new, keys, ["f"], "at", seen)
    batch = lambda rows: spark.createDataFrame(rows, "k long, f boolean, v string, at int")
    size = lambda n: sum(f.stat().st_size for f in Path(f"{target}/data/version={n:012d}").rglob("*.parquet"))
    t.merge(0, batch([(k, False, "a" * 50, 5) for k in range(2000)]), fold)
    whole = size(0)
    assert t.merge(1, batch([(7, True, "b", 6), (5000, False, "c", 1)]), fold)["seen"] == {"inserted": 1, "updated": 1, "unchanged": 0}
    assert 0 < size(1) < whole / 4
    monkeypatch.setattr(t, "_write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        t.merge(2, batch([(8, True, "x", 7)]), fold)
    monkeypatch.undo()
    assert t.batches() == [0, 1] and {r.v for r in t.latest().where("k = 8").collect()} == {"a" * 50}
    assert t.merge(2, batch([(8, True, "d", 7), (7, False, "old", 1)]), fold)["seen"] == {"inserted": 0, "updated": 1, "unchanged": 1}
    again = sorted(map(tuple, t.latest().collect()))
    t.merge(2, batch([(9, True, "not this", 9)]), fold)  # delivered again
    assert t.merge(3, batch([]), fold)["versions"] == t.manifest(2)["versions"]
    want = {k: (k, False, "a" * 50, 5) for k in range(2000)} | {7: (7, True, "b", 6), 8: (8, True, "d", 7), 5000: (5000, False, "c", 1)}
    assert again == sorted(want.values()) == sorted(map(tuple, t.latest().collect()))
    assert t.batches() == [2, 3]
    named = set(map(int, t.manifest(3)["versions"].values()))
    assert named == {int(p.name[8:]) for p in Path(f"{target}/data").iterdir()}
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, target, keys, buckets=8).latest()


def test_incremental_sync(spark, tmp_path):
    land, target = tmp_path / "land", str(tmp_path / "table")
    land.mkdir()
    page = lambda kind, ids: json.dumps({"campaign_id": "c", "report_type": kind, "page": 1, "synced_at": "2025-01-01T00:00:00", "data": [{"id": i} for i in ids]})
    (land / "1.json").write_text(page("clicked", ["x"]) + "\n" + page("bounced", ["y", "y"]))
    run = lambda: sync.start(spark, files.read_reports(spark, str(land), stream=True), target, str(tmp_path / "state")).awaitTermination(120)
    run()
    (land / "2.json").write_text(page("opened", ["y", "z"]))
    run()
    (land / "0.json").write_text(page("complained", ["x"]))  # a late file, and all of the first once more
    (land / "3.json").write_text((land / "1.json").read_text())
    run()
    whole = sync.reports_to_flags(files.read_reports(spark, str(land)))
    assert sorted(map(tuple, sync.latest(spark, target).collect())) == sorted(map(tuple, whole.collect()))
    (land / "0.json").unlink(), (land / "3.json").unlink()
    got = {r["contact_id"]: (r["opened"], r["clicked"], r["bounced"]) for r in sync.latest(spark, target).collect()}
    assert got == {"x": (True, True, False), "y": (True, False, True), "z": (True, False, False)}
    assert files.read_reports(spark, str(land)).count() == 4
    c = spark.createDataFrame([("a", None), ("b", datetime.datetime(2025, 1, 1)), ("c", datetime.datetime(2025, 1, 2))], "id string, synced_at timestamp_ntz")
    assert {r["id"] for r in sync.stale(c, 12, datetime.datetime(2025, 1, 2, 6)).collect()} == {"a", "b"}

