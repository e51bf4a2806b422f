"""The cascade on a small fixture that hits every strategy."""

import random
import re

import pytest

from canvass.operators import linkage

DEM = [("A", 1, "x@e.org", "DOE JANE", "6145550100", "43001"), ("A", 2, None, "john smith", None, "43001"), ("B", 3, "x@e.org", "zed", "6145550100.0", "43001")]
RES = [
    ("A", 10, "12 Main Street", "43001"), ("A", 11, "14 Oak Avenue", "43001"), ("A", 12, "900 STATE ROUTE 314", "43009"), ("A", 13, "77 New Athens Rd", "43009"),
    ("A", 14, "5 Long Meadow Lane East", "43001"), ("A", 15, "", "43001"), ("A", 16, "12 Main Street", "43002"),
]


def contact(i, county="A", email=None, first=None, last=None, phone=None, address=None, zip_="43001"):
    return (i, county, email, first, last, phone, address, zip_)


CONTACTS = [
    contact(1, email=" X@E.org "), contact(2, first="John", last="Smith Jr"), contact(3, phone="1 (614) 555-0100"), contact(4, address="12 Main Street"),
    contact(5, address="14 oak ave."), contact(6, address="OH-314", zip_=None), contact(7, address="Cadiz-New Athens Rd", zip_=None), contact(8, address="5 Long Meadow Lane"),
    contact(9, address="1 Nowhere"), contact(10, county=None, email="x@e.org"), contact(11, email="x@e.org", address="12 Main Street"), contact(12, county="B", phone="6145550100"), contact(13, address=" "),
]


def test_cascade(spark):
    c = spark.createDataFrame(CONTACTS, "contact_id long, county string, email string, first string, last string, phone string, address string, zip string")
    d = spark.createDataFrame(DEM, "county string, parcel_id long, email string, full_name string, phone string, zip string")
    r = spark.createDataFrame(RES, "county string, parcel_id long, address string, zip string")
    got = {m["contact_id"]: (m["method"], m["parcel_id"], m["quality"]) for m in linkage.match(c, d, r).collect()}
    assert got[1] == ("email", 1, "demographic")
    assert got[2] == ("name_exact", 2, "demographic")
    assert got[3] == ("phone", 1, "demographic")
    assert got[4] == ("address_exact", 10, "exact")
    assert got[5] == ("address_normalized", 11, "good")
    assert got[6] == ("state_route", 12, "good")
    assert got[7] == ("hyphenated", 13, "good")
    assert got[8] == ("fuzzy_0.88", 14, "fuzzy")
    assert got[9] == (None, None, "no_match")
    assert got[10] == (None, None, "no_county")
    assert got[11][0] == "email"
    assert got[12] == ("phone", 3, "demographic")
    assert got[13] == (None, None, "no_match")
    assert len(got) == len(CONTACTS)
    scored = {m["contact_id"]: (m["method"], m["parcel_id"]) for m in linkage.score_cascade(c, d, r).collect()}
    assert scored[3] == ("phone", 1)


def test_score_cascade_kinds(spark):
    """One contact for each kind of hit, with and without a ZIP code."""
    d = spark.createDataFrame([("A", 20, None, "ROE ANN", "6145550200", "43001"), ("A", 21, None, "john smith", None, "43001"), ("A", 22, None, "x", "6145550201", "43001")], "county string, parcel_id long, email string, full_name string, phone string, zip string")
    r = spark.createDataFrame([("A", 20, "12 Main Street", "43001"), ("A", 21, "5 Long Meadow Lane East", "43001"), ("A", 22, "9 Far Road", "43002")], "county string, parcel_id long, address string, zip string")
    c = [
        contact(1, phone="614-555-0200", address="12 main st"), contact(2, address="12 Main St.", zip_=None), contact(3, phone="6145550201"),
        contact(4, first="John", last="Smith", address="5 Long Meadow Lane"), contact(5, address="9 Far Road"), contact(6, address="9 Far Road", zip_=None),
    ]
    c = spark.createDataFrame(c, "contact_id long, county string, email string, first string, last string, phone string, address string, zip string")
    got = {m["contact_id"]: (m["method"], m["parcel_id"], round(m["score"], 3), m["quality"]) for m in linkage.score_cascade(c, d, r).collect()}
    assert got[1] == ("address_phone", 20, 1.0, "good")
    assert got[2] == ("address", 20, 1.0, "good")
    assert got[3] == ("phone", 22, 1.0, "good")
    assert got[4][:2] == ("address", 21)  # its score is higher than that of name with address
    assert 5 not in got
    assert got[6] == ("address", 22, 1.0, "good")


def scored(a, b):
    """Two addresses compared by plain Python."""
    (x, m), (y, n) = ((re.match(r"\d+", t)[0], re.sub(r"^\d+", "", t).strip()) for t in (a, b))
    return 1.0 if a == b else min(len(m), len(n)) / max(len(m), len(n)) if x == y and (m in n or n in m) else 0.0


@pytest.mark.parametrize("few", [0, 100])
def test_score_cascade_of_plain_loops(spark, monkeypatch, few):
    monkeypatch.setattr(linkage, "FEW", few)
    r = random.Random(few)
    address = lambda: " ".join([r.choice("12"), *r.choice(["", "elm st", "elm st 5", "oak", "mill ln", "old mill ln"]).split()])
    phone, zip_, county = (lambda of=of: r.choice(of) for of in (["", "6145550100", "6145550101"], ["43001", "43002", None], "AB"))
    con = [contact(i, county(), phone=phone(), address=address(), zip_=zip_()) for i in range(60)]
    parcels = [(county(), i, address(), phone(), zip_()) for i in range(50)]
    d = spark.createDataFrame([(k, i, None, None, p, z) for k, i, _, p, z in parcels], "county string, parcel_id long, email string, full_name string, phone string, zip string")
    e = spark.createDataFrame([(k, i, a, z) for k, i, a, _, z in parcels], "county string, parcel_id long, address string, zip string")
    c = spark.createDataFrame(con, "contact_id long, county string, email string, first string, last string, phone string, address string, zip string")
    want = {}
    for n, at, *_, own, a, z in con:
        hits = []
        for k, i, b, p, other in parcels:
            s = scored(a, b) if at == k and z in (None, other) else 0
            same = at == k and own != "" and own == p
            hits += [(0 if s == 1 else 2, -s, 0, k, i, "address_phone")] * (same and s > 0.7) + [(2, -s, 1, k, i, "address")] * (s > 0.7) + [(1, -1.0, 2, k, i, "phone")] * same
        if hits:
            _, s, _, *best = min(hits)
            want[n] = (*best, round(-s, 6))
    got = {m["contact_id"]: (m["county"], m["parcel_id"], m["method"], round(m["score"], 6)) for m in linkage.score_cascade(c, d, e).collect()}
    assert got == want
