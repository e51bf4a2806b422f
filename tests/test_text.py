import pytest
from pyspark.sql import functions as F

from canvass.functions import text as T
from canvass.functions import values as V

HARD = ["", " ", "12 North Main Street", "12-14 Oak St", "OH-314", "us 40", "A-B Rd", "1 (614) 555-0100", "6145550100.0", "43001-1234", "n/a", None, "JOHN SMITH JR.", "$1,234.50", "-1", "STATE ROUTE 7", "COLUMBUS 40"]


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("f", [T.phone, T.email, T.zip_padded, T.zip_digits, T.address, T.person])
def test_normalisers_are_idempotent(spark, f):
    rows = spark.createDataFrame([(x,) for x in HARD], "x string")
    for r in rows.select(f(F.col("x")).alias("a"), f(f(F.col("x"))).alias("b")).collect():
        assert r["a"] == r["b"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.phone, "1-614-555-0100", "6145550100"), (T.phone, "6145550100.0", "6145550100"), (T.address, "12 North Main Street.", "12 n main st"),
        (T.address, "5 Streeter Road", "5 streeter rd"), (T.zip_padded, "123", "00123"), (T.zip_padded, "430011", "430011"), (T.zip_head, "43001.0", "43001"),
        (T.route_variations, "OH-314", ["OH-314", "OH 314", "SR 314", "STATE ROUTE 314"]), (T.route_variations, "STATE ROUTE 7", ["STATE ROUTE 7"]),
        (T.route_variations, "COLUMBUS 40", ["COLUMBUS 40", "US 40", "US HIGHWAY 40", "US-40"]), (T.hyphen_variations, "12-14 Oak St", ["12-14 Oak St"]),
        (T.hyphen_variations, "A-B Rd", ["A-B Rd", "A B Rd", "B Rd", "A"]), (T.person, "John  Smith jr. Doe", "john smith doe"), (T.html_text, "<p>a &amp; b</p><script>x</script>", "a & b"),
        (V.currency, "$1,234.50", 1234.5), (V.currency, "n/a", None), (V.silhouette_label, "0.27547", "Weak"), (V.silhouette_label, "0.16109", "Poor"),
        (V.stability_label, "0.87791", "Highly Stable"), (V.stability_label, "0.80158", "Stable"), (T.agency, "x_mvcap_1", "MVCAP"), (T.category, "OHCAC_Summer_Crisis_1", "urgency"),
    ],
)
def test_examples(spark, f, value, want):
    got = one(spark, f, value)
    assert (list(got) if isinstance(want, list) else got) == want


def test_status_rules(spark):
    rows = spark.createDataFrame([("email", True, True), ("email", False, True), ("mailer", None, None), ("fax", True, True)], "c string, s boolean, w boolean")
    assert [r[0] for r in rows.select(V.status(F.col("c"), F.col("s"), F.col("w"))).collect()] == ["engaged", "received", "no_engagement", "no_engagement"]


def test_stamps_are_one_time(spark):
    rows = V.stamps(spark.range(3), "made", "seen").collect()
    assert len({(r.made, r.seen) for r in rows}) == 1 and rows[0].made == rows[0].seen
