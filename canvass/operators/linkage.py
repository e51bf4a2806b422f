"""Linking contacts to parcels by a cascade of strategies.

Every strategy is a join on blocking keys whose hits carry a priority and a
score; the best hit of a contact is taken by one aggregate, so no strategy runs
row by row and ties are broken by parcel.  Columns:

contacts: contact_id, county, email, first, last, phone, address, zip
demographic: county, parcel_id, email, full_name, phone, zip
residential: county, parcel_id, address, zip
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import storage
from canvass.functions import text as T
from canvass.operators.containment import either

# Strategies in order, with the quality of their hits.
STRATEGIES = [
    ("email", "demographic"), ("name", "demographic"), ("phone", "demographic"), ("address_exact", "exact"),
    ("address_normalized", "good"), ("state_route", "good"), ("hyphenated", "good"), ("fuzzy", "fuzzy"),
]
FUZZY_LEAST = 0.7


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are dear and often mentioned: a generator's output isn't
    written out anew in every expression over it."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def prepare(contacts: DataFrame, demographic: DataFrame, residential: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys that strategies compare, computed and written once: many joins read
    them, and the expressions behind them are long."""
    keys = lambda c: {"email_key": T.email(F.col("email")), "phone_key": F.nullif(T.phone(F.col("phone")), F.lit("")), "zip_key": T.zip_number(F.col("zip"))}
    c = contacts.withColumns(keys(contacts)).withColumns({"raw": T.blank_to_null(F.col("address"))})
    name = lambda k: F.coalesce(T.person(F.col(k)), F.lit(""))
    c = _once(c, address_key=F.nullif(T.address(F.col("address")), F.lit("")), first_key=name("first"), last_key=name("last"))
    d = _once(demographic.withColumns(keys(demographic)), full_key=name("full_name"))
    r = residential.withColumns({"zip_key": T.zip_number(F.col("zip")), "r_address": T.blank_to_null(F.col("address"))})
    r = _once(r, r_key=F.nullif(T.address(F.col("address")), F.lit("")))
    d = d.select("county", "parcel_id", *(F.col(k).alias(f"d_{k}") for k in ("email_key", "phone_key", "zip_key", "full_key")))
    r = r.select("county", "parcel_id", F.col("zip_key").alias("r_zip"), "r_address", "r_key")
    return storage.kept(c, "contacts"), storage.kept(d, "demographic"), storage.kept(r, "residential")


def _each(rows: DataFrame, keep: list[str], **keys: Column) -> DataFrame:
    """A row for each key that isn't null: ``kind``, ``key`` and what is kept."""
    pairs = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key"))) for k, c in keys.items()))
    return rows.select(*keep, F.inline(F.array_compact(pairs)))


def _and(zip_column: str, c: Column) -> Column:
    """The text behind its ZIP code; null if either is."""
    return F.concat(F.col(zip_column).cast("string"), F.lit("|"), c)


#: Texts of contacts and parcels meet within these.
WITHIN = ["kind", "county", "within"]


def _texts(c: DataFrame, d: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of contacts and of parcels that containment is asked of, with the
    kind of match and the part of the county (a ZIP code, a house number, or '' for
    all of it) that they meet in."""
    own, at = ["contact_id", "first_key", "last_key", "address_key"], c.where("raw IS NOT NULL")
    row = lambda rows, kind, within, text, keep, around: rows.select(*keep, "county", F.lit(kind).alias("kind"), within.cast("string").alias("within"), text.alias("text"), F.lit(around).alias("around"))
    none, whole = F.lit(None).cast("string"), F.lit("")
    named = c.where("first_key <> '' AND last_key <> ''")
    route = at.where(F.col("raw").rlike(r"(?i)(OH|US|SR)[-\s]\d+")).withColumn("v", F.explode(T.route_variations(F.col("raw"))))
    hyphen = at.where(F.col("raw").contains("-")).withColumn("v", F.explode(F.transform(T.hyphen_variations(F.col("raw")), lambda v: T.address(v)))).where("length(v) > 5")
    bare = at.where("zip_key IS NULL").withColumn("house", T.house_number(F.col("address_key"))).where("house IS NOT NULL")
    mine = [
        row(named, "name", F.coalesce(F.col("zip_key").cast("string"), whole), F.col("last_key"), own, False),
        row(route, "route", whole, F.upper("v"), own, True),
        row(hyphen, "hyphen", whole, F.col("v"), own, True),
        row(bare, "fuzzy", F.col("house"), T.address_rest(F.col("address_key")), own, True),
    ]
    keys = ["parcel_id", "full_key", "r_key"]
    d = d.withColumnRenamed("d_full_key", "full_key").withColumn("r_key", none)
    r = r.withColumn("full_key", none).withColumn("r_house", T.house_number(F.col("r_key")))
    theirs = [
        row(d.withColumn("p", F.explode(F.array_compact(F.array(F.col("d_zip_key").cast("string"), whole)))), "name", F.col("p"), F.col("full_key"), keys, False),
        row(r, "route", whole, F.upper("r_address"), keys, True),
        row(r, "hyphen", whole, F.col("r_key"), keys, True),
        row(r, "fuzzy", F.col("r_house"), T.address_rest(F.col("r_key")), keys, True),
    ]
    return reduce(DataFrame.unionByName, mine), _least(reduce(DataFrame.unionByName, theirs))


def _least(theirs: DataFrame) -> DataFrame:
    """Of parcels that agree in all that is compared the least, which is the one that
    the best hit has; so equal texts meet a contact once, however many parcels bear them."""
    return theirs.groupBy(*(c for c in theirs.columns if c != "parcel_id")).agg(F.min("parcel_id").alias("parcel_id"))


def _contained(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of both sides whose texts contain one another, as their kinds ask."""
    pairs = either(mine.select(*WITHIN, F.col("text").alias("own"), "around"), theirs.select(*WITHIN, F.col("text").alias("other"), "around"), WITHIN)
    met = mine.drop("around").withColumnRenamed("text", "own").join(pairs, [*WITHIN, "own"])
    return met.join(theirs.drop("around").withColumnRenamed("text", "other"), [*WITHIN, "other"])


def candidates(contacts: DataFrame, demographic: DataFrame, residential: DataFrame) -> DataFrame:
    """The hits of all strategies: contact_id, county, parcel_id, priority, method,
    quality, score, part.  Of parcels that are alike in all that a strategy compares
    there is the least alone, which comes before the others in every order of hits.
    ``part`` says that a state route is only within the other text, as 56 is in 560.

    Two joins find them: one on equal keys of all strategies, one on texts that
    contain one another.  Both have the strategy among their keys."""
    c, d, r = prepare(contacts, demographic, residential)
    at = F.col("raw").isNotNull()
    bare = F.col("zip_key").isNull()
    house, r_house = T.house_number(F.col("address_key")), T.house_number(F.col("r_key"))
    short = F.when(at & F.col("raw").contains("-"), F.filter(F.transform(T.hyphen_variations(F.col("raw")), lambda v: T.address(v)), lambda v: F.length(v) <= 5))
    mine = _each(
        c, ["contact_id", "county", "address_key"], email=F.col("email_key"), phone=F.col("phone_key"),
        exact_zip=_and("zip_key", F.col("raw")), exact=F.when(bare, F.col("raw")), key_zip=F.when(at, _and("zip_key", F.col("address_key"))), key=F.when(at & bare, F.col("address_key")),
        fuzzy_zip=F.when(at, _and("zip_key", house)),
    )
    mine = mine.unionByName(c.select("contact_id", "county", "address_key", F.lit("hyphen").alias("kind"), F.explode(short).alias("key")))
    theirs = _each(d.withColumn("r_key", F.lit(None).cast("string")), ["parcel_id", "county", "r_key"], email=F.col("d_email_key"), phone=F.col("d_phone_key"))
    theirs = theirs.unionByName(_each(
        r, ["parcel_id", "county", "r_key"], exact_zip=_and("r_zip", F.col("r_address")), exact=F.col("r_address"),
        key_zip=_and("r_zip", F.col("r_key")), key=F.col("r_key"), hyphen=F.col("r_key"), fuzzy_zip=_and("r_zip", r_house),
    ))
    none = F.lit(None).cast("string")
    equal = mine.join(_least(theirs), ["kind", "county", "key"]).withColumns({"first_key": none, "last_key": none, "full_key": none, "part": F.lit(False)})
    columns = ["contact_id", "county", "parcel_id", "kind", "address_key", "r_key", "first_key", "last_key", "full_key", "part"]
    held = _contained(*(storage.kept(t, "texts") for t in _texts(c, d, r))).withColumn("part", (F.col("kind") == "route") & (F.col("own") != F.col("other")))
    met = equal.select(*columns).unionByName(held.select(*columns))
    k = F.regexp_replace("kind", "_zip$", "")
    place = F.element_at(F.create_map(*(F.lit(x) for pair in (("email", 0), ("name", 1), ("phone", 2), ("exact", 3), ("key", 4), ("route", 5), ("hyphen", 6), ("fuzzy", 7)) for x in pair)), k)
    score = F.when(k == "fuzzy", T.fuzzy_score(F.col("address_key"), F.col("r_key"))).otherwise(1.0)
    met = met.select("contact_id", "county", "parcel_id", place.alias("place"), score.alias("score"), F.when(k == "name", T.name_match(F.col("first_key"), F.col("last_key"), F.col("full_key"))).alias("named"), "part")
    met = met.where((F.col("place") != 1) | F.col("named").isNotNull()).where((F.col("place") != 7) | (F.col("score") > FUZZY_LEAST))
    listed = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in STRATEGIES)), F.col("place") + 1)
    method = F.when(F.col("place") == 1, F.concat(F.lit("name_"), F.col("named"))).when(F.col("place") == 7, F.format_string("fuzzy_%.2f", "score")).otherwise(listed(0))
    return met.select("contact_id", "county", "parcel_id", (F.col("place") + 1).alias("priority"), method.alias("method"), listed(1).alias("quality"), "score", "part")


def best(hits: DataFrame, key: str = "contact_id") -> DataFrame:
    """A contact's hit of least priority, then highest score, then of the whole text, then least parcel."""
    order = F.struct(F.col("priority"), (-F.col("score")).alias("s"), F.col("part"), F.col("county"), F.col("parcel_id"))
    value = F.struct("county", "parcel_id", "priority", "method", "quality", "score")
    return hits.groupBy(key).agg(F.min_by(value, order).alias("m")).select(key, "m.*")


def match(contacts: DataFrame, demographic: DataFrame, residential: DataFrame) -> DataFrame:
    """Every contact with its best hit, or quality no_match."""
    found = best(candidates(contacts, demographic, residential)).withColumnRenamed("county", "match_county")
    out = contacts.select("contact_id", "county").join(found, "contact_id", "left")
    reason = F.when(F.col("quality").isNotNull(), F.col("quality")).when(F.col("county").isNull(), "no_county").otherwise("no_match")
    return out.withColumns({"quality": reason, "confidence": F.when(F.col("method").rlike("exact|email|phone"), 1.0).when(F.col("method").isNotNull(), 0.8)})


def county_of_zip(rows: DataFrame, lookup: DataFrame, default: str | None = None) -> DataFrame:
    """Adds ``county`` by ``zip5``; the lookup is small and fixed in size (one row
    a ZIP code), and adaptive plans broadcast it if it measures so."""
    out = rows.join(lookup.select("zip5", "county"), "zip5", "left")
    return out if default is None else out.withColumn("county", F.coalesce("county", F.lit(default)))


def zip_counties(parcels: DataFrame) -> DataFrame:
    """Counties of each ZIP code by falling number of parcels: zip, county, n, county_rank."""
    from pyspark.sql import Window as W

    counts = parcels.groupBy("zip", "county").agg(F.count("*").alias("n"))
    return counts.withColumn("county_rank", F.row_number().over(W.partitionBy("zip").orderBy(F.desc("n"), "county")))


def _countyless(rows: DataFrame) -> DataFrame:
    """Parcels as one county, the true one within the parcel's id."""
    return rows.withColumn("parcel_id", F.struct("county", "parcel_id")).withColumn("county", F.lit(""))


def match_counties(contacts: DataFrame, demographic: DataFrame, residential: DataFrame) -> DataFrame:
    """Contacts matched in the counties of their ZIP code, the county with most
    parcels first; a ZIP code that no parcel has, or none, sends contacts with an
    e-mail through all counties by name.  The first county with a hit wins, in it
    the best hit.  Contacts without a hit aren't in the result."""
    own = contacts.withColumn("zip", T.zip_number(F.col("zip")))
    ranks = zip_counties(residential.select(T.zip_number(F.col("zip")).alias("zip"), "county").where("zip IS NOT NULL"))
    ranked = own.drop("county").join(ranks.select("zip", "county", "county_rank"), "zip")
    # The county's place goes with the contact's id through the strategies.
    ranked = ranked.withColumn("contact_id", F.struct("contact_id", "county_rank")).withColumn("zip", F.col("zip").cast("string"))
    known = candidates(ranked, demographic, residential)
    known = known.select("contact_id.*", *(c for c in known.columns if c != "contact_id"))
    rest = own.join(ranks.select("zip").distinct(), "zip", "left_anti").where(T.email(F.col("email")).isNotNull())
    far = candidates(rest.withColumn("county", F.lit("")).withColumn("zip", F.lit(None).cast("string")), _countyless(demographic), _countyless(residential))
    far = far.withColumn("county", F.col("parcel_id.county")).withColumn("parcel_id", F.col("parcel_id.parcel_id")).withColumn("county_rank", F.lit(0))
    every = known.unionByName(far)
    order = F.struct("county_rank", "county", "priority", (-F.col("score")).alias("s"), "part", "parcel_id")
    value = F.struct("county", "parcel_id", "priority", "method", "quality", "score")
    return every.groupBy("contact_id").agg(F.min_by(value, order).alias("m")).select("contact_id", "m.*")


def parcel_records(demographic: DataFrame, residential: DataFrame, key: str, last: str) -> DataFrame:
    """Both records of each parcel that has both, the last of several by ``last``;
    columns of both sides bear _demo and _prop."""

    def newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(last)).alias("r")).select(key, "r.*")

    both = (set(demographic.columns) & set(residential.columns)) - {key}
    named = lambda rows, suffix: rows.select(key, *(F.col(c).alias(c + suffix if c in both else c) for c in rows.columns if c != key))
    return named(newest(demographic), "_demo").join(named(newest(residential), "_prop"), key)


def name_key_match(contacts: DataFrame, demographic: DataFrame) -> DataFrame:
    """Contacts by the exact upper-case name FIRST LAST within a county: a record
    of their ZIP code before any other, the smaller parcel of equals.
    contact_id, county, parcel_id, with_zip."""
    named = contacts.where("trim(first) <> '' AND trim(last) <> ''").select("contact_id", "county", F.concat_ws(" ", F.upper("first"), F.upper("last")).alias("name"), T.zip_number(T.zip_digits(F.col("zip"))).alias("own"))
    known = demographic.select("county", F.col("full_name").alias("name"), "parcel_id", T.zip_number(F.col("zip")).alias("other"))
    # The least parcel of a name, in each ZIP code and in the county: a contact meets one of each.
    near = known.where("other IS NOT NULL").groupBy("county", "name", F.col("other").alias("own")).agg(F.min("parcel_id").alias("near"))
    far = known.groupBy("county", "name").agg(F.min("parcel_id").alias("far"))
    met = named.join(far, ["county", "name"]).join(near, ["county", "name", "own"], "left")
    found = F.when(F.col("near").isNotNull(), F.struct(F.lit(False).alias("k"), F.col("near").alias("parcel_id"))).otherwise(F.struct(F.lit(True).alias("k"), F.col("far").alias("parcel_id")))
    return met.groupBy("contact_id", "county").agg(F.min(found).alias("m")).select("contact_id", "county", "m.parcel_id", (~F.col("m.k")).alias("with_zip"))


#: An address of contacts: its county, its ZIP code or '' for all of the county, and the key.
AT = ["county", "within", "address_key"]
#: Parcels' addresses of one place and house number that are compared one by one; where there are more, by their pieces.
FEW = 100


def _alike(own: DataFrame, other: DataFrame) -> DataFrame:
    """Different addresses of contacts (``*AT``) and parcels (county, within, r_key)
    that score, each pair once: ``*AT, r_key, s``.  They agree in the house number,
    and one street contains the other; a number without a street is its own street."""
    on = ["county", "within", "house"]
    street = lambda c: F.coalesce(F.nullif(T.address_rest(F.col(c)), F.lit("")), F.col(c))
    side = lambda rows, c, k: rows.distinct().select("*", T.house_number(F.col(c)).alias("house"), street(c).alias(k), F.lit(True).alias("around"))
    mine, theirs = side(own.select(*AT), "address_key", "own"), side(other.select("county", "within", "r_key"), "r_key", "other")
    few = theirs.groupBy(*on).agg((F.count("*") <= FEW).alias("few"))
    mine, theirs = mine.join(few, on), theirs.join(few, on)
    met = mine.where("few").join(theirs.where("few").select(*on, "r_key"), on).select(*AT, "r_key")
    if not few.where("NOT few").isEmpty():
        mine, theirs = mine.where("NOT few"), theirs.where("NOT few")
        pairs = either(mine.select(*on, "own", "around"), theirs.select(*on, "other", "around"), on)
        held = mine.select(*AT, "house", "own").join(pairs, [*on, "own"]).join(theirs.select(*on, "other", "r_key"), [*on, "other"])
        met = met.unionByName(held.select(*AT, "r_key"))
    return met.select(*AT, "r_key", T.fuzzy_score(F.col("address_key"), F.col("r_key")).alias("s")).where(F.col("s") > FUZZY_LEAST)


def _first(hits: DataFrame, *keys: str) -> DataFrame:
    """The hit of highest score, then least parcel, of each value of the keys."""
    value = F.struct("parcel_id", "kind", "method", "score")
    return hits.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("score")).alias("s"), F.col("parcel_id"))).alias("m")).select(*keys, "m.*")


def score_cascade(contacts: DataFrame, demographic: DataFrame, residential: DataFrame, all_counties: bool = False) -> DataFrame:
    """The other cascade: address with phone, address, phone, name with address.
    A sure hit of the first or third kind wins at once; else the highest score,
    and of equal scores the earlier kind, then the smaller parcel.

    Contacts that are alike in what a kind compares have the same hit of it, and
    parcels that are alike are one, so no kind pairs contacts with parcels row by row.

    With ``all_counties`` a contact's own county doesn't count: the first county
    by name with a sure hit wins, else the highest score in any of them."""
    if all_counties:
        contacts, demographic, residential = contacts.withColumn("county", F.lit("")), _countyless(demographic), _countyless(residential)
    c, d, r = prepare(contacts, demographic, residential)
    housed = lambda rows, key: rows.where(T.house_number(F.col(key)).isNotNull())
    own = housed(c, "address_key").withColumn("within", F.coalesce(F.col("zip_key").cast("string"), F.lit("")))
    both = storage.kept(housed(r, "r_key").join(d, ["county", "parcel_id"]).select("county", "parcel_id", "r_zip", "r_key", "d_phone_key", "d_full_key"), "parcels")
    # A parcel is met within its ZIP code, and within all of its county by contacts that have none.
    within = F.explode(F.array_compact(F.array(F.col("r_zip").cast("string"), F.lit("")))).alias("within")
    named = storage.kept(_least(both.select("county", "parcel_id", within, "r_key", "d_full_key")), "named")
    alike = storage.kept(_alike(own, named), "alike")
    at, name = ["county", "within", "r_key"], T.name_match(F.col("first_key"), F.col("last_key"), F.col("d_full_key"))
    hit = lambda rows, kind, method, score: rows.select("*", F.lit(kind).alias("kind"), F.lit(method).alias("method"), score.alias("score"))
    with_phone, with_name = own.where("phone_key IS NOT NULL"), own.where("first_key <> '' AND last_key <> ''")
    phones = _least(both.where("d_phone_key IS NOT NULL").select("county", "parcel_id", F.col("r_zip").cast("string").alias("r_zip"), "r_key", F.col("d_phone_key").alias("phone_key")))
    by_phone = alike.join(with_phone.select(*AT, "phone_key").distinct(), AT).join(phones, ["county", "r_key", "phone_key"]).where("within IN ('', r_zip)")
    by_name = alike.join(with_name.select(*AT, "first_key", "last_key").distinct(), AT).join(named, at).withColumn("named", name).where("named IS NOT NULL")
    kinds = [
        (with_phone, [*AT, "phone_key"], hit(by_phone, 0, "address_phone", F.col("s"))),
        (own, AT, hit(alike.join(_least(named.drop("d_full_key")), at), 1, "address", F.col("s"))),
        (with_name, [*AT, "first_key", "last_key"], hit(by_name, 3, "name_address", F.when((F.col("s") == 1) & (F.col("named") == "exact"), 1.0).otherwise(F.col("s") * 0.9))),
    ]
    out = ["contact_id", "county", "parcel_id", "kind", "method", "score"]
    near = [rows.join(_first(hits, *keys), keys).select(*out) for rows, keys, hits in kinds]
    phone = c.join(_least(d.select(F.col("county").alias("_county"), "parcel_id", "d_phone_key")), (F.col("county") == F.col("_county")) & (F.col("phone_key") == F.col("d_phone_key")))
    every = reduce(DataFrame.unionByName, [*near, hit(phone.select("contact_id", "county", "parcel_id"), 2, "phone", F.lit(1.0))])
    first = F.when((F.col("kind") == 0) & (F.col("score") == 1), 0).when(F.col("kind") == 2, 1).otherwise(2)
    order = F.struct(first.alias("f"), (-F.col("score")).alias("s"), F.col("kind"), F.col("county"), F.col("parcel_id"))
    if all_counties:
        every = every.withColumn("county", F.col("parcel_id.county")).withColumn("parcel_id", F.col("parcel_id.parcel_id"))
        sure = first < 2
        order = F.struct((~sure).alias("k"), F.when(sure, 0.0).otherwise(-F.col("score")).alias("s"), F.col("county"), first.alias("f"), F.col("kind"), F.col("parcel_id"))
    out = every.groupBy("contact_id").agg(F.min_by(F.struct("county", "parcel_id", "method", "score"), order).alias("m")).select("contact_id", "m.*")
    return out.withColumn("quality", F.when(F.col("score") == 1, "good").otherwise("fuzzy"))
