"""Normalisers and parsers of addresses, names, phones, ZIP codes and campaign
names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abbreviations that addresses are compared by.
STREETS = [
    ("street", "st"), ("avenue", "ave"), ("road", "rd"), ("drive", "dr"), ("lane", "ln"), ("court", "ct"), ("circle", "cir"),
    ("boulevard", "blvd"), ("parkway", "pkwy"), ("place", "pl"), ("terrace", "ter"), ("way", "way"), ("highway", "hwy"), ("route", "rte"),
]
DIRECTIONS = [
    ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
    ("northeast", "ne"), ("northwest", "nw"), ("southeast", "se"), ("southwest", "sw"),
]
# Agencies, keywords of message types, and their categories.
AGENCIES = ["OHCAC", "MVCAP", "IMPACT", "COAD"]
KEYWORDS = ["webinar", "crisis", "savings", "daily_cost", "monthly", "improve", "surge"]
CATEGORIES = [
    ("cost_framing", ["Daily_Cost", "DailyCost", "Monthly_Cost", "Annual_Cost"]),
    ("savings_framing", ["Monthly_Savings", "Monthly_Saving", "Would_$_Per_Month"]),
    ("urgency", ["Summer_Surge", "Summer_Crisis", "SummerCrisis", "Crisis", "FinalDays", "Final_Days"]),
    ("personalization", ["Your_Home_Selected", "Claude_Content"]),
    ("improvement", ["Improve"]),
    ("event", ["Webinar"]),
]


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def address(c: Column, streets=STREETS, directions=DIRECTIONS) -> Column:
    """Lower case, without commas and points, usual words abbreviated, single
    blanks.  Null stays null."""
    c = F.regexp_replace(F.trim(F.lower(c)), "[,.]", "")
    for word, short in [*streets, *directions]:
        if word != short:
            c = F.regexp_replace(c, rf"\b{word}\b", short)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def address_upper(c: Column, short: list[tuple[str, str]], bounded: bool = True, drop: str = "[.,]") -> Column:
    """The upper-case form; ``short`` may replace parts of words if not ``bounded``."""
    c = F.regexp_replace(F.trim(F.upper(c)), drop, "")
    for word, to in short:
        c = F.regexp_replace(c, rf"\b{word}\b" if bounded else word, to)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def address_key(c: Column) -> Column:
    """Letters and digits alone; null if there are none, so that blanks don't join."""
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def house_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit(""))


def address_rest(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\d+", ""))


def fuzzy_score(a: Column, b: Column) -> Column:
    """Of two normalised addresses: 1 if equal, else how much of the longer
    remainder the shorter one is if it lies within and the numbers agree, else 0."""
    x, y = address_rest(a), address_rest(b)
    inside = x.contains(y) | y.contains(x)
    share = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((house_number(a) == house_number(b)) & inside, share).otherwise(0.0)


# How a state route is written.
ROUTE = r"(?i)(OH|US|SR|STATE ROUTE)\s*[-\s]\s*(\d+)"


def route_variations(c: Column) -> Column:
    """The text itself, then the ways to write the state route in it."""
    kind, n = F.upper(F.regexp_extract(c, ROUTE, 1)), F.regexp_extract(c, ROUTE, 2)
    forms = lambda *heads: F.array(c, *(F.concat(F.lit(h), n) for h in heads))
    found = (
        F.when(kind == "OH", forms("OH ", "SR ", "STATE ROUTE ", "OH-"))
        .when(kind == "US", forms("US ", "US HIGHWAY ", "US-"))
        .when(kind == "SR", forms("SR ", "STATE ROUTE ", "OH "))
        .otherwise(F.array(c))
    )
    return F.array_distinct(found)


def hyphen_variations(c: Column) -> Column:
    """The text itself; without hyphens; and both halves if there is one hyphen.
    House-number ranges are left alone."""
    parts = F.split(c, "-", -1)
    spaced = F.array(c, F.replace(c, F.lit("-"), F.lit(" ")))
    halves = F.concat(spaced, F.array(F.trim(F.element_at(parts, -1)), F.trim(F.element_at(parts, 1))))
    found = F.when(~c.contains("-") | c.rlike(r"^\d+-\d+"), F.array(c)).when(F.size(parts) == 2, halves).otherwise(spaced)
    return F.array_distinct(found)


def person(c: Column) -> Column:
    """Lower case, single blanks, without jr, sr, ii, iii, iv."""
    c = F.regexp_replace(F.trim(F.lower(c)), r"\b(jr|sr|ii|iii|iv)\b\.?", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_match(first: Column, last: Column, full: Column) -> Column:
    """'exact', 'fuzzy' or null for normalised names."""
    exact = (first != "") & (last != "") & full.contains(F.concat_ws(" ", first, last))
    fuzzy = (last != "") & full.contains(last) & (first != "") & (full.contains(first) | full.startswith(F.substring(first, 1, 1)))
    return F.when(full == "", None).when(exact, "exact").when(fuzzy, "fuzzy")


def phone(c: Column) -> Column:
    """Digits without a leading country code; a float's '.0' is cut first."""
    d = F.regexp_replace(F.regexp_replace(c, r"\.0$", ""), r"\D", "")
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def phone_last10(c: Column, short: str | None = "") -> Column:
    """The last ten digits; of fewer digits ``short``, or if that is None the digits."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise(d if short is None else F.lit(short))


def email(c: Column) -> Column:
    key = F.trim(F.lower(c))
    return F.when(key.contains("@"), key)


def zip_digits(c: Column) -> Column:
    """The first five digits."""
    return F.nullif(F.substring(F.regexp_replace(c, r"\D", ""), 1, 5), F.lit(""))


def zip_padded(c: Column) -> Column:
    """Zeros in front up to five places; longer text stays."""
    return F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)


def zip_head(c: Column) -> Column:
    """Without '.0' and '-extension', five characters at most."""
    return F.substring(F.regexp_replace(c, r"(\.0|-.*)$", ""), 1, 5)


def zip_number(c: Column) -> Column:
    """Null where a ZIP code isn't a number; then no ZIP restricts a match."""
    return c.try_cast("int")


def county_of_table(c: Column) -> Column:
    return F.regexp_replace(c, "(Residential|Demographic|Loads|Gas|Electrical)$", "")


def first_of(c: Column, words: list[str], default: str | None = None) -> Column:
    """The first of the words that the text contains."""
    found = F.lit(None).cast("string") if default is None else F.lit(default)
    for w in reversed(words):
        found = F.when(c.contains(w), w).otherwise(found)
    return found


def agency(name: Column) -> Column:
    return first_of(F.upper(name), AGENCIES)


def keyword(name: Column) -> Column:
    return first_of(F.lower(name), KEYWORDS)


def category(name: Column) -> Column:
    found = F.lit("other")
    for label, patterns in reversed(CATEGORIES):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | name.contains(p)
        found = F.when(hit, label).otherwise(found)
    return found


def template(name: Column) -> Column:
    """Without the organisation in front, the date and what follows, and '(copy)'."""
    for pattern in (r"^(OHCAC?|IMPACT|MVCAP|COAD)_", r"_\d{8}.*$", r"\s*\(copy\)$"):
        name = F.regexp_replace(name, pattern, "")
    return F.trim(name)


def subject(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\{\{[^}]+\}\}", "{{VAR}}"), r"\s+", " "))


def preview(c: Column, most: int = 1000) -> Column:
    c = F.regexp_replace(c, r"\{\{PreviewText\}\}.*?\{% endif %\}", "")
    c = F.regexp_replace(c, "[\u200b\u200c\u200d]+", "")
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def shortened(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


# Names of text campaigns.
SMS = r"^Text(\d+)_(.+?)_(IMPACT|Impact|OHCAC|MVCAP|COAD|NA)(?:_(.+))?$"
SMS_PLAIN = r"^Text(\d+)_([^_]+)$"


def sms_name(c: Column) -> Column:
    """struct<number, message_key, agency, time_variant>; agency NA if it isn't named."""
    part = lambda k: F.nullif(F.regexp_extract(c, SMS, k), F.lit(""))
    plain = lambda k: F.nullif(F.regexp_extract(c, SMS_PLAIN, k), F.lit(""))
    return F.struct(
        F.coalesce(part(1), plain(1)).cast("int").alias("number"),
        F.coalesce(part(2), plain(2)).alias("message_key"),
        F.when(part(1).isNotNull(), part(3)).when(plain(1).isNotNull(), "NA").alias("agency"),
        part(4).alias("time_variant"),
    )


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles and the head go, tags become blanks, the
    usual entities become characters."""
    for tag in ("script", "style", "head", "title"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def file_name(c: Column, most: int = 50) -> Column:
    """A name that file systems take."""
    c = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    c = F.regexp_replace(F.substring(c, 1, most), " ", "_")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("untitled"))


def person_parts(full: Column) -> Column:
    """struct<first, last> of 'LAST, FIRST' or 'FIRST LAST', in title case."""
    words = F.split(F.trim(full), r"\s+")
    comma = F.split(full, ",")
    first = F.when(full.contains(","), F.trim(F.element_at(comma, 2))).otherwise(F.element_at(words, 1))
    last = F.when(full.contains(","), F.trim(F.element_at(comma, 1))).otherwise(F.element_at(words, -1))
    return F.struct(F.initcap(first).alias("first"), F.initcap(last).alias("last"))


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "yes", F.lit(False))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")
