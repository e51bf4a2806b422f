"""Counties of cities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The county of a city, for records without a county of their own; it goes before that of the ZIP code.
CITY_COUNTY = {
    "columbus": "FranklinCounty",
    "athens": "AthensCounty",
    "cleveland": "CuyahogaCounty",
    "cincinnati": "HamiltonCounty",
    "toledo": "LucasCounty",
    "akron": "SummitCounty",
    "dayton": "MontgomeryCounty",
    "youngstown": "MahoningingCounty",
    "canton": "StarkCounty",
    "lorain": "LorainCounty",
    "hamilton": "ButlerCounty",
    "springfield": "ClarkCounty",
    "kettering": "MontgomeryCounty",
    "elyria": "LorainCounty",
    "newark": "LickingCounty",
    "mansfield": "RichlandCounty",
    "mentor": "LakeCounty",
    "beavercreek": "GreeneCounty",
    "strongsville": "CuyahogaCounty",
    "dublin": "FranklinCounty",
    "fairfield": "ButlerCounty",
    "findlay": "HancockCounty",
    "warren": "TrumbullCounty",
    "lancaster": "FairfieldCounty",
    "lima": "AllenCounty",
    "huber heights": "MontgomeryCounty",
    "westerville": "FranklinCounty",
    "marion": "MarionCounty",
    "grove city": "FranklinCounty",
    "reynoldsburg": "FranklinCounty",
    "upper arlington": "FranklinCounty",
    "gahanna": "FranklinCounty",
    "hilliard": "FranklinCounty",
    "pickerington": "FairfieldCounty",
    "worthington": "FranklinCounty",
    "bexley": "FranklinCounty",
    "whitehall": "FranklinCounty",
    "groveport": "FranklinCounty",
    "canal winchester": "FranklinCounty",
}


def county_of_city(c: Column) -> Column:
    """Null for a city that isn't listed."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CITY_COUNTY.items() for x in pair)), F.lower(F.trim(c)))


def first_text(*columns: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))
