"""The build in phases, each reading what the one before it wrote.

``import`` writes campaigns, exposures and people, ``match`` their parcels,
``summarize`` the participants, ``stats`` the campaigns' statistics.  A phase can be
run by itself once those before it are there.  A dry run counts what each phase
would write, as a whole, and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators import linkage, rollups
from canvass.plans import star_schema
from canvass.sources import files

PHASES = ("import", "match", "summarize", "stats")


class Build:
    def __init__(self, spark: SparkSession, folder: str, target: str, zip_map: DataFrame, demographic: DataFrame, residential: DataFrame):
        self.spark, self.folder, self.target = spark, folder, target.rstrip("/")
        self.zip_map, self.demographic, self.residential = zip_map, demographic, residential
        self.planned: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A table of an earlier phase: as planned in this run, else as written."""
        return self.planned[name] if name in self.planned else self.spark.read.parquet(f"{self.target}/{name}")

    def imported(self) -> dict[str, DataFrame]:
        rows = files.typed(files.read_campaigns(self.spark, self.folder))
        sent = star_schema.campaigns(rows)
        return {"campaigns": sent, "exposures": star_schema.exposures(rows, sent), "people": star_schema.participants(rows)}

    def matched(self) -> dict[str, DataFrame]:
        people = linkage.county_of_zip(self.table("people"), self.zip_map)
        contacts = people.select(F.col("participant_id").alias("contact_id"), "county", "email", F.col("first_name").alias("first"), F.col("last_name").alias("last"), "phone", "address", F.col("zip5").alias("zip"))
        return {"matches": linkage.match(contacts, self.demographic, self.residential)}

    def summarized(self) -> dict[str, DataFrame]:
        return {"participants": star_schema.summarise(self.table("people"), self.table("exposures"), self.table("matches"))}

    def counted(self) -> dict[str, DataFrame]:
        return {"statistics": self.table("campaigns").join(rollups.campaign_statistics(self.table("exposures")), "campaign_id", "left")}

    def run(self, phases: tuple[str, ...] = PHASES, dry: bool = False) -> dict[str, int]:
        """Rows of each table of these phases, in their order.  What is written
        replaces what an earlier run wrote."""
        unknown = set(phases) - set(PHASES)
        if unknown:
            raise ValueError(f"no phase {', '.join(sorted(unknown))}")
        steps: dict[str, Callable] = dict(zip(PHASES, (self.imported, self.matched, self.summarized, self.counted), strict=True))
        found = {}
        self.planned = {}
        for phase in (p for p in PHASES if p in phases):
            for name, rows in steps[phase]().items():
                if dry:
                    self.planned[name] = rows
                else:
                    rows.write.mode("overwrite").parquet(f"{self.target}/{name}")
                found[name] = self.table(name).count()
        return found
