"""From campaign files to participants, campaigns and exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import text as X
from canvass.functions import values as V
from canvass.operators import linkage, rollups
from canvass.sources import files


def campaigns(rows: DataFrame) -> DataFrame:
    """One row a campaign, with what its name tells."""
    name = F.col("name")
    one = rows.groupBy("campaign_id").agg(F.min("file_campaign").alias("name"), F.min("source_file").alias("source_file"))
    return one.withColumns({"agency": X.agency(name), "message_type": X.keyword(name), "category": X.category(name), "sent_at": V.date_in_name(name)})


def exposures(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """One row a participant and campaign: the first by e-mail, phone, address."""
    keys = ["participant_id", "campaign_id"]
    rest = [*files.FLAGS, "annual_savings", "kwh", "zip5", "city", "address"]
    order = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("email", "phone", "address", "source_file")))
    first = rows.where("participant_id IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    out = first.join(sent.select("campaign_id", "sent_at"), "campaign_id", "left").withColumn("channel", F.lit("email"))
    return out.withColumn("status", V.status(F.col("channel"), F.col("clicked"), F.col("opened")))


def participants(rows: DataFrame) -> DataFrame:
    """One row a participant: the best record by phone 2, address 2, city 1,
    zip 1, then the first file; and all its campaigns."""
    score = sum((F.col(c).isNotNull().cast("int") * n for c, n in (("phone", 2), ("address", 2), ("city", 1), ("zip5", 1))), F.lit(0))
    x = rows.where("participant_id IS NOT NULL").withColumn("_score", score)
    rest = ["email", "phone", "first_name", "last_name", "address", "city", "zip5", "kwh"]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("_score")).alias("s"), F.col("source_file")))
    return x.groupBy("participant_id").agg(best.alias("r"), F.sort_array(F.collect_set("campaign_id")).alias("source_campaigns")).select("participant_id", "r.*", "source_campaigns")


def summarise(people: DataFrame, seen: DataFrame, matches: DataFrame) -> DataFrame:
    """Participants with their engagement, match and completeness."""
    summary = rollups.by_channel(rollups.participant_summary(seen))
    out = people.join(summary, "participant_id", "left").join(matches.select(F.col("contact_id").alias("participant_id"), "quality", "method", "confidence", "parcel_id"), "participant_id", "left")
    demographic, residence, engaged = F.col("quality") == "demographic", F.col("parcel_id").isNotNull(), F.coalesce(F.col("total_exposures") > 0, F.lit(False))
    demographic = F.coalesce(demographic, F.lit(False))
    present = [F.col("email").isNotNull(), F.col("phone").isNotNull(), F.col("address").isNotNull(), demographic, residence, F.coalesce(F.col("kwh") > 0, F.lit(False)), engaged]
    return out.withColumns({"completeness": sum((p.cast("int") for p in present), F.lit(0)) / 7.0, "analysis_ready": demographic & engaged})


def build(spark: SparkSession, folder: str, zip_map: DataFrame, demographic: DataFrame, residential: DataFrame) -> dict[str, DataFrame]:
    """All tables; nothing is written."""
    rows = files.typed(files.read_campaigns(spark, folder))
    sent = campaigns(rows)
    seen, people = exposures(rows, sent), participants(rows)
    contacts = linkage.county_of_zip(people, zip_map).select(F.col("participant_id").alias("contact_id"), "county", "email", F.col("first_name").alias("first"), F.col("last_name").alias("last"), "phone", "address", F.col("zip5").alias("zip"))
    matches = linkage.match(contacts, demographic, residential)
    stats = rollups.campaign_statistics(seen)
    return {"campaigns": sent.join(stats, "campaign_id", "left"), "exposures": seen, "participants": summarise(people, seen, matches), "matches": matches}
