"""Incremental sync: landed files stream in, flags only rise.

The merge is idempotent and commutative, so replays and late files change
nothing, and a batch over all files equals the stream at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.operators import merge
from canvass.streaming.table import KeyedTable


def fold_events(events: DataFrame) -> DataFrame:
    """Per user and type: flags, and the number of different events."""
    return events.groupBy("user_id", "event_type").agg(
        F.bool_or(F.col("value") > 50).alias("high"), F.max(F.col("value") > 90).alias("very_high"), F.countDistinct("event_id").alias("n"),
    )


def fold_stream(events: DataFrame, late: str | None = None) -> DataFrame:
    """The streaming form: repeated deliveries of an event are dropped by id.  With
    ``late`` (as '2 hours') ids are forgotten once events are so much newer, so the
    state is bounded; a repeat within that time counts once."""
    once = events.dropDuplicates(["event_id"]) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("user_id", "event_type").agg(
        F.bool_or(F.col("value") > 50).alias("high"), F.max(F.col("value") > 90).alias("very_high"), F.count("*").alias("n"),
    )


def reports_to_flags(reports: DataFrame) -> DataFrame:
    """Report rows (campaign_id, contact_id, report_type, synced_at) as flags per
    contact; a click implies an opening."""
    kind = F.col("report_type")
    return reports.dropDuplicates(["campaign_id", "contact_id", "report_type"]).groupBy("campaign_id", "contact_id").agg(
        F.bool_or(kind.isin("opened", "clicked")).alias("opened"), *(F.bool_or(kind == k).alias(k) for k in ("clicked", "bounced", "complained", "unsubscribed")), F.max("synced_at").alias("synced_at"),
    )


FLAGS = ["opened", "clicked", "bounced", "complained", "unsubscribed"]
KEYS = ["campaign_id", "contact_id"]


def start(spark: SparkSession, reports: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Merge each batch of reports into the keyed table at ``target``: only the
    buckets that the batch's contacts fall in are read and written.  The manifest
    of a batch has the numbers of contacts inserted, updated and unchanged."""
    table = KeyedTable(spark, target, KEYS, buckets)

    def merge_batch(batch: DataFrame, number: int) -> None:
        table.merge(number, reports_to_flags(batch), lambda old, new, seen: merge.merge_flags(old, new, KEYS, FLAGS, "synced_at", seen))

    writer = reports.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, target: str, buckets: int = 64) -> DataFrame | None:
    """The table as the last batch left it; None before the first."""
    return KeyedTable(spark, target, KEYS, buckets).latest()


def stale(campaigns: DataFrame, hours: int, now) -> DataFrame:
    """Campaigns never synced or not within the last hours."""
    return campaigns.where(F.col("synced_at").isNull() | (F.col("synced_at") < F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")))


def refresh(campaigns: DataFrame, fetched: DataFrame, keys: list[str], hours: int, now) -> DataFrame:
    """Campaigns with what was fetched merged in for the stale ones; what was
    fetched for others is left aside."""
    due = stale(campaigns, hours, now).select(*keys)
    return merge.upsert(campaigns, fetched.join(due, keys, "left_semi"), keys, "synced_at")
