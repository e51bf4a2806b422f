"""Engagement roll-ups over exposures, each one grouping over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions import values as V

GROUPS = {"email": ["email"], "text": ["text_morning", "text_evening"], "postal": ["mailer", "letter"]}


def campaign_statistics(exposures: DataFrame) -> DataFrame:
    """Per campaign: counts of what its exposures came to, and two rates."""
    engaged, received = F.col("status") == "engaged", F.col("status").isin("received", "engaged")
    out = exposures.groupBy("campaign_id").agg(
        F.count("*").alias("total_sent"),
        V.count_where(F.col("opened")).alias("opened"),
        V.count_where(F.col("clicked")).alias("clicked"),
        V.count_where(F.col("bounced")).alias("bounced"),
        V.count_where(received).alias("received"),
        V.count_where(engaged).alias("engaged"),
    )
    return out.withColumns({"receive_rate": F.round(V.rate(F.col("received"), F.col("total_sent")), 6), "engage_rate": F.round(V.rate(F.col("engaged"), F.col("total_sent")), 6)})


def participant_rollup(exposures: DataFrame) -> DataFrame:
    """Per participant: exposures by channel, engagement, first and last date,
    rates, channel diversity."""
    email = F.col("channel") == "email"
    out = exposures.groupBy("participant_id").agg(
        F.count("*").alias("campaign_count"),
        *(V.count_where(F.col("channel") == c).alias(f"{c}_count") for c in V.CHANNELS),
        V.count_where(email & F.col("opened")).alias("email_opens"),
        V.count_where(email & F.col("clicked")).alias("email_clicks"),
        V.count_where(email & F.col("bounced")).alias("email_bounces"),
        V.count_where(F.col("status") == "engaged").alias("engaged_count"),
        V.count_where(F.col("status") == "received").alias("received_count"),
        F.min("sent_at").alias("first_sent"),
        F.max("sent_at").alias("last_sent"),
        F.countDistinct("campaign_id").alias("unique_campaign_count"),
    )
    group = {g: sum((F.col(f"{c}_count") for c in cs[1:]), F.col(f"{cs[0]}_count")) for g, cs in GROUPS.items()}
    return out.withColumns(
        {
            "text_count": group["text"],
            "postal_count": group["postal"],
            "email_open_rate": F.round(V.rate(F.col("email_opens"), F.col("email_count")), 6),
            "email_click_rate": F.round(V.rate(F.col("email_clicks"), F.col("email_count")), 6),
            "engage_rate": F.round(V.rate(F.col("engaged_count"), F.col("campaign_count")), 6),
            "receive_rate": F.round(V.rate(F.col("received_count"), F.col("campaign_count")), 6),
            "ever_engaged": F.col("engaged_count") > 0,
            "ever_received": F.col("received_count") > 0,
            "ever_clicked": F.col("email_clicks") > 0,
            "exposure_days": F.coalesce(F.expr("timestampdiff(DAY, first_sent, last_sent)"), F.lit(0)).cast("long"),
            "channel_diversity": sum(((n > 0).cast("int") for n in list(group.values())[1:]), (group["email"] > 0).cast("int")),
        }
    )


def participant_summary(exposures: DataFrame) -> DataFrame:
    """Per participant: a struct for every channel, unified status, overall rates."""
    engaged, received = F.col("status") == "engaged", F.col("status").isin("received", "engaged")
    parts = []
    for c in V.CHANNELS:
        here = F.col("channel") == c
        parts += [V.count_where(here).alias(f"{c}_exposures"), V.count_where(here & received).alias(f"{c}_received"), V.count_where(here & engaged).alias(f"{c}_engaged")]
    out = exposures.groupBy("participant_id").agg(
        F.countDistinct("campaign_id").alias("total_campaigns"), F.count("*").alias("total_exposures"), V.count_where(received).alias("total_received"), V.count_where(engaged).alias("total_engaged"),
        *parts, F.min("sent_at").alias("first_campaign_date"), F.max("sent_at").alias("last_campaign_date"),
    )
    return out.withColumns(
        {
            "unified_status": F.when(F.col("total_engaged") > 0, "engaged").when(F.col("total_received") > 0, "received").otherwise("no_engagement"),
            "overall_receive_rate": F.round(V.rate(F.col("total_received"), F.col("total_exposures")), 6),
            "overall_engage_rate": F.round(V.rate(F.col("total_engaged"), F.col("total_exposures")), 6),
        }
    )


def by_channel(summary: DataFrame) -> DataFrame:
    """The summary's channel columns as one map of structs."""
    entry = lambda c: F.struct(*(F.col(f"{c}_{k}").alias(k) for k in ("exposures", "received", "engaged")))
    made = F.create_map(*(x for c in V.CHANNELS for x in (F.lit(c), entry(c))))
    return summary.withColumn("by_channel", made).drop(*(f"{c}_{k}" for c in V.CHANNELS for k in ("exposures", "received", "engaged")))


def type_exposures(exposures: DataFrame, types: DataFrame, names: list[str]) -> DataFrame:
    """Per participant, for each message type, the number of different campaigns
    that carry it.  ``types``: campaign_id, message_types array."""
    pairs = exposures.select("participant_id", "campaign_id").distinct()
    carried = types.select("campaign_id", F.explode(F.array_distinct("message_types")).alias("type"))
    return pairs.join(carried, "campaign_id").groupBy("participant_id").agg(*(V.count_where(F.col("type") == n).alias(f"msgtype_{n}_count") for n in names))


def conversations(messages: DataFrame) -> DataFrame:
    """Per phone: what its messages came to.  ``messages``: phone, type in/out,
    status, msg_time, read_time, tags."""
    out, inward = F.col("type") == "out", F.col("type") == "in"
    fine = F.coalesce(F.col("status") == "ok", F.lit(False))
    return messages.groupBy("phone").agg(
        V.count_where(out).alias("messages_sent"),
        V.count_where(out & fine).alias("messages_delivered"),
        V.count_where(out & ~fine).alias("messages_failed"),
        V.count_where(out & F.col("read_time").isNotNull()).alias("messages_read"),
        F.coalesce(F.bool_or(inward), F.lit(False)).alias("replied"),
        F.coalesce(F.bool_or(F.lower("tags").contains("dnd")), F.lit(False)).alias("opted_out"),
        F.min(F.when(out, F.col("msg_time"))).alias("first_message_sent"),
        F.max(F.when(out, F.col("msg_time"))).alias("last_message_sent"),
        F.min(F.when(out, F.col("read_time"))).alias("first_read_time"),
        F.max(F.when(out, F.col("read_time"))).alias("last_read_time"),
    ).withColumn("account_status", F.when(F.col("opted_out"), "OPTED_OUT").otherwise("ACTIVE"))
