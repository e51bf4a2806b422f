"""Roll-ups of exposures, messages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import values as V
from canvass.operators import merge, rollups
from canvass.sources.domain import EXPOSURES, exposures, table

CH = V.CHANNELS
_rate = lambda a, n: f"round(CASE WHEN {n} > 0 THEN {a} / CAST({n} AS DOUBLE) ELSE 0.0 END, 6)"
_cnt = lambda c, a: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {a}"


def campaign_statistics(spark, sf):
    return rollups.campaign_statistics(exposures(spark, sf))


CAMPAIGN_STATISTICS = f"""WITH {EXPOSURES}, g AS (
  SELECT campaign_id, count(*) AS total_sent, {_cnt('opened', 'opened')}, {_cnt('clicked', 'clicked')}, {_cnt('bounced', 'bounced')},
         {_cnt("status IN ('received','engaged')", 'received')}, {_cnt("status = 'engaged'", 'engaged')}
  FROM exposures GROUP BY campaign_id)
SELECT *, {_rate('received', 'total_sent')} AS receive_rate, {_rate('engaged', 'total_sent')} AS engage_rate FROM g"""


def participant_rollup(spark, sf):
    return rollups.participant_rollup(exposures(spark, sf))


PARTICIPANT_ROLLUP = f"""WITH {EXPOSURES}, g AS (
  SELECT participant_id, count(*) AS campaign_count, {', '.join(_cnt(f"channel = '{c}'", f'{c}_count') for c in CH)},
    {_cnt("channel = 'email' AND opened", 'email_opens')}, {_cnt("channel = 'email' AND clicked", 'email_clicks')}, {_cnt("channel = 'email' AND bounced", 'email_bounces')},
    {_cnt("status = 'engaged'", 'engaged_count')}, {_cnt("status = 'received'", 'received_count')},
    min(sent_at) AS first_sent, max(sent_at) AS last_sent, count(DISTINCT campaign_id) AS unique_campaign_count
  FROM exposures GROUP BY participant_id)
SELECT *, text_morning_count + text_evening_count AS text_count, mailer_count + letter_count AS postal_count,
  {_rate('email_opens', 'email_count')} AS email_open_rate, {_rate('email_clicks', 'email_count')} AS email_click_rate,
  {_rate('engaged_count', 'campaign_count')} AS engage_rate, {_rate('received_count', 'campaign_count')} AS receive_rate,
  engaged_count > 0 AS ever_engaged, received_count > 0 AS ever_received, email_clicks > 0 AS ever_clicked,
  CAST(floor(epoch(last_sent - first_sent) / 86400) AS BIGINT) AS exposure_days,
  CAST(email_count > 0 AS INTEGER) + CAST(text_morning_count + text_evening_count > 0 AS INTEGER) + CAST(mailer_count + letter_count > 0 AS INTEGER) AS channel_diversity
FROM g"""


def participant_channel_summary(spark, sf):
    return rollups.participant_summary(exposures(spark, sf))


PARTICIPANT_CHANNEL_SUMMARY = f"""WITH {EXPOSURES}, g AS (
  SELECT participant_id, count(DISTINCT campaign_id) AS total_campaigns, count(*) AS total_exposures,
    {_cnt("status IN ('received','engaged')", 'total_received')}, {_cnt("status = 'engaged'", 'total_engaged')},
    {', '.join(x for c in CH for x in (_cnt(f"channel = '{c}'", f'{c}_exposures'), _cnt(f"channel = '{c}' AND status IN ('received','engaged')", f'{c}_received'), _cnt(f"channel = '{c}' AND status = 'engaged'", f'{c}_engaged')))},
    min(sent_at) AS first_campaign_date, max(sent_at) AS last_campaign_date
  FROM exposures GROUP BY participant_id)
SELECT *, CASE WHEN total_engaged > 0 THEN 'engaged' WHEN total_received > 0 THEN 'received' ELSE 'no_engagement' END AS unified_status,
  {_rate('total_received', 'total_exposures')} AS overall_receive_rate, {_rate('total_engaged', 'total_exposures')} AS overall_engage_rate FROM g"""

TYPES = ["urgency", "savings", "relief"]


def message_type_exposure_pivot(spark, sf):
    """A campaign carries a type if one of its parts does."""
    types = exposures(spark, sf).select("campaign_id", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("part_id") % 3 + 1).cast("int")).alias("type"), (F.col("part_id") % 7 == 0).alias("on")).where("on")
    types = types.groupBy("campaign_id").agg(F.collect_set("type").alias("message_types"))
    return rollups.type_exposures(exposures(spark, sf), types, TYPES)


MESSAGE_TYPES = f"""WITH {EXPOSURES}, t AS (SELECT DISTINCT campaign_id, ['urgency','savings','relief'][part_id % 3 + 1] AS type FROM exposures WHERE part_id % 7 = 0),
p AS (SELECT DISTINCT participant_id, campaign_id FROM exposures)
SELECT participant_id, {', '.join(_cnt(f"type = '{t}'", f'msgtype_{t}_count') for t in TYPES)} FROM p JOIN t USING (campaign_id) GROUP BY participant_id"""


def campaign_stats_given_open(spark, sf):
    e = exposures(spark, sf)
    rate = F.avg(F.col("opened").cast("int"))
    given = F.avg(F.when(F.col("opened"), F.col("clicked").cast("int")))
    return e.groupBy("campaign_id").agg(
        F.count("participant_id").alias("n_sent"), V.count_where(F.col("opened")).alias("n_opened"), F.round(rate, 6).alias("open_rate"),
        V.count_where(F.col("clicked")).alias("n_clicked"), F.round(given, 6).alias("click_rate_given_open"), F.round(rate * given, 6).alias("conversion_rate"),
        F.min_by("channel", F.struct("sent_at", "participant_id", "part_id")).alias("first_channel"),
    )


CAMPAIGN_GIVEN_OPEN = f"""WITH {EXPOSURES}
SELECT campaign_id, count(participant_id) AS n_sent, {_cnt('opened', 'n_opened')}, round(avg(CAST(opened AS INT)), 6) AS open_rate, {_cnt('clicked', 'n_clicked')},
  round(avg(CASE WHEN opened THEN CAST(clicked AS INT) END), 6) AS click_rate_given_open,
  round(avg(CAST(opened AS INT)) * avg(CASE WHEN opened THEN CAST(clicked AS INT) END), 6) AS conversion_rate,
  arg_min(channel, {{'a': sent_at, 'b': participant_id, 'c': part_id}}) AS first_channel
FROM exposures GROUP BY campaign_id"""


def text_conversation_fold(spark, sf):
    """Users' turns come in, assistants' go out; even turns were read an hour later."""
    t = table(spark, sf, "conversations")
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).cast("timestamp_ntz")
    read = F.timestamp_seconds(F.lit(1_700_003_600) + F.col("turn") * 60).cast("timestamp_ntz")
    m = t.select(
        F.col("conv_id").alias("phone"), F.when(F.col("role") == "user", "in").when(F.col("role") == "assistant", "out").alias("type"),
        F.when(F.length("text") % 10 == 0, "failed").otherwise("ok").alias("status"), sent.alias("msg_time"),
        F.when(F.length("text") % 2 == 0, read).alias("read_time"), F.when(F.col("role") == "system", "DND").otherwise("").alias("tags"),
    )
    return rollups.conversations(m)


CONVERSATION_FOLD = """WITH m AS (SELECT conv_id AS phone, CASE role WHEN 'user' THEN 'in' WHEN 'assistant' THEN 'out' END AS type,
  CASE WHEN length(text) % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, make_timestamp((1700000000 + turn * 60) * 1000000) AS msg_time,
  CASE WHEN length(text) % 2 = 0 THEN make_timestamp((1700003600 + turn * 60) * 1000000) END AS read_time, CASE WHEN role = 'system' THEN 'DND' ELSE '' END AS tags FROM conversations)
SELECT phone, count(*) FILTER (WHERE type = 'out') AS messages_sent, count(*) FILTER (WHERE type = 'out' AND status = 'ok') AS messages_delivered,
  count(*) FILTER (WHERE type = 'out' AND status <> 'ok') AS messages_failed, count(*) FILTER (WHERE type = 'out' AND read_time IS NOT NULL) AS messages_read,
  coalesce(bool_or(type = 'in'), false) AS replied, coalesce(bool_or(contains(lower(tags), 'dnd')), false) AS opted_out,
  min(msg_time) FILTER (WHERE type = 'out') AS first_message_sent, max(msg_time) FILTER (WHERE type = 'out') AS last_message_sent,
  min(read_time) FILTER (WHERE type = 'out') AS first_read_time, max(read_time) FILTER (WHERE type = 'out') AS last_read_time,
  CASE WHEN coalesce(bool_or(contains(lower(tags), 'dnd')), false) THEN 'OPTED_OUT' ELSE 'ACTIVE' END AS account_status
FROM m GROUP BY phone"""


def or_aggregate_contacts(spark, sf):
    """A contact clicked if any event is a click; the rest is from its first event."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max((F.col("event_type") == "click").cast("int")).alias("click"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.round(F.min_by("value", F.struct("ts", "event_id")), 6).alias("first_value"))


OR_CONTACTS = """SELECT user_id, max(CAST(event_type = 'click' AS INTEGER)) AS click, arg_min(event_type, {'a': ts, 'b': event_id}) AS first_type,
  round(arg_min(value, {'a': ts, 'b': event_id}), 6) AS first_value FROM events GROUP BY user_id"""


def keep_all_pairs(spark, sf):
    """One row a contact and type, the last wins."""
    e = table(spark, sf, "events")
    key = F.concat_ws("_", F.col("user_id").cast("string"), "event_type")
    return e.groupBy(key.alias("pair")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("value"))


KEEP_ALL = """SELECT user_id || '_' || event_type AS pair, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, round(arg_max(value, {'a': ts, 'b': event_id}), 6) AS value FROM events GROUP BY 1"""


def engagement_combinations(spark, sf):
    e = table(spark, sf, "events")
    per = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "view").alias("o"), F.bool_or(F.col("event_type") == "click").alias("c"))
    return per.groupBy(F.concat_ws(",", F.col("o").cast("string"), F.col("c").cast("string")).alias("combination")).agg(F.count("*").alias("n"))


COMBINATIONS = """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'view') AS o, bool_or(event_type = 'click') AS c FROM events GROUP BY ALL)
SELECT CAST(o AS VARCHAR) || ',' || CAST(c AS VARCHAR) AS combination, count(*) AS n FROM p GROUP BY 1"""


def template_group_sets(spark, sf):
    """Documents grouped by their first word: number, set of sources, first id."""
    d = table(spark, sf, "documents")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    g = d.groupBy(word.alias("template")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min("doc_id").alias("first_id"), F.min_by("lang", "doc_id").alias("first_lang"))
    return g.where("n >= 2")


TEMPLATE_SETS = r"""SELECT regexp_extract(text, '^(\S+)', 1) AS template, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(doc_id) AS first_id, arg_min(lang, doc_id) AS first_lang
FROM documents GROUP BY 1 HAVING count(*) >= 2"""


def upsert_merge_flags(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("clicked"), (F.col("event_type") == "view").alias("viewed"), "event_type")
    half = lambda odd: e.where(F.col("event_id") % 2 == odd)
    fold = lambda x: x.groupBy("user_id").agg(F.bool_or("clicked").alias("clicked"), F.bool_or("viewed").alias("viewed"), F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("last_type"))
    return merge.merge_flags(fold(half(0)), fold(half(1)), ["user_id"], ["clicked", "viewed"], "last_id")


MERGE_FLAGS = """SELECT user_id, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'view') AS viewed, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"""


def stream_equals_batch(spark, sf):
    """What the incremental sync leaves behind, as one batch; tests hold the
    stream against it."""
    from canvass.streaming.sync import fold_events

    return fold_events(table(spark, sf, "events"))


STREAM_BATCH = """SELECT user_id, event_type, bool_or(value > 50) AS high, max(value > 90) AS very_high, count(DISTINCT event_id) AS n FROM events GROUP BY user_id, event_type"""


def array_union_merge(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda odd: o.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))
    return merge.add_to_set(side(0), side(1), "o_custkey", "tags").select("o_custkey", F.array_join("tags", ",").alias("tags"))


ARRAY_UNION = """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS tags FROM orders GROUP BY o_custkey"""


def union_sources(spark, sf):
    """Concatenated sources of different shape; the later lacks a column."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("state"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    both = o.withColumn("kind", F.lit("order")).unionByName(e.withColumn("kind", F.lit("event")), allowMissingColumns=True)
    return both.groupBy("kind", F.year("at").alias("year"), "state").agg(F.count("*").alias("n"), F.min("id").alias("first"))


UNION_SOURCES = """WITH u AS (SELECT o_orderkey AS id, o_orderdate AS t, o_orderstatus AS state, 'order' AS kind FROM orders UNION ALL SELECT event_id, ts, NULL, 'event' FROM events)
SELECT kind, CAST(year(t) AS INTEGER) AS year, state, count(*) AS n, min(id) AS first FROM u GROUP BY ALL"""


def first_wins_dedupe(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "event_type", "r.event_id", "r.ts")


FIRST_WINS = """SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"""


def last_wins_dedupe(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


LAST_WINS = """SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

QUERIES = {
    "campaign_statistics": (campaign_statistics, CAMPAIGN_STATISTICS),
    "participant_rollup": (participant_rollup, PARTICIPANT_ROLLUP),
    "participant_channel_summary": (participant_channel_summary, PARTICIPANT_CHANNEL_SUMMARY),
    "message_type_exposure_pivot": (message_type_exposure_pivot, MESSAGE_TYPES),
    "campaign_stats_given_open": (campaign_stats_given_open, CAMPAIGN_GIVEN_OPEN),
    "text_conversation_fold": (text_conversation_fold, CONVERSATION_FOLD),
    "or_aggregate_contacts": (or_aggregate_contacts, OR_CONTACTS),
    "keep_all_pairs": (keep_all_pairs, KEEP_ALL),
    "engagement_combinations": (engagement_combinations, COMBINATIONS),
    "template_group_sets": (template_group_sets, TEMPLATE_SETS),
    "upsert_merge_flags": (upsert_merge_flags, MERGE_FLAGS),
    "stream_equals_batch": (stream_equals_batch, STREAM_BATCH),
    "array_union_merge": (array_union_merge, ARRAY_UNION),
    "union_sources": (union_sources, UNION_SOURCES),
    "first_wins_dedupe": (first_wins_dedupe, FIRST_WINS),
    "last_wins_dedupe": (last_wins_dedupe, LAST_WINS),
}
