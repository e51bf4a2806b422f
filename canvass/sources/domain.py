"""Domain tables seen through the driver's star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import values as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXPOSURES = """exposures AS (
  SELECT o_custkey AS participant_id, l_suppkey AS campaign_id, l_partkey AS part_id,
         CASE l_linenumber % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'text_morning' WHEN 2 THEN 'text_evening' WHEN 3 THEN 'mailer' ELSE 'letter' END AS channel,
         l_returnflag <> 'N' AS opened, l_returnflag = 'R' AS clicked, l_linestatus = 'F' AND l_returnflag = 'N' AS bounced,
         l_shipdate AS sent_at, l_extendedprice * l_discount AS savings,
         CASE WHEN l_returnflag = 'R' THEN 'engaged' WHEN l_returnflag <> 'N' THEN 'received' ELSE 'no_engagement' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an exposure of a participant to a campaign."""
    kind = F.col("l_linenumber") % 5
    channel = F.when(kind == 0, "email").when(kind == 1, "text_morning").when(kind == 2, "text_evening").when(kind == 3, "mailer").otherwise("letter")
    opened, clicked = F.col("l_returnflag") != "N", F.col("l_returnflag") == "R"
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("participant_id"),
            F.col("l_suppkey").alias("campaign_id"),
            F.col("l_partkey").alias("part_id"),
            channel.alias("channel"),
            opened.alias("opened"),
            clicked.alias("clicked"),
            ((F.col("l_linestatus") == "F") & ~opened).alias("bounced"),
            F.col("l_shipdate").alias("sent_at"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("savings"),
        )
        .withColumn("status", V.status(F.col("channel"), F.col("clicked"), F.col("opened")))
    )


PARTICIPANTS = """participants AS (
  SELECT c_custkey AS participant_id, n_name AS county, c_nationkey AS zip, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS income, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("participant_id"), F.col("n_name").alias("county"), F.col("c_nationkey").alias("zip"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("income"), F.col("c_mktsegment").alias("segment"),
    )


CAMPAIGNS = """campaigns AS (
  SELECT s_suppkey AS campaign_id, s_name AS name, n_name AS agency, s_acctbal AS budget
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("campaign_id"), F.col("s_name").alias("name"), F.col("n_name").alias("agency"), F.col("s_acctbal").alias("budget"),
    )
