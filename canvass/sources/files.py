"""Campaign files and landed JSON: schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions import text as X
from canvass.functions import values as V

# The columns of a campaign's export, in order.
EXPORT = [
    "campaign_name", "campaign_sent_at", "email", "first_name", "last_name", "city", "zip", "kwh", "cell", "address", "annual_cost",
    "annual_savings", "monthly_cost", "monthly_saving", "daily_cost", "opened", "clicked", "bounced", "complained", "unsubscribed", "status",
]
FLAGS = ["opened", "clicked", "bounced", "complained", "unsubscribed"]
MONEY = ["annual_cost", "annual_savings", "monthly_cost", "monthly_saving", "daily_cost"]
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EXPORT])


def read_campaigns(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """All ``campaign_<id>_<name>.csv`` files of a folder, text columns with the
    file's id and name beside them.  ``limit`` takes the first rows by file and
    e-mail."""
    rows = spark.read.schema(CSV_SCHEMA).option("header", True).option("pathGlobFilter", "campaign_*.csv").csv(folder)
    name = F.col("_metadata.file_name")
    found = rows.select("*", F.regexp_extract(name, r"campaign_([a-f0-9-]+)_(.+)\.csv$", 1).alias("campaign_id"), F.regexp_extract(name, r"campaign_([a-f0-9-]+)_(.+)\.csv$", 2).alias("file_campaign"), name.alias("source_file"))
    return found if limit is None else found.orderBy("source_file", "email", "cell").limit(limit)


def typed(rows: DataFrame) -> DataFrame:
    """Flags, money, dates and keys of the text rows; every missing value is null."""
    out = {c: X.yes(F.col(c)) for c in FLAGS} | {c: V.currency(F.col(c)) for c in [*MONEY, "kwh"]}
    out |= {c: V.text(F.col(c)) for c in ("first_name", "last_name", "city", "address", "status")}
    out |= {"email": F.nullif(F.trim(F.lower("email")), F.lit("")), "phone": F.nullif(X.phone(F.col("cell")), F.lit("")), "zip5": X.zip_digits(F.col("zip")), "sent_at": F.col("campaign_sent_at").try_cast("date")}
    rows = rows.withColumns(out)
    return rows.withColumn("participant_id", F.coalesce("email", "phone"))


def person_id(email: Column, *names: Column) -> Column:
    """The e-mail's key, else the parts of the name joined and trimmed; null for neither."""
    parts = F.concat_ws(" ", *(F.nullif(F.trim(n), F.lit("")) for n in names))
    return F.coalesce(X.email(email), F.nullif(F.trim(parts), F.lit("")))


def write_export(rows: DataFrame, path: str) -> None:
    """The 21-column export, a folder a campaign: flags as Yes and No, null as ''."""
    cols = [X.yes_no(F.coalesce(c, F.lit(False))).alias(c) if c in FLAGS else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT]
    rows.select("campaign_id", *cols).write.mode("overwrite").partitionBy("campaign_id").option("header", True).option("emptyValue", "").csv(path)


def enriched(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Opened rows alone, flags as 1 and 0, the customer's name by e-mail: that
    of the first county if several know it."""
    order = W.partitionBy("email_key").orderBy("county")
    named = people.select(X.email(F.col("email")).alias("email_key"), "customer_name", "county").where("email_key IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    kept = rows.where(X.yes(F.col("opened"))).withColumn("email_key", X.email(F.col("email"))).join(named.select("email_key", "customer_name"), "email_key", "left")
    before = EXPORT[: EXPORT.index("last_name") + 1]
    after = [c for c in EXPORT[len(before) :] if c not in ("status", "annual_cost")]
    cols = [X.yes(F.col(c)).cast("int").alias(c) if c in FLAGS else F.col(c) for c in after]
    return kept.select(*before, "customer_name", *cols)


REPORT = T.StructType(
    [
        T.StructField("campaign_id", T.StringType()), T.StructField("report_type", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("synced_at", T.TimestampNTZType()),
        T.StructField("data", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("email_address", T.StringType()), T.StructField("contact", T.StructType([T.StructField("id", T.StringType()), T.StructField("email_address", T.StringType())]))]))),
    ]
)


def read_reports(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Landed pages of report contacts, one row a contact; a wrapped contact is
    unwrapped, and what a page repeats counts once."""
    reader = spark.readStream if stream else spark.read
    pages = reader.schema(REPORT).json(folder)
    one = pages.select("campaign_id", "report_type", "synced_at", F.explode("data").alias("c"))
    rows = one.select("campaign_id", F.coalesce("c.contact.id", "c.id").alias("contact_id"), F.coalesce("c.contact.email_address", "c.email_address").alias("email"), "report_type", "synced_at")
    return rows if stream else rows.dropDuplicates(["campaign_id", "report_type", "contact_id"])


def read_zip_map(spark: SparkSession, path: str) -> DataFrame:
    """zip5, county, candidates from a JSON object of two maps."""
    schema = "zipcode_map map<string,string>, multi_county map<string,array<string>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path)
    single = one.select(F.explode("zipcode_map").alias("zip5", "county"))
    many = one.select(F.explode_outer("multi_county").alias("zip5", "candidates")).where("zip5 IS NOT NULL")
    return single.join(many, "zip5", "left")


# The columns of the export of matched contacts, in order.
MATCHED = ["Name", "Campaign", "County", "Opened", "Clicked", "Applied", "Age", "Income", "YearBuilt"]


def matched(rows: DataFrame) -> DataFrame:
    """Matched contacts as text: rows with a name alone, flags as Yes and No,
    null as ''.  Columns name, campaign, county, opened, clicked, applied, age,
    income, year_built."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flag = lambda c: X.yes_no(F.coalesce(F.col(c), F.lit(False)))
    cols = [plain("name"), plain("campaign"), plain("county"), flag("opened"), flag("clicked"), flag("applied"), plain("age"), plain("income"), plain("year_built")]
    return rows.where(X.blank_to_null(F.col("name")).isNotNull()).select(*(c.alias(n) for c, n in zip(cols, MATCHED, strict=True)))


def write_matched(rows: DataFrame, path: str) -> None:
    matched(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_classifications(spark: SparkSession, path: str) -> DataFrame:
    """campaign_id, types from JSON lines; a campaign named twice has the types of both."""
    rows = spark.read.schema("campaign_id string, types array<string>").json(path).where("campaign_id IS NOT NULL")
    return rows.groupBy("campaign_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, so that every line has all fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_unmatched(matches: DataFrame, path: str, most: int | None = None) -> None:
    """Contacts without a match, for review; ``most`` takes the first by id."""
    rows = matches.where(F.col("quality").isin("no_match", "no_county"))
    (rows if most is None else rows.orderBy("contact_id").limit(most)).write.mode("overwrite").option("header", True).csv(path)


def catalog(spark: SparkSession) -> DataFrame:
    """Tables of the session with their number of rows."""
    names = [t.name for t in spark.catalog.listTables()]
    counts = [spark.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in names]
    out = spark.createDataFrame([], "table string, rows long")
    for c in counts:
        out = out.unionByName(c)
    return out


def cache_key(ids: Column) -> Column:
    """An aggregate: the digest that names the prepared data of some campaigns,
    whatever their order.  The ids of one group meet in one row."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), "_"))
