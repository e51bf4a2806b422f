"""Tables that a job keeps between its steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a session in one
    process gets a temporary folder; on a cluster that is an error."""
    global _own
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="canvass-")
    return _own


def kept(rows: DataFrame, name: str = "step") -> DataFrame:
    """The rows, written once and read from there: a lost executor costs no earlier
    step.  The table goes with the session."""
    spark = rows.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows.write.parquet(where)
    return spark.read.schema(rows.schema).parquet(where)
