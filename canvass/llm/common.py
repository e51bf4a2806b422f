"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python.  All operators set the same
#: value, so it doesn't matter which of them was built last.
BATCH_BYTES = 4 << 20
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes that numpy works on at once, unless an operator says otherwise.
PART_ROWS, PART_BYTES = 512, 1 << 20
#: Removes the shuffle files of a write when it ends, rather than whenever the
#: driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.
    Where it is unset, a session in one process (tests) gets a temporary
    folder; on a cluster that would be lost files, so it is an error."""
    global _own_dir
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="canvass-llm-")
    return _own_dir


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Run with these session settings, then restore the earlier ones."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_made: list[Scratch] | None = None


@contextlib.contextmanager
def released():
    """Removes on leaving what the operators called inside have left in the
    shared folder.  Their results must have been read by then."""
    global _made
    outer, _made = _made, []
    try:
        yield
    finally:
        for s in _made:
            s.close()
        _made = outer


class Scratch:
    """Intermediate tables of one operator run, in the shared folder.

    ``keep`` writes a frame as Parquet and reads it again, which cuts the
    lineage: a lost executor costs one stage and never the whole chain.
    ``drop`` deletes a table that no later step reads, ``close`` all of them.
    A frame that an operator returns still reads its tables; they go when the
    block of ``released`` ends that it was made in, else with the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        path, files = self._at(self.root)
        files.deleteOnExit(path)
        if _made is not None:
            _made.append(self)

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with settings(self.spark, **{CLEANUP: "true"}):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, files = self._at(t._scratch_path)
            files.delete(path, True)

    def close(self) -> None:
        path, files = self._at(self.root)
        files.delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session does so itself.
    The setting is read when a frame runs, so it stays set."""
    if spark.conf.get(BYTES_CONF, None) in (None, str((1 << 31) - 1)):
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))


def parts(batches: Iterable[pa.RecordBatch], rows: int = PART_ROWS, size: int = PART_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and bytes of the column at most; a
    longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(lengths)
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = min(low + rows, max(int(np.searchsorted(ends, before + size, "right")), low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """As many partitions as the session shuffles into, or more where a task
    would otherwise hold over ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` ('' for null).  Rows without a doc_id
    can't be referred to and take no part."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("doc_id IS NOT NULL")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
