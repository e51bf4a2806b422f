"""A keyed table that batches are merged into, a part of it at a time.

Rows are dealt over a fixed number of buckets by a hash of their keys.  A batch
reads and rewrites the buckets that its keys fall in, under its own number; all
others stay as they are.  A manifest, renamed into its place last, says for every
bucket which version holds it.  So a batch is there as a whole or not at all: one
that broke off is written again over its own leftovers, one that is delivered
again after it was done changes nothing.  The last two manifests and what they name
are kept, for readers that began with the one before; what neither names goes.

    target/data/version=<batch>/bucket=<bucket>/*.parquet
    target/manifest/<batch>.json
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEPT = 2


class KeyedTable:
    """``buckets`` holds for a table from its first batch on; choose it so that a
    bucket is some hundred megabytes when the table is full."""

    def __init__(self, spark: SparkSession, target: str, keys: list[str], buckets: int = 64):
        self.spark, self.target, self.keys, self.buckets = spark, target.rstrip("/"), keys, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The batches whose manifests are there, the last one last."""
        at = self.path(f"{self.target}/manifest")
        names = [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, batch: int) -> dict:
        row = self.spark.read.text(f"{self.target}/manifest/{batch:012d}.json", wholetext=True).first()
        found = json.loads(row.value)
        if (found["keys"], found["buckets"]) != (self.keys, self.buckets):
            raise ValueError(f"{self.target} is keyed by {found['keys']} in {found['buckets']} buckets")
        return found

    def read(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        """The table of a manifest, or some of its buckets; None if these are empty."""
        versions = {int(k): v for k, v in manifest["versions"].items()}
        names = [f"{self.target}/data/version={v:012d}/bucket={k}" for k, v in sorted(versions.items()) if only is None or k in only]
        return self.spark.read.schema(manifest["schema"]).parquet(*names) if names else None

    def latest(self) -> DataFrame | None:
        done = self.batches()
        return self.read(self.manifest(done[-1])) if done else None

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: int, new: DataFrame, fold: Callable[[DataFrame, DataFrame, Observation], DataFrame]) -> dict:
        """Put ``new`` (rows of different keys) into the table as this batch.
        ``fold(old, new, observation)`` gives the rows of both and observes
        numbers, which the manifest keeps.  Returns the manifest."""
        done = self.batches()
        if batch in done:
            return self.manifest(batch)
        before = self.manifest(max(b for b in done if b < batch)) if any(b < batch for b in done) else None
        new = new.persist()
        try:
            # At most one row a bucket.
            touched = [r.b for r in new.select(self.bucket().alias("b")).distinct().collect()]
            kinds = ", ".join(f"`{n}` {k}" for n, k in new.dtypes)
            manifest = before or {"keys": self.keys, "buckets": self.buckets, "schema": kinds, "versions": {}}
            if touched:
                old = self.read(manifest, touched) if before else None
                seen = Observation()
                out = fold(self.spark.createDataFrame([], manifest["schema"]) if old is None else old, new, seen)
                out = out.select(*new.columns, self.bucket().alias("bucket"))
                out.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.target}/data/version={batch:012d}")
                manifest = manifest | {"versions": manifest["versions"] | {str(k): batch for k in touched}, "seen": seen.get}
        finally:
            new.unpersist()
        self._write(batch, manifest)
        self._clear()
        return manifest

    def _write(self, batch: int, manifest: dict) -> None:
        aside, place = (self.path(f"{self.target}/manifest/{n}") for n in (f".{batch:012d}.json", f"{batch:012d}.json"))
        out = self.files.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self.files.rename(aside, place)

    def _clear(self) -> None:
        done = self.batches()
        kept = [self.manifest(b) for b in done[-KEPT:]]
        named = {(v, int(k)) for m in kept for k, v in m["versions"].items()}
        for b in done[:-KEPT]:
            self.files.delete(self.path(f"{self.target}/manifest/{b:012d}.json"), False)
        at = self.path(f"{self.target}/data")
        for version in self.files.listStatus(at) if self.files.exists(at) else []:
            number = int(version.getPath().getName()[len("version=") :])
            if number > done[-1]:
                continue  # a batch under way
            left = [s.getPath() for s in self.files.listStatus(version.getPath()) if s.isDirectory()]
            for bucket in left:
                if (number, int(bucket.getName()[len("bucket=") :])) not in named:
                    self.files.delete(bucket, True)
            if not any(number == v for v, _ in named):
                self.files.delete(version.getPath(), True)
