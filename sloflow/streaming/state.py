"""Versioned tables that carry state from one micro-batch to the next."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class StateTable:
    """One version of a table per micro-batch, in a folder all executors reach.

    A batch reads the newest version before its own id and writes its own version, so a repeated
    batch gives the same result.  There is one writer: the stream that owns the folder.
    """

    path: str
    schema: T.StructType

    def _folder(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, spark: SparkSession) -> list[int]:
        """Versions that were written completely."""
        path, files = self._folder(spark)
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            name = status.getPath().getName()
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and files.exists(done):
                found.append(int(name[1:]))
        return sorted(found)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The newest version, or the newest before a batch; empty if there is none."""
        versions = [n for n in self.versions(spark) if before is None or n < before]
        if not versions:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/v{versions[-1]}")

    def write(self, table: DataFrame, version: int, keep: int = 2) -> None:
        """Write a version and drop those that no repeated batch can need any more."""
        spark = table.sparkSession
        columns = [table[f.name].cast(f.dataType).alias(f.name) for f in self.schema]
        table.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        path, files = self._folder(spark)
        for old in [n for n in self.versions(spark) if n < version][: -(keep - 1) or None]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"v{old}"), True)


_TIMES = T.StructType([T.StructField("newest", T.LongType()), T.StructField("mark", T.LongType())])


@dataclass(frozen=True)
class DeltaState:
    """One row per key, of which a micro-batch reads and writes what it touches.

    Keys are dealt into buckets by a hash.  A batch writes its changed rows, by bucket, as a new version; of each
    key the newest version counts.  Once the changes of a bucket have grown to half of what is below them, the
    batch that touches it writes the bucket anew, so what is written follows the changes and not the state.
    ``second`` is the time of a row: rows older than the mark that a batch sets are no longer read, and go when
    their bucket is written anew.  A repeated batch reads the same rows and overwrites its own.
    """

    path: str
    schema: T.StructType
    key: Callable[[], Column]
    second: Callable[[], Column] | None = None
    buckets: int = 64
    #: Versions of changes a bucket has at least before it is written anew.
    least: int = 4

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key()), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows: at most ``buckets`` numbers."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def _times(self) -> StateTable:
        return StateTable(f"{self.path}/times", _TIMES)

    def _versions(self, spark: SparkSession, kind: str) -> dict[int, list[int]]:
        """Per bucket the complete versions."""
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        glob = lambda pattern: files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, pattern)) or []
        done = {status.getPath().getParent().getName() for status in glob("v*/_SUCCESS")}
        found: dict[int, list[int]] = {}
        for status in glob("v*/bucket=*"):
            version = status.getPath().getParent().getName()
            if version in done:
                found.setdefault(int(status.getPath().getName().split("=")[1]), []).append(int(version[1:]))
        return {bucket: sorted(versions) for bucket, versions in found.items()}

    def _parts(self, spark: SparkSession, before: int, whole_before: int, buckets: Sequence[int] | None) -> dict[int, list[str]]:
        """Per bucket the folders whose rows make up its state, the whole one first."""
        whole, changes = self._versions(spark, "whole"), self._versions(spark, "changes")
        found = {}
        for bucket in sorted({*whole, *changes}) if buckets is None else buckets:
            base = max((v for v in whole.get(bucket, []) if v < whole_before), default=-1)
            later = [v for v in changes.get(bucket, []) if base < v < before]
            folders = [f"whole/v{base}"] * (base >= 0) + [f"changes/v{v}" for v in later]
            if folders:
                found[bucket] = [f"{self.path}/{folder}/bucket={bucket}" for folder in folders]
        return found

    def _rows(self, spark: SparkSession, folders: Sequence[str], mark: int | None) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("__version", T.LongType())])
        if not folders:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(stored).parquet(*folders)
        row = F.struct(*[F.col(f"`{f.name}`") for f in self.schema])
        latest = rows.groupBy(self.key().alias("__key")).agg(F.max_by(row, "__version").alias("row")).select("row.*")
        return latest.filter(self.second() >= mark) if self.second and mark is not None else latest

    def read(
        self, spark: SparkSession, before: int | None = None, buckets: Sequence[int] | None = None, marked: int | None = None
    ) -> DataFrame:
        """The state before a batch, or the newest; all of it, or of some buckets.  ``marked`` takes the mark from before another batch."""
        before = 1 << 62 if before is None else before
        times = self._times().read(spark, before if marked is None else marked).first()
        folders = [x for part in self._parts(spark, before, before, buckets).values() for x in part]
        return self._rows(spark, folders, times["mark"] if times else None)

    def advance(self, spark: SparkSession, number: int, newest: int | None, seconds: int) -> None:
        """Note the newest time of a batch; rows more than ``seconds`` older than the time reached have ended.

        That time is the newest one of this batch, but not later than the newest one before it nor than the
        clock of the driver, so rows dated in the future do not end the others.
        """
        known = self._times().read(spark, number).first()
        before, mark = (known["newest"], known["mark"]) if known else (None, None)
        if newest is not None and before is not None:
            reached = min(newest, before, int(time.time())) - seconds
            mark = reached if mark is None else max(mark, reached)
        newest = before if newest is None else newest if before is None else max(before, newest)
        self.mark(spark, number, newest, mark)

    def mark(self, spark: SparkSession, number: int, newest: int | None, mark: int | None) -> None:
        """Note the newest time there is and the time before which rows have ended."""
        self._times().write(spark.createDataFrame([(newest, mark)], _TIMES), number)

    def write(self, changes: DataFrame, number: int) -> None:
        """Write the rows that a batch has changed, each key once."""
        spark = changes.sparkSession
        columns = [changes[f.name].cast(f.dataType).alias(f.name) for f in self.schema]
        rows = changes.select(*columns).withColumns({"__version": F.lit(number).cast("long"), "bucket": self.bucket()})
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/v{number}")
        touched = [b for b, versions in self._versions(spark, "changes").items() if number in versions]
        due = {}
        for bucket, folders in self._parts(spark, number + 1, number, touched).items():
            bytes_ = [self._bytes(spark, x) for x in folders]
            base = bytes_[0] if "/whole/" in folders[0] else 0
            if len(folders) - (base > 0) >= self.least and sum(bytes_) - base >= base / 2:
                due[bucket] = folders
        if not due:
            return
        times = self._times().read(spark, number + 1).first()
        whole = self._rows(spark, [x for folders in due.values() for x in folders], times["mark"] if times else None)
        whole = whole.withColumns({"__version": F.lit(number).cast("long"), "bucket": self.bucket()})
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/whole/v{number}")
        self._drop(spark, list(due))

    def _bytes(self, spark: SparkSession, folder: str) -> int:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def _drop(self, spark: SparkSession, buckets: Sequence[int]) -> None:
        """Delete what stands below the last but one whole version: no repeated batch reads it."""
        versions = {kind: self._versions(spark, kind) for kind in ("whole", "changes")}
        for bucket in buckets:
            kept = versions["whole"].get(bucket, [])[-2:]
            if len(kept) < 2:
                continue
            for kind, of in versions.items():
                for old in (v for v in of.get(bucket, []) if v < kept[0] or (kind == "changes" and v == kept[0])):
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/v{old}/bucket={bucket}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
