"""Sinks and incremental stores: Parquet, CSV and JSON folders, partition upserts, snapshots, eviction.

Everything goes through Spark's readers and writers, in the folder the cluster shares.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a session on one machine that names none (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="store")
    return f"{base}/store-{uuid.uuid4().hex}"


#: For rows of up to some MB: row groups of 16 MB, and pages of 256 kB or so that are closed after any row instead of the hundredth.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.enable.dictionary": "false"}


def kept(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Rows that several results read, written once to the shared folder: no executor has to hold them, or to be there still."""
    place = shared_folder(df.sparkSession)
    df.write.options(**(options or {})).parquet(place)
    return df.sparkSession.read.parquet(place)


def in_few(df: DataFrame) -> DataFrame:
    """A partition a core at most, for rows that are written next: a file each.

    Without Hadoop's native library an executor starts two processes for every file that it creates on a local file
    system, and each of them shares all of the executor's memory for a moment.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """Write as ``parquet``, ``csv``, ``json`` or ``orc`` and read back with the same schema."""
    place = shared_folder(df.sparkSession)
    writer = df.write.option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(place)
    reader = df.sparkSession.read.schema(df.schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(place)


class PartitionStore:
    """A Parquet folder partitioned by one column, whose partitions are replaced whole."""

    def __init__(self, spark: SparkSession, key: str, place: str | None = None):
        self.spark, self.key, self.place = spark, key, place or shared_folder(spark)

    def upsert(self, rows: DataFrame) -> PartitionStore:
        """Replace the partitions that occur in ``rows``; the others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.place)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.place)

    def evict(self, *values: object) -> PartitionStore:
        """Delete the partitions of these values."""
        for value in values:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{self.key}={value}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The keys of ``wanted`` that have no partition yet."""
        have = self.read().select(self.key).distinct()
        return wanted.select(self.key).distinct().join(have, self.key, "left_anti")

    def upsert_stream(self, stream: DataFrame) -> PartitionStore:
        """Drain a stream; each micro-batch replaces its partitions, so a batch that runs again changes nothing."""
        run = stream.writeStream.foreachBatch(lambda rows, _: self.upsert(rows) and None).option("checkpointLocation", f"{self.place}-offsets").trigger(availableNow=True).start()
        run.awaitTermination()
        return self


def audit(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that disappeared or are new between two runs: (keys, change)."""
    gone = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("gone"))
    new = after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("new"))
    return gone.unionByName(new)
