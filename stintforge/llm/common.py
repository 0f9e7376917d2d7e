"""Helpers shared by the corpus operators: reading tables, cutting lineage, Arrow passes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintforge.sources.shipping import ship

#: Words of every operator here: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A small table is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 20_000
#: A key of more rows is joined by broadcast.
HOT_ROWS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine that names none (tests) gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise slim rows in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write wide rows as Parquet in the shared folder and read them again."""
    place = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def forget(df: DataFrame) -> None:
    """Delete the files that ``written`` made for ``df``; nothing may read them any more."""
    spark = df.sparkSession
    plain = lambda place: re.sub(r"^(\w+):/+", r"\1:/", place)
    own = plain(f"{shared_dir(spark)}/written-")
    for folder in {plain(f).rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith(own):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Write rows that are dealt by ``keys`` into ``n`` partitions as a bucketed table in the shared folder.

    Joins and aggregations by the keys then need no shuffle.  The catalogue forgets the table at once; its files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).format("parquet").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised table after counting its rows; larger ones stay with shuffled joins."""
    return F.broadcast(df) if df.count() <= most else df


def join_spread(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """Inner join of materialised rows to a table with unique ``key``.

    A key of many rows would meet them in one task.  Such keys, under 20,000 by this count, are sent to the rows.
    """
    full = max(HOT_ROWS, rows.count() // BROADCAST_ROWS + 1)
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > full).select(key))
    if hot.isEmpty():
        return rows.join(by_key, key)
    sent = cut(by_key.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(by_key, key)
    return rest.unionByName(rows.join(F.broadcast(sent), key))


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``step`` on every Arrow batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken."""
    while name in taken:
        name += "_"
    return name


def binary_parts(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a binary column in one buffer, and its row offsets (nulls are empty)."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return data, at


def held_out(divisor: int, remainder: int):
    """Rows kept away from learning: crc32 of the id's text modulo ``divisor``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))
