"""Ordered events to possessions: a native form, and a fold with state for rules that need one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that end a possession, and kinds whose value counts in it.
ENDS, SCORES = ("purchase", "error"), ("click", "view")


def possessions(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, poss, n, value, ending): a possession holds the rows up to and with the one that ends it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("event_type").isin(*ENDS)
    numbered = events.withColumn("poss", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    value = F.sum(F.when(F.col("event_type").isin(*SCORES), F.col("value")).otherwise(0.0))
    return numbered.groupBy(*keys, "poss").agg(F.count("*").alias("n"), F.round(value, 4).alias("value"), F.max(F.when(ends, F.col("event_type"))).alias("ending"))


def within_possessions(events: DataFrame, keys: list[str], order: list[str], clock: str) -> DataFrame:
    """Add start, the kind that ended the possession before (``start`` for the first), and seconds since this one's first row.

    ``clock`` is in microseconds.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("event_type").isin(*ENDS)
    kind = F.coalesce(F.last(F.when(ends, F.col("event_type")), ignorenulls=True).over(before), F.lit("start"))
    numbered = events.withColumn("start", kind).withColumn("poss", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    first = F.min(clock).over(Window.partitionBy(*keys, "poss"))
    return numbered.withColumn("seconds", F.round((F.col(clock) - first) / 1e6, 3))


class Fold:
    """The state of one key: an open possession."""

    def __init__(self) -> None:
        self.number = self.n = 0
        self.value = 0.0

    def take(self, kind: str, value: float) -> tuple | None:
        self.n += 1
        if kind in SCORES:
            self.value += value
        return self.close(kind) if kind in ENDS else None

    def close(self, ending: str | None) -> tuple | None:
        if not self.n:
            return None
        row = (self.number, self.n, round(self.value, 4), ending)
        self.number, self.n, self.value = self.number + 1, 0, 0.0
        return row


def possessions_folded(events: DataFrame, key: str) -> DataFrame:
    """The same table, by a pass over rows sorted within hash partitions.

    Batches stream through a task; only one key's open possession is held, so no key's rows are gathered, however
    many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fold = None, Fold()
        for batch in batches:
            out: list[tuple] = []
            for k, kind, value in zip(batch.column(key).to_pylist(), batch.column("event_type").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if k != own:
                    if own is not None and (row := fold.close(None)):
                        out.append((own, *row))
                    own, fold = k, Fold()
                if row := fold.take(kind, value or 0.0):
                    out.append((k, *row))
            yield batch_of(out)
        if own is not None and (row := fold.close(None)):
            yield batch_of([(own, *row)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "poss", "n", "value", "ending"])

    ordered = events.select(key, "us", "event_id", "event_type", "value").repartition(key).sortWithinPartitions(key, "us", "event_id")
    return ordered.select(key, "event_type", "value").mapInArrow(run, f"{key} long, poss long, n long, value double, ending string")
