"""Ordered operators: islands, streaks, halves, neighbours, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], state: list[str]) -> DataFrame:
    """Number maximal runs of equal state (null equals null) inside each key: column ``island`` from 1."""
    line = Window.partitionBy(*keys).orderBy(*order)
    start = F.row_number().over(line) == 1
    for c in state:
        start = start | ~F.lag(c).over(line).eqNullSafe(F.col(c))
    return df.withColumn("_start", start.cast("int")).withColumn("island", F.sum("_start").over(line)).drop("_start")


def sessions(df: DataFrame, keys: list[str], ts: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Number sessions that end with a gap longer than ``gap_seconds``."""
    line = Window.partitionBy(*keys).orderBy(ts, *order)
    pause = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(line)) > gap_seconds * 1_000_000
    return df.withColumn("_start", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("session", F.sum("_start").over(line)).drop("_start")


def streaks(df: DataFrame, keys: list[str], season: str, value: str, gaps_break: bool) -> DataFrame:
    """Length so far of the run of seasons with the same value; a missing season ends it if ``gaps_break``."""
    line = Window.partitionBy(*keys).orderBy(season)
    changed = ~F.lag(value).over(line).eqNullSafe(F.col(value)) | F.lag(season).over(line).isNull()
    if gaps_break:
        changed = changed | (F.lag(season).over(line) != F.col(season) - 1)
    run = df.withColumn("_run", F.sum(changed.cast("int")).over(line))
    return run.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(season))).drop("_run")


def runs_of(df: DataFrame, key: str, season: str, most: int) -> DataFrame:
    """Every run of 1 to ``most`` consecutive seasons: (key, start, size, season), a row for each season in it."""
    line = Window.partitionBy(key).orderBy(season)
    own = df.select(key, season).distinct().withColumn("_base", F.col(season) - F.row_number().over(line))
    after = Window.partitionBy(key, "_base").orderBy(season)
    left = F.count("*").over(after.rowsBetween(0, Window.unboundedFollowing))
    sized = own.withColumn("_left", left).withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("_left")).cast("int"))))
    return sized.select(key, F.col(season).alias("start"), "size", F.explode(F.sequence(F.col(season), F.col(season) + F.col("size") - 1)).alias(season))


def alternate(keys: list[str], order: list[str]) -> Column:
    """A, B, A, ... by order."""
    return F.when((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % 2 == 0, "A").otherwise("B")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; the row limit reaches below the shuffle as a window group limit."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def serpentine(place: Column, folds: int) -> Column:
    """0, 1, ..., folds - 1, folds - 1, ..., 0 over places from 0."""
    at = F.pmod(place, F.lit(2 * folds))
    return F.when(at < folds, at).otherwise(2 * folds - 1 - at)


def arithmetic_fold(key: Column, folds: int) -> Column:
    """A fold from an id by a multiplicative hash that any SQL engine can repeat."""
    return F.pmod(F.pmod(key * 2654435761, F.lit(1 << 32)), F.lit(folds)).cast("int")


def average_rank(keys: list[str], order: Column) -> Column:
    """Ranks from 1, ties share their mean."""
    line = Window.partitionBy(*keys).orderBy(order)
    ties = F.count("*").over(line.rangeBetween(0, 0))
    return F.rank().over(line) + (ties - 1) / 2


def numbered(rows: DataFrame, key: str, name: str, width: int = 1000) -> DataFrame:
    """Add ``name``, the place (from 0) of each unique number ``key`` in sorted order.

    Ranges of ``width`` keys are ordered apart; only their counts, one row a range, meet in one task.
    """
    block = F.floor(F.col(key) / width).alias("_block")
    counts = rows.groupBy(block).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return rows.select("*", block).join(before, "_block").withColumn(name, F.col("_before") + place).drop("_block", "_before")
