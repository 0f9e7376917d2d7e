"""Weighted moments as sums, so that every one is partially aggregated before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(x: str, weight: str) -> Column:
    """Mean of the rows where x is known; the plain mean where they weigh nothing."""
    known = F.col(x).isNotNull()
    total = F.sum(F.when(known, F.col(weight)))
    return F.coalesce(F.sum(F.col(x) * F.col(weight)) / F.nullif(total, F.lit(0.0)), F.avg(x))


def rates(df: DataFrame, keys: list[str], counts: list[str], per: str, scale: float = 100.0) -> DataFrame:
    """scale times sum(count) over sum(per) for every count."""
    total = F.nullif(F.sum(per), F.lit(0.0))
    return df.groupBy(*keys).agg(F.sum(per).alias(per), *[(scale * F.sum(c) / total).alias(f"{c}_rate") for c in counts])


def proportion_pad(df: DataFrame, keys: list[str], made: str, tries: str, most: float = 1e6) -> DataFrame:
    """Pad of a proportion by the method of moments: p (1 - p) over the variance between players beyond noise."""
    p = F.col(made) / F.nullif(F.col(tries), F.lit(0.0))
    rows = df.where(F.col(tries) > 0).withColumn("_p", p)
    sums = rows.groupBy(*keys).agg(
        F.sum(tries).alias("w"), F.sum(F.col(tries) * F.col("_p")).alias("wp"), F.sum(F.col(tries) * F.col("_p") * F.col("_p")).alias("wpp"), F.sum(F.col("_p") * (1 - F.col("_p"))).alias("noise"), F.count("*").alias("players")
    )
    mean = F.col("wp") / F.col("w")
    between = F.col("wpp") / F.col("w") - mean * mean - F.col("noise") / F.col("w")
    return sums.select(*keys, "players", mean.alias("mean"), F.when(between > 0, F.least(mean * (1 - mean) / between, F.lit(most))).otherwise(most).alias("pad"))


def split_half(df: DataFrame, keys: list[str], unit: str, half: Column, x: str, weight: str) -> DataFrame:
    """Weighted covariance and correlation of a unit's rate in one half of its rows with that in the other."""
    sides = df.withColumn("_half", half).groupBy(*keys, unit).agg(
        *[F.sum(F.when(F.col("_half") == h, F.col(c))).alias(f"{c}{h}") for h in (0, 1) for c in (x, weight)]
    )
    both = sides.where((F.col(f"{weight}0") > 0) & (F.col(f"{weight}1") > 0))
    both = both.select(*keys, (F.col(f"{x}0") / F.col(f"{weight}0")).alias("a"), (F.col(f"{x}1") / F.col(f"{weight}1")).alias("b"))
    return both.groupBy(*keys).agg(F.count("*").alias("units"), F.covar_pop("a", "b").alias("covariance"), F.corr("a", "b").alias("correlation"))


def centred(df: DataFrame, keys: list[str], x: str, weight: str) -> Column:
    """x less its weighted mean in its group."""
    over = Window.partitionBy(*keys)
    return F.col(x) - F.sum(F.col(x) * F.col(weight)).over(over) / F.sum(weight).over(over)


def gram(rows: DataFrame, keys: list[str], row_id: str, column: str, value: str, weight: str) -> DataFrame:
    """Weighted normal matrix of a long-form design: (keys, i, j, g), i <= j.

    Entries of one row meet through an array of its few entries, not a self-join, and pairs are summed before the
    shuffle.  A row has a bounded number of entries (ten players and some context), so its pairs are bounded too.
    """
    entry = F.struct(F.col(column).alias("c"), F.col(value).alias("v"))
    return gram_packed(rows.groupBy(*keys, row_id).agg(F.sort_array(F.collect_list(entry)).alias("e"), F.max(weight).alias("w")), keys)


def gram_packed(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The same for rows that hold their entries ``e``, an array of (c, v) in the order of c, and their weight ``w``.

    Nothing is shuffled before the partial sums.
    """
    return gram_terms(packed, keys).groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))


def gram_terms(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, g): what every row adds to the matrix, not summed yet."""
    left = packed.select(*keys, "w", "e", F.posexplode("e").alias("at", "a"))
    pairs = left.select(*keys, "w", "a", F.explode(F.slice("e", F.col("at") + 1, F.size("e") - F.col("at"))).alias("b"))
    return pairs.select(*keys, F.col("a.c").alias("i"), F.col("b.c").alias("j"), (F.col("w") * F.col("a.v") * F.col("b.v")).alias("g"))
