"""A synthetic league with known truth, from arithmetic hashes, so that any SQL engine can make the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """A number in [0, 1) from an id."""
    return F.pmod(F.pmod(key, F.lit(1 << 20)) * 2654435761 + 12345, F.lit(1 << 32)) / float(1 << 32)


def league(spark: SparkSession, games: int, players: int, five: int = 5) -> DataFrame:
    """(game, side, player, truth, y): two sides a game, five slots a side; y is the side's summed truth plus noise."""
    slots = spark.range(games).select(F.col("id").alias("game"), F.explode(F.sequence(F.lit(0), F.lit(2 * five - 1))).alias("slot"))
    player = F.pmod(F.floor(uniform(F.col("game") * 131 + F.col("slot") * 7) * players) + F.col("slot") * 17, F.lit(players))
    seated = slots.select("game", F.floor(F.col("slot") / five).alias("side"), player.cast("long").alias("player")).distinct()
    known = seated.withColumn("truth", uniform(F.col("player") + 777) - 0.5)
    total = known.groupBy("game", "side").agg((F.sum("truth") + (uniform(F.max("game") * 2 + F.max("side") + 99) - 0.5) / 10).alias("y"))
    return known.join(total, ["game", "side"])
