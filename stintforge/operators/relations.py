"""Join patterns: incidence, leave-out by subtraction, swap pairs, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_own(rows: DataFrame, unit: list[str], group: list[str], measures: list[str]) -> DataFrame:
    """For each (unit, group): the group's totals less the unit's own; subtraction instead of an anti-join."""
    own = rows.groupBy(*group, *unit).agg(*[F.sum(m).alias(m) for m in measures])
    over = Window.partitionBy(*group)
    return own.select(*group, *unit, *measures, *[(F.sum(m).over(over) - F.col(m)).alias(f"other_{m}") for m in measures])


def swap_pairs(lineups: DataFrame, group: list[str], lineup: str = "lineup") -> DataFrame:
    """Pairs of different lineups of a group that share all members but one: (group, a, b, core).

    Each lineup emits its cores (itself less one member).  Cores met once are dropped by a count before any pairing,
    and a pair is formed from its one shared core, so nothing is compared that does not share it.
    """
    own = lineups.select(*group, F.col(lineup).alias("five")).distinct()
    cores = own.select(*group, "five", F.explode("five").alias("_out")).select(*group, "five", F.array_remove("five", F.col("_out")).alias("core"))
    met = cores.withColumn("_n", F.count("*").over(Window.partitionBy(*group, "core"))).where("_n > 1").drop("_n")
    left, right = met.withColumnRenamed("five", "a"), met.withColumnRenamed("five", "b")
    return left.join(right, [*group, "core"]).where(F.col("a") < F.col("b")).select(*group, "a", "b", "core")


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Full outer join by key; measures missing on a side become ``fill``."""
    joined = left.join(right, keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in joined.columns if c not in keys])


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measure: str, tolerance: float) -> DataFrame:
    """One row a key with its verdict: only_left, only_right, differs, agrees."""
    a, b = left.select(*keys, F.col(measure).alias("_a"), F.lit(1).alias("_in_a")), right.select(*keys, F.col(measure).alias("_b"), F.lit(1).alias("_in_b"))
    verdict = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").when(F.abs(F.col("_a") - F.col("_b")) > tolerance, "differs").otherwise("agrees")
    return a.join(b, keys, "full").select(*keys, verdict.alias("verdict"))


def in_all(systems: list[DataFrame], key: str, value: str, weights: list[float]) -> DataFrame:
    """Weighted blend over the keys that every system knows: union and count instead of a chain of joins."""
    parts = [s.select(key, (F.col(value) * w).alias("_v"), F.lit(i).alias("_s")) for i, (s, w) in enumerate(zip(systems, weights, strict=True))]
    both = reduce(DataFrame.unionAll, parts)
    return both.groupBy(key).agg(F.sum("_v").alias("blend"), F.countDistinct("_s").alias("_n")).where(F.col("_n") == len(systems)).drop("_n")


def best_name(df: DataFrame, key: str, weight: str, keep: list[str]) -> DataFrame:
    """One row a name key: the one with the most weight, the least of ``keep`` on ties."""
    return df.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(F.col(weight), *[F.negative(F.col(k)) for k in keep if df.schema[k].dataType.simpleString() in ("bigint", "int")])).alias("_b")).select(key, "_b.*")


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row a common column: keys only left, keys only right, unequal values, largest absolute difference.

    Null equals null and NaN equals NaN; every column is compared in one join, and counted in one pass.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys and c not in ignore]
    a = left.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"_a_{c}") for c in shared])
    b = right.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"_b_{c}") for c in shared])
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    entry = []
    for c in shared:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        gap = F.abs(x - y).cast("double") if left.schema[c].dataType.typeName() in ("integer", "long", "float", "double") else F.lit(None).cast("double")
        entry.append(F.struct(F.lit(c).alias("name"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(both & ~x.eqNullSafe(y)).alias("differ"), F.max(F.when(both, gap)).alias("most")))
    return a.join(b, keys, "full").agg(F.array(*entry).alias("e")).select(F.inline("e"))
