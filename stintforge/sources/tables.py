"""Typed access to the tables, and the fact relation most queries start from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The Parquet tables of one folder; ``t.orders`` and so on are read lazily."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name in Tables.NAMES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def lines(self) -> DataFrame:
        """One row a line, without a join: game, player (supplier), part, line, poss, pts, flag, status, shipped."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("poss"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pts"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").cast("date").alias("shipped"),
        )

    @cached_property
    def played(self) -> DataFrame:
        """The lines with their game's season, phase, day, customer and priority."""
        orders = self.orders.select(
            F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), F.when(F.col("o_orderstatus") == "P", "PO").otherwise("RS").alias("phase"),
            F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"),
        )
        return self.lines.join(orders, "game")

    @cached_property
    def fact(self) -> DataFrame:
        """The played lines with their player's team.

        An inner join cannot be dropped by the optimiser: queries that need no team start from ``played``, those that
        need nothing of the game from ``lines``.  Keys of lines are foreign keys, so all three have the same rows.
        """
        teams = self.supplier.select(F.col("s_suppkey").alias("player"), F.col("s_nationkey").alias("team"))
        return self.played.join(teams, "player")

    @cached_property
    def player_season(self) -> DataFrame:
        """Possessions, points and games of each (season, team, player)."""
        return self.fact.groupBy("season", "team", "player").agg(F.sum("poss").alias("poss"), F.sum("pts").alias("pts"), F.countDistinct("game").alias("games"))

    @cached_property
    def lineups(self) -> DataFrame:
        """One row a game with at least two players: the sorted players, possessions, points."""
        whole = self.played.groupBy("season", "game").agg(F.array_sort(F.collect_set("player")).alias("lineup"), F.sum("poss").alias("poss"), F.sum("pts").alias("pts"))
        return whole.where(F.size("lineup") >= 2)


#: The same relations in SQL, for the oracles.
FACT_SQL = """fact as (
  select l_orderkey as game, year(o_orderdate)::int as season, case when o_orderstatus = 'P' then 'PO' else 'RS' end as phase, o_orderdate::date as day, o_custkey as customer,
    o_orderpriority as priority, l_suppkey as player, l_partkey as part, l_linenumber as line, l_quantity as poss, l_extendedprice * (1 - l_discount) as pts,
    l_returnflag as flag, l_linestatus as status, l_shipdate::date as shipped, s_nationkey as team
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
), player_season as (
  select season, team, player, sum(poss) as poss, sum(pts) as pts, count(distinct game) as games from fact group by all
), lineups as (
  select season, game, list_sort(list(distinct player)) as lineup, sum(poss) as poss, sum(pts) as pts from fact group by all having count(distinct player) >= 2
)"""
