"""The whole build as one plan (CMD): prior, ridge around it, shrink, held-out folds, products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.operators import design as D
from stintforge.operators import linear as L
from stintforge.operators import moments as M
from stintforge.operators import sequences as Q
from stintforge.plans.registry import QUERIES, query
from stintforge.plans.relational import r
from stintforge.sources import stores
from stintforge.sources.shipping import ship
from stintforge.sources.tables import Tables

PENALTY = 5000.0
FOLDS = 3


def prior(rows: DataFrame, pad: float = 400.0) -> DataFrame:
    """(season, player, prior, poss): rates padded toward their team's, as deviations from the season's weighted mean."""
    team = Window.partitionBy("season", "team")
    goal = F.sum("pts").over(team) / F.sum("poss").over(team)
    padded = rows.withColumn("padded", S.shrink(F.col("poss"), F.col("pts") / F.col("poss"), pad, goal))
    return padded.select("season", "player", M.centred(padded, ["season"], "padded", "poss").alias("prior"), "poss")


def totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy("season", "team", "player").agg(F.sum("poss").alias("poss"), F.sum("pts").alias("pts"))


def slots(lineups: DataFrame, prior_rows: DataFrame) -> DataFrame:
    """(season, game, player, size, w, y): the response less the mean prior of the players present."""
    long = lineups.select("season", "game", "poss", (F.col("pts") / F.col("poss")).alias("rate"), F.size("lineup").alias("size"), F.explode("lineup").alias("player"))
    known = long.join(prior_rows.select("season", "player", "prior"), ["season", "player"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    mean = F.avg("prior").over(Window.partitionBy("game"))
    return known.select("season", "game", "player", "size", F.col("poss").alias("w"), (F.col("rate") - mean).alias("y"), "rate", mean.alias("expected"))


def expected(lineups: DataFrame, prior_rows: DataFrame) -> DataFrame:
    """(season, game, lineup, w, rate, expected): games with the mean prior of the players present, who count 0 without one.

    The priors, a number a player-season, go to every task; games are not taken apart, joined and put together again.
    """
    spark = lineups.sparkSession
    ship(spark)
    known = prior_rows.select("season", "player", "prior").where("season is not null").orderBy("season", "player").toArrow()
    season, player, prior = (known[c].to_numpy() for c in ("season", "player", "prior"))
    which, first = np.unique(season, return_index=True)
    shared = spark.sparkContext.broadcast({int(s): (player[a:b], prior[a:b]) for s, a, b in zip(which, first, [*first[1:], len(season)], strict=True)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch["lineup"]).to_numpy(zero_copy_only=False).astype(np.int64)
            players, of = batch["lineup"].flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
            seasons = np.repeat(pc.fill_null(batch["season"], -1).to_numpy(zero_copy_only=False), size)
            x = np.zeros(len(players))
            for s in np.unique(seasons):
                names, values = shared.value.get(int(s), (np.zeros(0, np.int64), np.zeros(0)))
                mine = np.flatnonzero(seasons == s)
                at = np.minimum(np.searchsorted(names, players[mine]), max(len(names) - 1, 0))
                if len(names):
                    x[mine] = np.where(names[at] == players[mine], values[at], 0.0)
            mean = np.bincount(of, x, len(size)) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean)], [*batch.schema.names, "expected"])

    games = lineups.select("season", "game", "lineup", F.col("poss").cast("double").alias("w"), (F.col("pts") / F.col("poss")).cast("double").alias("rate"))
    return games.mapInArrow(add, "season int, game long, lineup array<long>, w double, rate double, expected double")


def equations(lineups: DataFrame, prior_rows: DataFrame) -> D.Equations:
    """Season equations of what the priors leave; each player present counts 1 / size, column 0 is the level."""
    rows = slots(lineups, prior_rows)
    own = rows.select("season", "game", "w", "y", (F.col("player") + 1).alias("col"), (1.0 / F.col("size")).alias("v"))
    level = rows.groupBy("season", "game").agg(F.max("w").alias("w"), F.max("y").alias("y")).withColumn("col", F.lit(0).cast("long")).withColumn("v", F.lit(1.0))
    design = own.unionByName(level.select(*own.columns))
    right = design.groupBy("season", F.col("col").alias("i")).agg(F.sum(F.col("w") * F.col("v") * F.col("y")).alias("g"))
    sums = M.gram(design, ["season"], "game", "col", "v", "w").unionByName(right.select("season", "i", F.lit(None).cast("long").alias("j"), "g"))
    entry = lambda p: F.struct((p + 1).alias("c"), (1.0 / F.size("lineup")).alias("v"))
    e = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("c"), F.lit(1.0).alias("v"))), F.transform("lineup", entry))
    games = expected(lineups, prior_rows).select("season", "game", "w", F.array(F.col("rate") - F.col("expected")).alias("y"), e.alias("e"))
    return D.Equations(games, "season", sums)


def ratings(fact: DataFrame, lineups: DataFrame, team_weight: float = 0.9, own_weight: float = 0.8) -> DataFrame:
    """(season, team, player, poss, prior, deviation, rating): ridge deviations around the prior, shrunk in two layers."""
    return rated(stores.kept(totals(fact)), lineups, team_weight, own_weight)


def rated(base: DataFrame, lineups: DataFrame, team_weight: float = 0.9, own_weight: float = 0.8) -> DataFrame:
    """The ratings from stored totals (season, team, player, poss, pts), which several steps read, by given multipliers."""
    rows = parts(base, lineups).drop("sd")
    return shrunk(rows.withColumns({c: F.lit(x) for c, x in zip(MULTIPLIERS, [team_weight] * 2 + [own_weight] * 2, strict=True)}))


#: What a team's mean prior and mean deviation are multiplied by, and what its players' distances from these are.
MULTIPLIERS = ("team_prior", "team_games", "own_prior", "own_games")
#: A season's multipliers come from this many other seasons at most, the nearest ones.
NEAREST = 8


def parts(base: DataFrame, lineups: DataFrame, sd: bool = False) -> DataFrame:
    """(season, team, player, poss, prior, deviation, sd): the prior and what a season's games move a player from it; sd is NaN unless asked for."""
    before = prior(base)
    fit = L.ridge(equations(lineups, before), "season", PENALTY, sd=sd).where("i > 0")
    fit = fit.select("season", (F.col("i") - 1).alias("player"), F.col("beta").alias("deviation"), "sd")
    rows = base.select("season", "team", "player").join(before, ["season", "player"]).join(fit, ["season", "player"], "left")
    return rows.withColumn("deviation", F.coalesce("deviation", F.lit(0.0)))


def layers(rows: DataFrame) -> DataFrame:
    """The rows with their team's weighted mean prior and deviation (mean_p, mean_u) and the own distances from these (own_p, own_u)."""
    team = Window.partitionBy("season", "team")
    mean = lambda c: F.sum(F.col(c) * F.col("poss")).over(team) / F.sum("poss").over(team)
    rows = rows.withColumns({"mean_p": mean("prior"), "mean_u": mean("deviation")})
    apart = lambda c, m: F.when(F.count("*").over(team) > 1, F.col(c) - F.col(m)).otherwise(0.0)
    return rows.withColumns({"own_p": apart("prior", "mean_p"), "own_u": apart("deviation", "mean_u")})


def shrunk(rows: DataFrame) -> DataFrame:
    """The rows with a rating: each layer's parts times their ``MULTIPLIERS`` (columns of the rows), centred by season."""
    layered = layers(rows)
    value = sum((F.col(m) * F.col(c) for m, c in zip(MULTIPLIERS, ("mean_p", "mean_u", "own_p", "own_u"), strict=True)), F.lit(0.0))
    out = layered.withColumn("shrunk", value)
    return out.withColumn("rating", M.centred(out, ["season"], "shrunk", "poss")).drop("shrunk", "mean_p", "mean_u", "own_p", "own_u", *MULTIPLIERS)


def held_sums(rows: DataFrame, lineups: DataFrame, own: DataFrame) -> DataFrame:
    """(season, layer, pp, pu, uu, py, uy): equations of a fold's multipliers on games that its parts (``rows``) never saw.

    Layer 0 fits the games' rates on their players' mean parts with a free level a season.  Layer 1 fits the players' rates
    inside a game (``own``: season, game, player, poss, pts), less their team's means, on their distances from these, with
    a free level a game.  Players without parts count 0.
    """
    found = layers(rows).select("season", "player", "prior", "deviation", "mean_p", "mean_u", "own_p", "own_u")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    slots = lineups.select("season", "game", "poss", (F.col("pts") / F.col("poss")).alias("y"), F.explode("lineup").alias("player")).join(found, ["season", "player"], "left")
    games = slots.groupBy("season", "game").agg(F.max("poss").alias("w"), F.max("y").alias("y"), F.avg(none("prior")).alias("p"), F.avg(none("deviation")).alias("u"))
    lines = own.where("poss > 0").join(found, ["season", "player"], "left").select("season", "game", F.col("poss").alias("w"), (F.col("pts") / F.col("poss") - none("mean_p") - none("mean_u")).alias("y"), none("own_p").alias("p"), none("own_u").alias("u"))

    def sums(df: DataFrame, level: list[str], layer: int) -> DataFrame:
        w, pairs = F.col("w").cast("double"), {"pp": "pp", "pu": "pu", "uu": "uu", "py": "py", "uy": "uy"}
        first = df.groupBy(*level).agg(F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(c) for c in "puy"], *[F.sum(w * F.col(k[0]) * F.col(k[1])).alias(k) for k in pairs])
        inside = first.where("n > 0").select("season", *[(F.col(k) - F.col(k[0]) * F.col(k[1]) / F.col("n")).alias(k) for k in pairs])
        return inside.groupBy("season").agg(*[F.sum(k).alias(k) for k in pairs]).withColumn("layer", F.lit(layer))

    return sums(games, ["season"], 0).unionByName(sums(lines, ["season", "game"], 1))


def multipliers(sums: list[dict], seasons: list[int]) -> dict[int, tuple[float, ...]]:
    """Each season's ``MULTIPLIERS`` from the nearest other seasons' equations; without other seasons nothing is shrunk."""
    out = {}
    for season in seasons:
        used = sorted({x["season"] for x in sums} - {season}, key=lambda s: (abs(s - season), s))[:NEAREST]
        found = []
        for layer in (0, 1):
            pp, pu, uu, py, uy = (sum(x[k] for x in sums if x["layer"] == layer and x["season"] in used) for k in ("pp", "pu", "uu", "py", "uy"))
            found += list(np.linalg.lstsq(np.array([[pp, pu], [pu, uu]], float), np.array([py, uy], float), rcond=1e-12)[0]) if used else [1.0, 1.0]
        out[season] = tuple(float(x) for x in found)
    return out


def built(t: Tables, sd: bool = True) -> DataFrame:
    """(season, team, player, poss, prior, deviation, sd, rating): every step, the multipliers fitted on games that were held back from other seasons' folds."""
    fold = Q.arithmetic_fold(F.col("game"), FOLDS)
    lineups = stores.kept(t.lineups.withColumn("fold", fold))
    own = stores.kept(t.fact.groupBy(fold.alias("fold"), "season", "game", "team", "player").agg(F.sum("poss").alias("poss"), F.sum("pts").alias("pts")))
    sums = []
    for k in range(FOLDS):
        seen = stores.kept(parts(stores.kept(totals(own.where(F.col("fold") != k))), lineups.where(F.col("fold") != k)))
        sums += [x.asDict() for x in held_sums(seen, lineups.where(F.col("fold") == k), own.where(F.col("fold") == k)).where("season is not null").collect()]
    rows = parts(stores.kept(totals(own)), lineups, sd)
    fitted = multipliers(sums, [x.season for x in lineups.select("season").distinct().collect() if x.season is not None])
    table = t.spark.createDataFrame([(s, *x) for s, x in fitted.items()], "season int, " + ", ".join(f"{c} double" for c in MULTIPLIERS))
    rows = rows.join(F.broadcast(table), "season", "left").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in MULTIPLIERS})
    return shrunk(rows)


@query("cmd05_build")
def _(t: Tables) -> DataFrame:
    """Prior, deviations with their spreads, multipliers fitted on held-back games, ratings."""
    out = built(t)
    return out.select("season", "team", "player", r("poss", 2).alias("poss"), r("prior", 3).alias("prior"), r("deviation", 3).alias("deviation"), r("sd", 6).alias("sd"), r("rating", 3).alias("rating"))


@query("cmd05_build_centred", "select season, count(*) as players, 0.0::double as mean from player_season group by 1")
def _(t: Tables) -> DataFrame:
    """Every season's weighted mean rating is zero, and every player has one."""
    out = built(t, sd=False)
    mean = F.sum(F.col("rating") * F.col("poss")) / F.sum("poss")
    return out.groupBy("season").agg(F.count("*").alias("players"), F.abs(F.round(mean, 4)).alias("mean"))


@query("cmd02_prior", """select season, player, round(padded - sum(padded * poss) over w / sum(poss) over w, 4) as prior from (select *, (pts + 400 * (sum(pts) over v / sum(poss) over v)) / (poss + 400) as padded from player_season window v as (partition by season, team)) window w as (partition by season)""")
def _(t: Tables) -> DataFrame:
    return prior(totals(t.fact)).select("season", "player", r("prior").alias("prior"))


@query("cmd06_held_out_folds")
def _(t: Tables) -> DataFrame:
    """Error of held-back games under ratings that never saw them, next to that of the season's level."""
    fold = Q.arithmetic_fold(F.col("game"), FOLDS)
    lineups = stores.kept(t.lineups.withColumn("fold", fold))
    sums = stores.kept(t.fact.groupBy(fold.alias("fold"), "season", "team", "player").agg(F.sum("poss").alias("poss"), F.sum("pts").alias("pts")))
    parts = []
    for k in range(FOLDS):
        kept, held = stores.kept(totals(sums.where(F.col("fold") != k))), lineups.where(F.col("fold") == k)
        found = stores.kept(rated(kept, lineups.where(F.col("fold") != k)).select("season", "player", "rating"))  # else the driver has all folds' solutions at once
        level = kept.groupBy("season").agg((F.sum("pts") / F.sum("poss")).alias("level"))
        rows = held.select("season", "game", "poss", (F.col("pts") / F.col("poss")).alias("y"), F.explode("lineup").alias("player")).join(found, ["season", "player"], "left")
        games = rows.groupBy("season", "game").agg(F.max("poss").alias("w"), F.max("y").alias("y"), F.avg(F.coalesce("rating", F.lit(0.0))).alias("x")).join(F.broadcast(level), "season")
        error = lambda e: F.sqrt(F.sum(F.col("w") * e * e) / F.sum("w"))
        parts.append(games.groupBy("season").agg(r(error(F.col("y") - F.col("level") - F.col("x")), 2).alias("rated"), r(error(F.col("y") - F.col("level")), 2).alias("level_only"), F.count("*").alias("games")).withColumn("fold", F.lit(k)))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("cmd06_no_leak", "select 0::bigint as shared")
def _(t: Tables) -> DataFrame:
    """No game is both fitted on and held back."""
    fold = Q.arithmetic_fold(F.col("game"), FOLDS)
    games = t.lineups.select("game", fold.alias("fold"))
    shared = [games.where(F.col("fold") != k).select("game").intersect(games.where(F.col("fold") == k).select("game")) for k in range(FOLDS)]
    return shared[0].unionAll(shared[1]).unionAll(shared[2]).agg(F.count("*").alias("shared"))


@query("cmd10_products")
def _(t: Tables) -> DataFrame:
    """One JSON document a season, players by rating."""
    out = built(t, sd=False).select("season", r("rating", 2).alias("rating"), "player", "team")
    rows = F.sort_array(F.collect_list(F.struct("rating", "player", "team")), asc=False)
    return out.groupBy("season").agg(F.to_json(rows).alias("document"))
