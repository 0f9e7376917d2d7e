"""Assembled systems, multipliers, corrections and their checks (LAM, CHK, CMD)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.operators import design as D
from stintforge.operators import linear as L
from stintforge.operators import moments as M
from stintforge.operators import relations as R
from stintforge.operators import sequences as Q
from stintforge.plans import build
from stintforge.plans.features import nearest_seasons
from stintforge.plans.linear import _DESIGN, _EQUATIONS, design, design_rows, entries, equations
from stintforge.plans.registry import query
from stintforge.plans.relational import r
from stintforge.sources import stores, synthetic
from stintforge.sources.tables import Tables

PENALTY = 5000.0


def settled(fit: DataFrame, key: str) -> DataFrame:
    """Columns a key, and the largest share of the right-hand side that a solution leaves."""
    return fit.groupBy(key).agg(F.count("*").alias("columns"), r(F.max(F.abs("residual")), 6).alias("residual"))


def right_hand(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, g) with a null j."""
    return rows.groupBy(*keys, F.col("col").alias("i")).agg(F.sum(F.col("w") * F.col("v") * F.col("y")).alias("g")).withColumn("j", F.lit(None).cast("long"))


# ---- designs and their sums


@query("lam03_blocks", "select season, count(*) filter (where col > 0) as players, count(*) filter (where col = 0) as context from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    return design(t).groupBy("season").agg(F.count_if(F.col("col") > 0).alias("players"), F.count_if(F.col("col") == 0).alias("context"))


@query("lam05_add_season", "select season, count(*) as n, round(sum(g), 0) as total from equations group by 1", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    """A season's sums join the stored ones as one more partition."""
    sums = equations(t)
    store = stores.PartitionStore(t.spark, "season").upsert(sums.where("season <> 1997"))
    return store.upsert(sums.where("season = 1997")).read().groupBy("season").agg(F.count("*").alias("n"), r(F.sum("g"), 0).alias("total"))


def assembled(sums: DataFrame) -> DataFrame:
    """Seasons' sums with players in common and a level column of their own for each season (minus the season)."""
    own = lambda c: F.when(F.col(c) == 0, -F.col("season").cast("long")).otherwise(F.col(c))
    named = sums.select(own("i").alias("a"), own("j").alias("b"), "g")
    return named.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("g").alias("g"))


@query("lam06_assembled", "select case when i = 0 then -season else i end::bigint as i, case when j = 0 then -season else j end::bigint as j, round(sum(g), 2) as g from equations where j is not null group by 1, 2", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    return assembled(equations(t).where("j is not null")).select("i", "j", r("g", 2).alias("g"))


@query("lam07_penalties", "select distinct col, case when col = 0 then 0.0 when col % 2 = 0 then 40000.0 else 30000.0 end::double as penalty from design", _DESIGN)
def _(t: Tables) -> DataFrame:
    penalty = F.when(F.col("col") == 0, 0.0).when(F.col("col") % 2 == 0, 40000.0).otherwise(30000.0)
    return design(t).select("col", penalty.alias("penalty")).distinct()


@query("lam08_flag_columns", "select season, team, row_number() over (order by season, team) - 1 as attacking, row_number() over (order by season, team) - 1 + count(*) over () as defending from (select distinct season, team from fact)")
def _(t: Tables) -> DataFrame:
    """Where each team-season's flags sit; the dimension has a row a team-season."""
    teams = t.fact.select("season", "team").distinct()
    place = (F.row_number().over(Window.orderBy("season", "team")) - 1).cast("long")
    return teams.select("season", "team", place.alias("attacking"), (place + F.count("*").over(Window.partitionBy(F.lit(0)))).alias("defending"))


@query("lam09_kept_set_solved", "select 'kept' as fit, (select count(distinct case when col = 0 then -season else col end) from design where season <> 1997) as columns, 0.0::double as residual", _DESIGN)
def _(t: Tables) -> DataFrame:
    frame = assembled(equations(t).where("season <> 1997")).withColumn("fit", F.lit("kept"))
    level = lambda x: F.struct(F.when(x["c"] == 0, -F.col("season").cast("long")).otherwise(x["c"]).alias("c"), x["v"].alias("v"))
    sums = D.Equations(design_rows(t).where("season <> 1997").select(F.lit("kept").alias("fit"), "w", "y", F.transform("e", level).alias("e")), "fit", frame)
    return settled(L.ridge(sums, "fit", PENALTY, tuple(range(-2100, -1900))), "fit")


@query("lam14_many_season_sets", "select s as left_out, (select count(distinct col) from design d where d.season not in (1990 + s, 1991 + s)) as columns, 0.0::double as residual from (select unnest([4, 5, 6]) as s)", _DESIGN)
def _(t: Tables) -> DataFrame:
    """Each set's labels come from the seasons outside it: a fit a set, all in one pass over the summed equations."""
    outside = F.array(*[F.when(~F.col("season").isin(1990 + s, 1991 + s), F.lit(s)) for s in (4, 5, 6)])
    chosen = F.explode(F.array_compact(outside)).alias("left_out")
    frame = equations(t).select(chosen, "i", "j", "g").groupBy("left_out", "i", "j").agg(F.sum("g").alias("g"))
    sums = D.Equations(design_rows(t).select(chosen, "w", "y", "e"), "left_out", frame)
    return settled(L.ridge(sums, "left_out", PENALTY), "left_out")


@query("lam15_nearest_labels", """select n.season, count(distinct d.col) as columns, 0.0::double as residual from (select a.season, b.season as other, row_number() over (partition by a.season order by abs(a.season - b.season), b.season) as place from (select distinct season from fact) a, (select distinct season from fact) b where a.season <> b.season) n
  join (select distinct season, col from design) d on d.season = n.other where n.place <= 2 group by 1""", _DESIGN)
def _(t: Tables) -> DataFrame:
    """Labels from the two nearest other seasons."""
    near = F.broadcast(nearest_seasons(t.played.select("season").distinct(), 2))
    of_other = lambda df: df.withColumnRenamed("season", "other").join(near, "other")
    sums = D.Equations(of_other(design_rows(t)), "season", of_other(equations(t)).groupBy("season", "i", "j").agg(F.sum("g").alias("g")))
    return settled(L.ridge(sums, "season", PENALTY), "season")


def wide_rows(t: Tables) -> DataFrame:
    """(game, col, v): players as ones, two context columns, a prior column; a fixed number of entries beside the players."""
    extra = [F.struct(F.lit(-1).cast("long").alias("col"), F.lit(1.0).alias("v")), F.struct(F.lit(-2).cast("long").alias("col"), F.col("poss").cast("double").alias("v")), F.struct(F.lit(-3).cast("long").alias("col"), F.size("lineup").cast("double").alias("v"))]
    players = F.transform("lineup", lambda p: F.struct(p.cast("long").alias("col"), F.lit(1.0).alias("v")))
    return t.lineups.select("game", F.inline(F.concat(players, F.array(*extra))))


@query("lam16_design_rows", "select game, unnest(list_concat(lineup, [-1, -2, -3]))::bigint as col, unnest(list_concat(list_transform(lineup, lambda p: 1.0::double), [1.0::double, poss::double, len(lineup)::double])) as v from lineups")
def _(t: Tables) -> DataFrame:
    """The entries of every row: its players, two context columns and a prior column."""
    return wide_rows(t)


@query("lam17_player_rows", "select game, unnest(lineup)::bigint as col, 1.0::double as v from lineups")
def _(t: Tables) -> DataFrame:
    """The players' part: as many ones a row as it has players."""
    return wide_rows(t).where("col >= 0")


@query("lam59_team_columns", "select season, team, count(distinct game) as games, round(sum(poss), 2) as poss from fact group by all")
def _(t: Tables) -> DataFrame:
    """A column a team-season: one entry a game in which it plays."""
    entry = t.fact.groupBy("season", "game", "team").agg(F.sum("poss").alias("w"))
    return entry.groupBy("season", "team").agg(F.count("*").alias("games"), r(F.sum("w"), 2).alias("poss"))


@query("lam57_extended_gram", """select i, j, round(sum(w * a * b), 2) as g from (select x.col as i, y.col as j, x.w, x.v as a, y.v as b from wide x join wide y on x.game = y.game and x.col <= y.col) group by all""",
    """rows as (select game, poss as w, lineup, len(lineup) / 10.0 as scale from lineups), wide as (select game, w, unnest(lineup) as col, 1.0::double as v from rows union all select game, w, 1000000, scale from rows
  union all select f.game, any_value(l.poss), 2000000 + f.team, 1.0 from fact f join lineups l on f.game = l.game group by f.game, f.team)""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """The normal matrix of players, a lineup scale and team columns, in one long form."""
    rows = t.lineups.select("game", F.col("poss").alias("w"), "lineup", (F.size("lineup") / 10.0).alias("scale"))
    players = rows.select("game", "w", F.explode("lineup").alias("col"), F.lit(1.0).alias("v"))
    scale = rows.select("game", "w", F.lit(1000000).cast("long").alias("col"), F.col("scale").alias("v"))
    teams = t.fact.select("game", "team").distinct().join(rows.select("game", "w"), "game").select("game", "w", (F.col("team") + 2000000).cast("long").alias("col"), F.lit(1.0).alias("v"))
    return M.gram(players.unionAll(scale).unionAll(teams), [], "game", "col", "v", "w").select("i", "j", r("g", 2).alias("g"))


# ---- ridges


def prior_design(t: Tables) -> DataFrame:
    """The plain design with one more column (-1): the mean prior of the players present."""
    slots = build.slots(t.lineups, build.prior(build.totals(t.fact)))
    scale = slots.groupBy("season", "game").agg(F.max("rate").alias("y"), F.max("w").alias("w"), F.max("expected").alias("v")).withColumn("col", F.lit(-1).cast("long"))
    return design(t).unionByName(scale)


def prior_games(t: Tables) -> DataFrame:
    """(season, game, w, rate, expected, e): the plain design a row a game, with the mean prior of the players present."""
    return build.expected(t.lineups, build.prior(build.totals(t.fact))).select("season", "game", "w", "rate", "expected", entries().alias("e"))


@query("lam19_prior_columns", "select season, count(distinct col) + 1 as columns, 0.0::double as residual from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    """Players around a free multiple of their lineup's prior."""
    rows = prior_design(t)
    frame = M.gram(rows, ["season"], "game", "col", "v", "w").unionByName(right_hand(rows, ["season"]))
    prior = F.array(F.struct(F.lit(-1).cast("long").alias("c"), F.col("expected").alias("v")))
    sums = D.Equations(prior_games(t).select("season", "w", F.array("rate").alias("y"), F.concat(prior, "e").alias("e")), "season", frame)
    return settled(L.ridge(sums, "season", PENALTY, (0, -1)), "season")


@query("lam19_prior_held", "select season, count(distinct col) as columns, 0.0::double as residual from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    """The prior's scale held at one: an offset of the response."""
    slots = build.slots(t.lineups, build.prior(build.totals(t.fact)))
    offset = slots.groupBy("game").agg(F.max("expected").alias("offset"))
    rows = design(t).join(offset, "game").withColumn("y", F.col("y") - F.col("offset"))
    frame = M.gram(rows, ["season"], "game", "col", "v", "w").unionByName(right_hand(rows, ["season"]))
    sums = D.Equations(prior_games(t).select("season", "w", F.array(F.col("rate") - F.col("expected")).alias("y"), "e"), "season", frame)
    return settled(L.ridge(sums, "season", PENALTY), "season")


def two_targets(t: Tables) -> D.Equations:
    """The seasons' matrices with two right-hand sides, points and players a possession."""
    rows = design(t)
    size = t.lineups.select("game", (F.size("lineup") / F.col("poss")).alias("z"))
    second = rows.join(size, "game").withColumn("y", F.col("z"))
    none = F.lit(None).cast("string")
    matrix = M.gram(rows, ["season"], "game", "col", "v", "w").withColumn("target", none)
    frame = matrix.unionByName(right_hand(rows, ["season"]).withColumn("target", F.lit("points"))).unionByName(right_hand(second, ["season"]).withColumn("target", F.lit("size")))
    return D.Equations(design_rows(t, F.col("pts") / F.col("poss"), F.size("lineup") / F.col("poss")), "season", frame, ("points", "size"))


@query("lam41_two_targets")
def _(t: Tables) -> DataFrame:
    return L.ridge_many(two_targets(t), "season", PENALTY).where("i > 0").select("season", "target", (F.col("i") - 1).alias("player"), r("beta", 3).alias("beta"))


@query("lam21_season_table", "select season, target, count(*) as players, 0.0::double as mean from (select distinct season, unnest(lineup) as player from lineups), (select unnest(['points', 'size']) as target) group by all")
def _(t: Tables) -> DataFrame:
    """Both targets' ratings, centred by possessions in each season."""
    fit = L.ridge_many(two_targets(t), "season", PENALTY).where("i > 0").select("season", "target", (F.col("i") - 1).alias("player"), "beta")
    rows = fit.join(t.player_season.select("season", "player", "poss"), ["season", "player"])
    centred = rows.withColumn("x", M.centred(rows, ["season", "target"], "beta", "poss"))
    return centred.groupBy("season", "target").agg(F.count("*").alias("players"), F.abs(r(F.sum(F.col("x") * F.col("poss")) / F.sum("poss"))).alias("mean"))


@query("lam22_blended_refit", "select season, round(sum(h * w) / sum(w), 4) as offset_mean, round(0.6 + 0.4 * sum(w * x * y) / sum(w * x * x), 6) as scale from (select season, poss as w, 1.0 * x as h, x, y from (select season, poss, sum(pts) over (partition by season, team) / sum(poss) over (partition by season, team) / 1000 as x, pts / poss / 1000 as y from player_season)) group by 1")
def _(t: Tables) -> DataFrame:
    """The scale is partly held (one, at weight 0.6) and partly fitted; the mean offset is of the held part."""
    team = Window.partitionBy("season", "team")
    rows = t.player_season.select("season", F.col("poss").alias("w"), (F.sum("pts").over(team) / F.sum("poss").over(team) / 1000).alias("x"), (F.col("pts") / F.col("poss") / 1000).alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    return rows.groupBy("season").agg(r(F.sum(x * w) / F.sum(w)).alias("offset_mean"), r(0.6 + 0.4 * F.sum(w * x * y) / F.sum(w * x * x), 6).alias("scale"))


@query("lam56_single_season", "select season, count(distinct col) as columns, 0.0::double as residual from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    return settled(L.ridge(equations(t), "season", 40000.0), "season")


@query("lam65_pace_ridge", "select season, count(distinct col) as columns, 0.0::double as residual from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    rows = design(t).withColumn("y", F.col("w") / 10)
    frame = M.gram(rows, ["season"], "game", "col", "v", "w").unionByName(right_hand(rows, ["season"]))
    return settled(L.ridge(D.Equations(design_rows(t, F.col("poss") / 10), "season", frame), "season", 30000.0), "season")


@query("lam77_split_pieces", "select season, count(distinct col) as columns, 0.0::double as leftover from design where col > 0 group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    """A coefficient as the sum of what each part of the response gives it."""
    rows = design(t)
    early = F.col("game") % 2 == 0
    parts = {"whole": rows, "even": rows.withColumn("y", F.when(early, F.col("y")).otherwise(0.0)), "odd": rows.withColumn("y", F.when(early, 0.0).otherwise(F.col("y")))}
    sums = M.gram(rows, ["season"], "game", "col", "v", "w").withColumn("target", F.lit(None).cast("string"))
    for name, part in parts.items():
        sums = sums.unionByName(right_hand(part, ["season"]).withColumn("target", F.lit(name)))
    y = F.col("pts") / F.col("poss")
    sums = D.Equations(design_rows(t, y, F.when(early, y).otherwise(0.0), F.when(early, 0.0).otherwise(y)), "season", sums, tuple(parts))
    sign = F.when(F.col("target") == "whole", 1).otherwise(-1)
    left = L.ridge_many(sums, "season", PENALTY).where("i > 0").groupBy("season", "i").agg(F.abs(F.sum(sign * F.col("beta"))).alias("left"))
    return left.groupBy("season").agg(F.count("*").alias("columns"), r(F.max("left"), 4).alias("leftover"))


# ---- multipliers and lines


_PAIRS_OF = "xy as (select season, (player % 3)::int as fold, team, player, poss as w, pts / poss / 1000 as y, games / 10.0 as x, poss / 1000.0 as z from player_season)"


def pairs_of(t: Tables) -> DataFrame:
    return t.player_season.select("season", (F.col("player") % 3).cast("int").alias("fold"), "team", "player", F.col("poss").alias("w"), (F.col("pts") / F.col("poss") / 1000).alias("y"), (F.col("games") / 10.0).alias("x"), (F.col("poss") / 1000.0).alias("z"))


def within(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns less their weighted means in each group: what a regression with a level a group sees."""
    return rows.select(*[c for c in rows.columns if c not in names], *[M.centred(rows, keys, c, "w").alias(c) for c in names])


def slope(weight: Column, x: Column, y: Column) -> Column:
    return F.sum(weight * x * y) / F.nullif(F.sum(weight * x * x), F.lit(0.0))


@query("lam23_multiplier", "select season, round(sum(w * x * y) / nullif(sum(w * x * x), 0), 6) as multiplier from (select season, w, x - sum(w * x) over g / sum(w) over g as x, y - sum(w * y) over g / sum(w) over g as y from xy window g as (partition by season, fold)) group by 1", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """A slope with a level for every fold: fold means out first, then one sum."""
    return within(pairs_of(t), ["season", "fold"], ["x", "y"]).groupBy("season").agg(r(slope(F.col("w"), F.col("x"), F.col("y")), 6).alias("multiplier"))


_NEAR = "near as (select * from (select a.season, b.season as other, row_number() over (partition by a.season order by abs(a.season - b.season), b.season) as place from (select distinct season from fact) a, (select distinct season from fact) b where a.season <> b.season) where place <= 3)"


@query("lam24_fit_by_season_set", f"select n.season, count(distinct n.other) as seasons, round(sum(w * x * y) / sum(w * x * x), 6) as multiplier from near n join xy on xy.season = n.other group by 1", f"{_PAIRS_OF}, {_NEAR}")
def _(t: Tables) -> DataFrame:
    """One fit for each distinct set of nearest seasons, shared by the seasons that have that set."""
    near = nearest_seasons(t.fact.select("season").distinct(), 3).groupBy("season").agg(F.array_sort(F.collect_list("other")).alias("used"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = pairs_of(t).groupBy(F.col("season").alias("other")).agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"))
    fits = near.select("used").distinct().withColumn("other", F.explode("used")).join(sums, "other").groupBy("used").agg(r(F.sum("xy") / F.sum("xx"), 6).alias("multiplier"))
    return near.join(fits, "used").select("season", F.size("used").cast("long").alias("seasons"), "multiplier")


@query("lam25_summed_equations", "select season, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) as a, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 6) as b from (select n.season, sum(w * x * x) as xx, sum(w * x * z) as xz, sum(w * z * z) as zz, sum(w * x * y) as xy, sum(w * z * y) as zy from near n join xy on xy.season = n.other group by 1)", f"{_PAIRS_OF}, {_NEAR}")
def _(t: Tables) -> DataFrame:
    """Two multipliers from season sums: the two-by-two system solved as an expression."""
    near = nearest_seasons(t.fact.select("season").distinct(), 3)
    product = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b)).alias(a + b)
    names = [("x", "x"), ("x", "z"), ("z", "z"), ("x", "y"), ("z", "y")]
    sums = pairs_of(t).groupBy(F.col("season").alias("other")).agg(*[product(*p) for p in names])
    total = sums.join(F.broadcast(near), "other").groupBy("season").agg(*[F.sum(a + b).alias(a + b) for a, b in names])
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    return total.select("season", r((F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det, 6).alias("a"), r((F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det, 6).alias("b"))


@query("lam27_multiplier_at_share", "select p_partkey, round(case when s <= 0.4 then 1.6 when s <= 0.75 then 1.6 + (s - 0.4) / 0.35 * (1.4 - 1.6) else 1.4 + (s - 0.75) / 0.15 * (1.3 - 1.4) end, 6) as multiplier from (select p_partkey, p_size / 50.0 as s from part)")
def _(t: Tables) -> DataFrame:
    """A line through fitted shares: flat below the smallest, its last piece extended beyond the largest."""
    knots = [(0.4, 1.6), (0.75, 1.4), (0.9, 1.3)]
    (a, fa), (b, fb) = knots[-2:]
    share = F.col("p_size") / 50.0
    beyond = F.lit(fb) + (share - b) * ((fb - fa) / (b - a))
    return t.part.select("p_partkey", r(F.when(share > b, beyond).otherwise(S.interpolate(share, knots)), 6).alias("multiplier"))


@query("lam29_shrunk_fold", "select fold, season, player, round(v - sum(v * w) over g / sum(w) over g, 6) as rating from (select *, 0.8 * m + 0.5 * (y - m) as v from (select *, sum(w * y) over q / sum(w) over q as m from xy window q as (partition by fold, season, team))) window g as (partition by fold, season)", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """The two-layer shrink inside every fold, centred over the fold's own rows."""
    rows = pairs_of(t)
    team = Window.partitionBy("fold", "season", "team")
    mean = F.sum(F.col("w") * F.col("y")).over(team) / F.sum("w").over(team)
    shrunk = rows.withColumn("v", 0.8 * mean + 0.5 * (F.col("y") - mean))
    return shrunk.select("fold", "season", "player", r(M.centred(shrunk, ["fold", "season"], "v", "w"), 6).alias("rating"))


#: Named sets of line inputs.
#: Inputs of a line by name, as both engines read them, and the ten named sets of them.
INPUTS = {"x": "x", "z": "z", "w": "w / 1000", "xx": "x * x", "zz": "z * z", "xz": "x * z", "load": "z / (x + 1)", "rare": "1 / (x + 1)", "first": "case when x <= 1 then 1.0 else 0.0 end", "deep": "case when z > 2 then z - 2 else 0.0 end"}
INPUT_SETS = {
    "box": ["x"], "box_and_load": ["x", "z"], "all": list(INPUTS), "squares": ["x", "xx"], "load_squares": ["z", "zz"], "products": ["x", "z", "xz"], "exposure": ["w", "load"], "newcomers": ["x", "rare", "first"],
    "heavy": ["z", "deep"], "plain": ["x", "z", "w"],
}


@query("lam34_line_inputs", " union all ".join(f"select '{kind}' as kind, '{c}' as name, season, team, player, round({INPUTS[c]}, 6)::double as v from xy" for kind, names in INPUT_SETS.items() for c in names), _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """Each set's inputs in long form, from one pass over the rows."""
    entry = [F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("name"), r(F.expr(INPUTS[c]), 6).cast("double").alias("v")) for kind, names in INPUT_SETS.items() for c in names]
    return pairs_of(t).select("season", "team", "player", F.inline(F.array(*entry)))


@query("lam36_season_lines", "select s.season, round(sum(k * xy) / (sum(k * xx) + 10), 6) as slope from (select distinct season from xy) s join (select season as other, sum(w * x * y) as xy, sum(w * x * x) as xx from xy group by 1) o on o.other <> s.season, lateral (select power(0.5, abs(o.other - s.season) / 3.0) as k) group by 1", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """Each season's line from the other seasons, nearer ones weighing more, with a ridge."""
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = pairs_of(t).groupBy(F.col("season").alias("other")).agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"))
    around = sums.select("xy", "xx", "other", F.explode(F.sequence(F.col("other") - 40, F.col("other") + 40)).alias("season")).where("season <> other")
    k = S.half_life(F.col("other") - F.col("season"), 3.0)
    return around.join(t.fact.select("season").distinct(), "season", "left_semi").groupBy("season").agg(r(F.sum(k * F.col("xy")) / (F.sum(k * F.col("xx")) + 10), 6).alias("slope"))


_STATUS = "split as (select season, case status when 'F' then 1 else 2 end as team, player, sum(poss) as poss from fact group by all)"


@query("lam42_team_free", "select season, 0.0::double as most, count(distinct player) as players from split group by 1", _STATUS)
def _(t: Tables) -> DataFrame:
    """After the move every team's weighted total is zero, though players have two teams."""
    split = t.fact.groupBy("season", F.when(F.col("status") == "F", 1).otherwise(2).alias("team"), "player").agg(F.sum("poss").alias("poss"), F.sum("pts").alias("pts"))
    rate = t.player_season.select("season", "player", (F.col("pts") / F.col("poss") / 1000).alias("x"))
    rows = split.join(rate, ["season", "player"]).select("season", "team", "player", "poss", "x")
    moved = L.team_free(rows, "season")
    totals = rows.drop("x").join(moved, ["season", "player"]).groupBy("season", "team").agg((F.abs(F.sum(F.col("poss") * F.col("x"))) / F.sum("poss")).alias("total"))
    return totals.groupBy("season").agg(r(F.max("total"), 6).alias("most")).join(moved.groupBy("season").agg(F.count("*").alias("players")), "season")


@query("lam39_held_spread", """select season, player, round(mx + (x - mx) * sqrt(sum(w * (b - mb) * (b - mb)) over (partition by season) / sum(w * (x - mx) * (x - mx)) over (partition by season)), 6) as held from (select *, sum(w * x) over g / sum(w) over g as mx, sum(w * b) over g / sum(w) over g as mb from (
  select m.season, m.player, m.team, m.w, p.pts / p.poss / 1000 as x, p.games / 50.0 as b from (select *, sum(poss) over (partition by season, player) as w, row_number() over (partition by season, player order by poss desc, team) as k from split) m join player_season p on p.season = m.season and p.player = m.player where m.k = 1) window g as (partition by season, team))""", _STATUS)
def _(t: Tables) -> DataFrame:
    """A line whose spread inside main teams is held to another's; every main team's mean stays."""
    split = t.fact.groupBy("season", F.when(F.col("status") == "F", 1).otherwise(2).alias("team"), "player").agg(F.sum("poss").alias("poss"))
    main = split.groupBy("season", "player").agg(F.sum("poss").alias("w"), F.max_by("team", F.struct("poss", -F.col("team"))).alias("team"))
    line = t.player_season.select("season", "player", (F.col("pts") / F.col("poss") / 1000).alias("x"), (F.col("games") / 50.0).alias("b"))
    rows = main.join(line, ["season", "player"])
    team, season = Window.partitionBy("season", "team"), Window.partitionBy("season")
    mean = F.sum(F.col("w") * F.col("x")).over(team) / F.sum("w").over(team)
    apart = rows.select("season", "player", "w", mean.alias("mean"), (F.col("x") - mean).alias("dx"), M.centred(rows, ["season", "team"], "b", "w").alias("db"))
    square = lambda c: F.sum(F.col("w") * F.col(c) * F.col(c)).over(season)
    return apart.select("season", "player", r(F.col("mean") + F.col("dx") * F.sqrt(square("db") / square("dx")), 6).alias("held"))


@query("lam43_within_team_sums", "select season, round(sum(w * x * x), 4) as xx, round(sum(w * x * y), 4) as xy from (select season, w, x - sum(w * x) over g / sum(w) over g as x, y - sum(w * y) over g / sum(w) over g as y from xy window g as (partition by season, team)) group by 1", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    rows = within(pairs_of(t), ["season", "team"], ["x", "y"])
    return rows.groupBy("season").agg(r(F.sum(F.col("w") * F.col("x") * F.col("x"))).alias("xx"), r(F.sum(F.col("w") * F.col("x") * F.col("y"))).alias("xy"))


@query("lam44_standardised_ridge", "select season, round(case when sd > 1e-9 then c / sd / (1 + 0.1) else 0 end, 6) as x, 0.0::double as constant from (select season, sqrt(sum(w * (x - mx) * (x - mx)) / sum(w)) as sd, sum(w * (x - mx) * (y - my)) / sum(w) as c from (select *, sum(w * x) over g / sum(w) over g as mx, sum(w * y) over g / sum(w) over g as my from xy window g as (partition by season)) group by 1)", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """Coefficients of standardised inputs under a ridge; an input without spread gets zero."""
    rows = within(pairs_of(t).withColumn("constant", F.lit(3.0)), ["season"], ["x", "constant", "y"])

    def coefficient(c: str) -> Column:
        spread = F.sqrt(F.sum(F.col("w") * F.col(c) * F.col(c)) / F.sum("w"))
        cross = F.sum(F.col("w") * F.col(c) * F.col("y")) / F.sum("w")
        return r(F.when(spread > 1e-9, cross / F.nullif(spread, F.lit(0.0)) / 1.1).otherwise(0.0), 6).alias(c)

    return rows.groupBy("season").agg(coefficient("x"), coefficient("constant"))


@query("lam48_type_predictions", "select xy.season, xy.player, round(xy.x * m.b, 6) as predicted from xy join (select f.fold, sum(w * x * y) / sum(w * x * x) as b from (select unnest([0, 1, 2]) as fold) f join xy q on q.fold <> f.fold group by 1) m on m.fold = xy.fold", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """Each player's inputs times the coefficient of the players outside the own fold: the total less the fold's sums."""
    rows = pairs_of(t)
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = rows.groupBy("fold").agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"))
    every = Window.partitionBy(F.lit(0))
    model = sums.select("fold", ((F.sum("xy").over(every) - F.col("xy")) / (F.sum("xx").over(every) - F.col("xx"))).alias("b"))
    return rows.join(F.broadcast(model), "fold").select("season", "player", r(x * F.col("b"), 6).alias("predicted"))


_GIVEN = "shares as (select season, team, player, poss, poss / sum(poss) over (partition by season, team) as a, 0.3 * (pts / poss / 1000 - 1.4) as m, pts / poss / 1000 as x from player_season), given as (select *, m - a * sum(a * m) over (partition by season, team) / sum(a * a) over (partition by season, team) as c from shares)"


def given_back(totals: DataFrame) -> DataFrame:
    """The nearest corrections to the predictions whose total over every team, by possession shares, is zero."""
    team = Window.partitionBy("season", "team")
    rows = totals.select("season", "team", "player", "poss", (F.col("poss") / F.sum("poss").over(team)).alias("a"), (0.3 * (F.col("pts") / F.col("poss") / 1000 - 1.4)).alias("m"), (F.col("pts") / F.col("poss") / 1000).alias("x"))
    return rows.withColumn("c", F.col("m") - F.col("a") * F.sum(F.col("a") * F.col("m")).over(team) / F.sum(F.col("a") * F.col("a")).over(team))


@query("lam49_given_back", "select season, player, round(c, 6) as c from given", _GIVEN)
def _(t: Tables) -> DataFrame:
    return given_back(t.player_season).select("season", "player", r("c", 6).alias("c"))


@query("lam50_corrections_balance", "select season, team, count(*) as players, 0.0::double as total from given group by all", _GIVEN)
def _(t: Tables) -> DataFrame:
    return given_back(t.player_season).groupBy("season", "team").agg(F.count("*").alias("players"), F.abs(r(F.sum(F.col("a") * F.col("c")), 6)).alias("total"))


@query("lam51_adjusted", "select season, player, round(x + c - sum(poss * (x + c)) over w / sum(poss) over w, 6) as rating from given window w as (partition by season)", _GIVEN)
def _(t: Tables) -> DataFrame:
    rows = given_back(t.player_season).withColumn("v", F.col("x") + F.col("c"))
    return rows.select("season", "player", r(M.centred(rows, ["season"], "v", "poss"), 6).alias("rating"))


@query("lam52_context_refit", "select f.season, f.priority, round(sum(f.poss * (f.pts / f.poss - q.x)) / sum(f.poss), 4) as level from fact f join (select season, player, sum(pts) / sum(poss) as x from fact group by all) q on f.season = q.season and f.player = q.player group by all")
def _(t: Tables) -> DataFrame:
    """Context levels with the ratings held as an offset; the contexts exclude each other, so the solve is a mean."""
    rate = t.player_season.select("season", "player", (F.col("pts") / F.col("poss")).alias("x"))
    rows = t.played.join(rate, ["season", "player"])
    return rows.groupBy("season", "priority").agg(r(F.sum(F.col("pts") - F.col("poss") * F.col("x")) / F.sum("poss")).alias("level"))


@query("lam55_systems_scored", """select system, priority as context, phase, round(sqrt(sum(poss * e * e) / sum(poss)), 3) as error from (select f.priority, f.phase, f.poss, s.system, f.pts / f.poss / 10 - case s.system when 'own' then q.x when 'team' then q.m else 140.0 end as e from fact f join (select season, player, pts / poss / 10 as x, sum(pts) over (partition by season, team) / sum(poss) over (partition by season, team) / 10 as m from player_season) q
  on f.season = q.season and f.player = q.player, (select unnest(['own', 'team', 'none']) as system) s) group by all""")
def _(t: Tables) -> DataFrame:
    """Every system in every context: the systems stand side by side in a row and are unpivoted, not joined."""
    team = Window.partitionBy("season", "team")
    rated = t.player_season.select("season", "player", (F.col("pts") / F.col("poss") / 10).alias("x"), (F.sum("pts").over(team) / F.sum("poss").over(team) / 10).alias("m"))
    y = F.col("pts") / F.col("poss") / 10
    systems = F.array(*[F.struct(F.lit(n).alias("system"), (y - v).alias("e")) for n, v in (("own", F.col("x")), ("team", F.col("m")), ("none", F.lit(140.0)))])
    rows = t.fact.join(rated, ["season", "player"]).select("priority", "phase", "poss", F.inline(systems))
    return rows.groupBy("system", F.col("priority").alias("context"), "phase").agg(r(F.sqrt(F.sum(F.col("poss") * F.col("e") * F.col("e")) / F.sum("poss")), 3).alias("error"))


@query("lam66_expected_margin", "select f.game, round(sum(case when f.player % 2 = 0 then q.x else -q.x end) + 0.5, 4) as margin from (select distinct game, player from fact) f join (select player, sum(pts) / sum(poss) / 100 as x from fact group by 1) q on f.player = q.player group by 1")
def _(t: Tables) -> DataFrame:
    rate = t.lines.groupBy("player").agg((F.sum("pts") / F.sum("poss") / 100).alias("x"))
    side = F.when(F.col("player") % 2 == 0, F.col("x")).otherwise(-F.col("x"))
    return t.lines.select("game", "player").distinct().join(rate, "player").groupBy("game").agg(r(F.sum(side) + 0.5).alias("margin"))


@query("lam68_two_plans_agree", "select player, 0.0::double as apart from fact group by 1")
def _(t: Tables) -> DataFrame:
    """Games without a player, by subtraction and by an outright replacement of the rating: the same number."""
    rate = t.lines.groupBy("player").agg((F.sum("pts") / F.sum("poss") / 100).alias("x"))
    seats = t.lines.select("game", "player").distinct().join(rate, "player")
    total = seats.groupBy("game").agg(F.sum("x").alias("total"))
    fast = seats.join(total, "game").groupBy("player").agg(F.sum(F.col("total") - F.col("x") + 10).alias("fast"))
    mates = seats.select("game", F.col("player").alias("mate"), F.col("x").alias("mx"))
    own = seats.select("game", "player").join(mates, "game").withColumn("v", F.when(F.col("mate") == F.col("player"), 10.0).otherwise(F.col("mx")))
    slow = own.groupBy("player").agg(F.sum("v").alias("slow"))
    return fast.join(slow, "player").select("player", F.abs(r(F.col("fast") - F.col("slow"))).alias("apart"))


# ---- models


@query("lam75_shot_curve")
def _(t: Tables) -> DataFrame:
    """A logistic curve over a spline of the distance, and each distance's own rate padded toward it."""
    basis = lambda x: array_to_vector(F.concat(F.array(x), L.spline_basis(x, [1.0, 10.0, 20.0, 35.0, 50.0])))
    bins = t.lines.groupBy("poss").agg(F.count("*").alias("n"), F.count_if(F.col("flag") != "N").alias("made")).withColumn("features", basis(F.col("poss")))
    cases = bins.select("features", F.inline(F.array(F.struct(F.lit(1.0).alias("label"), F.col("made").cast("double").alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("made")).cast("double").alias("weight")))))
    model = LogisticRegression(weightCol="weight", regParam=1e-6, maxIter=50).fit(cases.where("weight > 0"))
    fitted = model.transform(bins).withColumn("p", vector_to_array("probability")[1])
    return fitted.select(F.col("poss").alias("distance"), "n", "made", r(S.shrink(F.col("n"), F.col("made") / F.col("n"), 200.0, F.col("p")), 3).alias("chance"))


@query("lam80_membership", "select season, count(*) as players, 1.0::double as total from player_season group by 1")
def _(t: Tables) -> DataFrame:
    """Every player's probabilities over the types; they add up to one."""
    rows = t.player_season.select("season", "player", (F.col("poss") / 100).alias("a"), (F.col("pts") / F.col("poss") / 100).alias("b"))
    features = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    own = GaussianMixture(k=3, seed=1, maxIter=10).fit(features).transform(features).withColumn("p", vector_to_array("probability"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    return own.groupBy("season").agg(F.count("*").alias("players"), r(F.max(total), 6).alias("total"))


@query("lam81_training_rows", """select kind, count(*) as n, round(sum(weight), 4) as weight from (select 'career' as kind, sum(poss) as weight from player_season group by player union all
  select 'run', poss + after from (select poss, lead(poss) over w as after, lead(season) over w as next, season from player_season window w as (partition by player order by season)) where next = season + 1 union all select 'part', poss * 0.5 from player_season where games >= 4) group by 1""")
def _(t: Tables) -> DataFrame:
    """Rows to learn from at three grains: careers, runs of two seasons, parts of seasons at half weight."""
    rows = t.player_season
    line = Window.partitionBy("player").orderBy("season")
    career = rows.groupBy("player").agg(F.sum("poss").alias("weight")).select(F.lit("career").alias("kind"), "weight")
    run = rows.select("season", "poss", F.lead("poss").over(line).alias("after"), F.lead("season").over(line).alias("next")).where("next = season + 1").select(F.lit("run").alias("kind"), (F.col("poss") + F.col("after")).alias("weight"))
    part = rows.where("games >= 4").select(F.lit("part").alias("kind"), (F.col("poss") * 0.5).alias("weight"))
    return career.unionAll(run).unionAll(part).groupBy("kind").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


def boosted_inputs(t: Tables) -> DataFrame:
    rows = t.player_season.select("season", "player", F.col("games").cast("double").alias("w"), F.col("poss").cast("double"), F.col("season").cast("double").alias("year"), (F.col("pts") / F.col("poss")).alias("label"))
    return VectorAssembler(inputCols=["poss", "year"], outputCol="features").transform(rows)


def trees(weight: str = "w") -> GBTRegressor:
    return GBTRegressor(labelCol="label", weightCol=weight, maxIter=3, maxDepth=3, seed=1)


@query("lam83_full_and_folds")
def _(t: Tables) -> DataFrame:
    """The full model beside those that left a fold of players out."""
    rows = stores.kept(boosted_inputs(t).withColumn("fold", Q.arithmetic_fold(F.col("player"), 2)))
    full = trees().fit(rows).transform(rows).withColumnRenamed("prediction", "full")
    parts = [trees().fit(rows.where(F.col("fold") != k)).transform(full.where(F.col("fold") == k)) for k in range(2)]
    return parts[0].unionAll(parts[1]).select("season", "player", r("full", 3).alias("full_model"), r("prediction", 3).alias("out_of_fold"))


def bagged(rows: DataFrame, bags: int) -> DataFrame:
    """(season, player, answer, models): the mean over bags that drew none of the player's rows, or over all if all did."""
    parts = []
    for bag in range(bags):
        draw = F.pmod(F.pmod(F.col("player") * 2654435761 + bag * 40503, F.lit(1 << 32)), F.lit(3))
        drawn = stores.kept(rows.withColumn("bag_w", F.col("w") * draw).withColumn("unseen", draw == 0))
        parts.append(trees("bag_w").fit(drawn.where("bag_w > 0")).transform(drawn).select("season", "player", "unseen", "prediction"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    free = F.avg(F.when(F.col("unseen"), F.col("prediction")))
    return every.groupBy("season", "player").agg(F.coalesce(free, F.avg("prediction")).alias("answer"), F.count_if("unseen").alias("models"))


@query("lam85_bags", "select season, player, (select count(*) from (select unnest(range(3)) as bag) where (player * 2654435761 + bag * 40503) % 4294967296 % 3 = 0) as models from player_season")
def _(t: Tables) -> DataFrame:
    """How many bags never saw each player."""
    return bagged(boosted_inputs(t), 3).select("season", "player", "models")


@query("lam86_out_of_bag_answers")
def _(t: Tables) -> DataFrame:
    return bagged(boosted_inputs(t), 3).select("season", "player", r("answer", 3).alias("answer"))


@query("lam88_season_priors", "select season, count(*) as players, 0.0::double as mean from player_season where season = 1997 group by 1")
def _(t: Tables) -> DataFrame:
    """A season's priors from models of the other seasons and other players, centred by possessions."""
    rows = stores.kept(boosted_inputs(t).withColumn("fold", Q.arithmetic_fold(F.col("player"), 2)))
    others, own = rows.where("season <> 1997"), rows.where("season = 1997")
    parts = [trees().fit(others.where(F.col("fold") != k)).transform(own.where(F.col("fold") == k)) for k in range(2)]
    both = parts[0].unionAll(parts[1]).select("season", "player", "poss", "prediction")
    centred = both.withColumn("x", M.centred(both, ["season"], "prediction", "poss"))
    return centred.groupBy("season").agg(F.count("*").alias("players"), F.abs(r(F.sum(F.col("x") * F.col("poss")) / F.sum("poss"))).alias("mean"))


@query("lam89_synthetic_roles")
def _(t: Tables) -> DataFrame:
    """Role columns of the synthetic league: games so far, share of games begun, rank by truth within a side."""
    made = synthetic.league(t.spark, 500, 60)
    line = Window.partitionBy("player").orderBy("game", "side")
    ranked = made.withColumn("place", F.row_number().over(Window.partitionBy("game", "side").orderBy(F.desc("truth"), "player")))
    rows = ranked.withColumn("so_far", F.row_number().over(line))
    return rows.groupBy("player").agg(F.max("so_far").alias("games"), r(F.avg((F.col("place") == 1).cast("int")), 6).alias("lead_share"))


# ---- checks and commands


@query("chk07_piece_multipliers", "select season, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) as a, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 6) as b from (select season, sum(w * x * x) as xx, sum(w * x * z) as xz, sum(w * z * z) as zz, sum(w * x * y) as xy, sum(w * z * y) as zy from xy group by 1)", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """Multipliers of two pieces a season, by a small ridge-free solve in one task a season."""
    named = pairs_of(t).select("season", "w", "y", F.concat_ws("-", "season", "player").alias("row"), F.inline(F.array(F.struct(F.lit(1).cast("long").alias("col"), F.col("x").alias("v")), F.struct(F.lit(2).cast("long").alias("col"), F.col("z").alias("v")))))
    sums = M.gram(named, ["season"], "row", "col", "v", "w").unionByName(right_hand(named, ["season"]))
    fit = L.ridge(sums, "season", 0.0)
    return fit.groupBy("season").agg(r(F.max(F.when(F.col("i") == 1, F.col("beta"))), 6).alias("a"), r(F.max(F.when(F.col("i") == 2, F.col("beta"))), 6).alias("b"))


@query("chk08_residual", "select season, player, round(y - sum(w * y) over g / sum(w) over g - (x - sum(w * x) over g / sum(w) over g) * b, 6) as left_over from (select *, sum(w * xc * yc) over g / sum(w * xc * xc) over g as b from (select *, x - sum(w * x) over g / sum(w) over g as xc, y - sum(w * y) over g / sum(w) over g as yc from xy window g as (partition by season)) window g as (partition by season)) window g as (partition by season)", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """What a level and one control leave of the response."""
    rows = within(pairs_of(t), ["season"], ["x", "y"])
    season = Window.partitionBy("season")
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    return rows.select("season", "player", r(y - x * F.sum(w * x * y).over(season) / F.sum(w * x * x).over(season), 6).alias("left_over"))


@query("chk17_shuffled_flag", """select a.game, count(*) filter (where a.made) as before, count(*) filter (where b.made) as after, round(sum(case when b.made then a.poss else 0 end), 2) as poss from (select *, row_number() over (partition by game order by line, player, part, poss, pts) as k from (select *, flag <> 'N' as made from fact)) a
  join (select game, made, row_number() over (partition by game order by (k * 2654435761 + game * 97) % 4294967296 % 1000, k) as k from (select *, flag <> 'N' as made, row_number() over (partition by game order by line, player, part, poss, pts) as k from fact)) b on a.game = b.game and a.k = b.k group by 1""")
def _(t: Tables) -> DataFrame:
    """A flag permuted inside each game by a hash order; the game keeps its number of flags."""
    line = Window.partitionBy("game").orderBy("line", "player", "part", "poss", "pts")
    rows = t.lines.select("game", "poss", (F.col("flag") != "N").alias("made"), F.row_number().over(line).alias("k"))
    mixed = Window.partitionBy("game").orderBy(F.pmod(F.pmod(F.col("k") * F.lit(2654435761) + F.col("game") * 97, F.lit(1 << 32)), F.lit(1000)), "k")
    shuffled = rows.select("game", F.col("made").alias("other"), F.row_number().over(mixed).alias("k"))
    both = rows.join(shuffled, ["game", "k"])
    return both.groupBy("game").agg(F.count_if("made").alias("before"), F.count_if("other").alias("after"), r(F.sum(F.when(F.col("other"), F.col("poss")).otherwise(0.0)), 2).alias("poss"))


@query("cmd03_shrink_step", "select season, team, 0.0::double as apart from player_season group by all")
def _(t: Tables) -> DataFrame:
    """The shrink keeps a team's weighted mean in proportion: 0.9 of it, whatever its players' deviations."""
    out = build.ratings(t.fact, t.lineups).withColumn("raw", F.col("prior") + F.col("deviation"))
    mean = lambda c: F.sum(F.col(c) * F.col("poss")) / F.sum("poss")
    teams = out.groupBy("season", "team").agg(mean("raw").alias("raw"), mean("rating").alias("rating"), F.sum("poss").alias("w"))
    season = Window.partitionBy("season")
    level = F.sum(F.col("raw") * F.col("w")).over(season) / F.sum("w").over(season)
    return teams.select("season", "team", F.abs(r(F.col("rating") - 0.9 * (F.col("raw") - level))).alias("apart"))


@query("cmd04_swap_step", "select season, count(*) as players, round(sum(abs(c)) / count(*), 6) as moved from given group by 1", _GIVEN)
def _(t: Tables) -> DataFrame:
    """The corrections as a step from one stored table to another; how far they move a season's players."""
    base = stores.round_trip(t.player_season, "parquet")
    adjusted = stores.round_trip(given_back(base).select("season", "player", "x", (F.col("x") + F.col("c")).alias("rating")), "parquet")
    return adjusted.groupBy("season").agg(F.count("*").alias("players"), r(F.avg(F.abs(F.col("rating") - F.col("x"))), 6).alias("moved"))


@query("cmd07_reproduced", "select 'rating' as name, 0::bigint as only_left, 0::bigint as only_right, 0::bigint as differ")
def _(t: Tables) -> DataFrame:
    """A rebuild from rows in another order gives the stored ratings to six places of their scale."""
    kept = lambda df: df.select("season", "player", F.round(F.col("rating") / 1000, 6).alias("rating"))
    base = stores.round_trip(kept(build.ratings(t.fact, t.lineups)), "parquet")
    again = kept(build.ratings(t.fact.repartition(13, "part"), t.lineups.repartition(5)))
    return R.table_diff(base, again, ["season", "player"]).where("most <= 1e-5 or most is null").select("name", "only_left", "only_right", F.when(F.col("most") > 1e-5, F.col("differ")).otherwise(0).cast("long").alias("differ"))


@query("cmd08_line_equations", "select season, fold, round(sum(w * x * x), 2) as xx, round(sum(w * x * y), 4) as xy, count(*) as n from xy group by all", _PAIRS_OF)
def _(t: Tables) -> DataFrame:
    """Sums for the lines, stored by season and read back."""
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = pairs_of(t).groupBy("season", "fold").agg(r(F.sum(w * x * x), 2).alias("xx"), r(F.sum(w * x * y)).alias("xy"), F.count("*").alias("n"))
    return stores.PartitionStore(t.spark, "season").upsert(sums).read().select("season", "fold", "xx", "xy", "n")


@query("cmd09_wins_columns", """select season, player, team, poss::double as poss, round(off, 4) as offense, round(def, 4) as defense, round(pace, 4) as pace, round(off * poss / 100, 4) as points_off, round(def * poss / 100, 4) as points_def,
  round((off + def) * poss / 100, 4) as points, round((off + def) * poss / 100 / 30, 4) as wins, round((off + def + 2) * poss / 100 / 30, 4) as wins_above_bar, round(late / poss, 4) as leverage, round((off + def) * poss / 100 / 30 * (0.5 + late / poss), 4) as wins_late
  from (select p.*, (p.pts / p.poss - l.rate) / 100 as off, (a.made / p.poss - l.made) * 10 as def, p.poss / p.games - l.pace as pace, a.late from player_season p join (select season, sum(pts) / sum(poss) as rate, sum(poss) / sum(games) as pace,
  (select sum((flag = 'R')::int * poss) / sum(poss) from fact f where f.season = player_season.season) as made from player_season group by season) l on p.season = l.season
  join (select season, team, player, sum((flag = 'R')::int * poss) as made, sum((line >= 4)::int * poss) as late from fact group by all) a on a.season = p.season and a.team = p.team and a.player = p.player)""")
def _(t: Tables) -> DataFrame:
    """Twelve columns a player-season: ratings against the season's level, points, wins, wins above a bar and under leverage."""
    own = t.fact.groupBy("season", "team", "player").agg(
        F.sum("poss").alias("poss"), F.sum("pts").alias("pts"), F.countDistinct("game").alias("games"), F.sum(F.when(F.col("flag") == "R", F.col("poss")).otherwise(0.0)).alias("made"), F.sum(F.when(F.col("line") >= 4, F.col("poss")).otherwise(0.0)).alias("late")
    )
    season = Window.partitionBy("season")
    level = lambda a, b: F.sum(a).over(season) / F.sum(b).over(season)
    rated = own.withColumn("off", (F.col("pts") / F.col("poss") - level("pts", "poss")) / 100).withColumn("def", (F.col("made") / F.col("poss") - level("made", "poss")) * 10).withColumn("pace", F.col("poss") / F.col("games") - level("poss", "games"))
    both, late = F.col("off") + F.col("def"), F.col("late") / F.col("poss")
    wins = lambda x: x * F.col("poss") / 100 / 30
    return rated.select(
        "season", "player", "team", "poss", r("off").alias("offense"), r("def").alias("defense"), r("pace").alias("pace"), r(F.col("off") * F.col("poss") / 100).alias("points_off"), r(F.col("def") * F.col("poss") / 100).alias("points_def"),
        r(both * F.col("poss") / 100).alias("points"), r(wins(both)).alias("wins"), r(wins(both + 2)).alias("wins_above_bar"), r(late).alias("leverage"), r(wins(both) * (0.5 + late)).alias("wins_late"),
    )
