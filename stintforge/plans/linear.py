"""Linear algebra, models and checks (LAM, CHK, CMD)."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintforge.functions import scalars as S
from stintforge.operators import design as D
from stintforge.operators import linear as L
from stintforge.operators import moments as M
from stintforge.operators import relations as R
from stintforge.operators import sequences as Q
from stintforge.plans.registry import query
from stintforge.plans.relational import ZONES, masks, r
from stintforge.sources import stores
from stintforge.sources.tables import Tables


def design(t: Tables) -> DataFrame:
    """Long form: each game's players with value 1 and a constant (column 0); response pts / poss, weight poss."""
    game = t.lineups.select("season", "game", (F.col("pts") / F.col("poss")).alias("y"), F.col("poss").alias("w"), "lineup")
    return game.select("season", "game", "y", "w", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform("lineup", lambda p: p + 1))).alias("col")).withColumn("v", F.lit(1.0))


def normal_matrix(t: Tables) -> DataFrame:
    """(season, i, j, g) of the design, from each game's own array of entries."""
    return M.gram_packed(t.lineups.select("season", F.col("poss").alias("w"), entries().alias("e")), ["season"])


def equations(t: Tables) -> D.Equations:
    """(season, i, j, g): the normal matrix, and the right-hand side where j is null; with the rows they come from."""
    rows = design(t)
    right = rows.groupBy("season", F.col("col").alias("i")).agg(F.sum(F.col("w") * F.col("v") * F.col("y")).alias("g"))
    return D.Equations(design_rows(t), "season", normal_matrix(t).unionByName(right.select("season", "i", F.lit(None).cast("long").alias("j"), "g")))


def entries() -> Column:
    """A lineup's entries: its players and the constant."""
    return F.transform(F.concat(F.array(F.lit(0).cast("long")), F.transform("lineup", lambda p: p + 1)), lambda c: F.struct(c.alias("c"), F.lit(1.0).alias("v")))


def design_rows(t: Tables, *responses: Column) -> DataFrame:
    """(season, game, w, y, e): the design a row a game, with its responses (points a possession) and entries."""
    return t.lineups.select("season", "game", F.col("poss").alias("w"), F.array(*(responses or [F.col("pts") / F.col("poss")])).alias("y"), entries().alias("e"))


_DESIGN = "design as (select season, game, pts / poss as y, poss as w, unnest(list_concat([0::bigint], list_transform(lineup, lambda p: p + 1))) as col from lineups)"
_EQUATIONS = _DESIGN + """, equations as (select a.season, a.col as i, b.col as j, sum(a.w) as g from design a join design b on a.game = b.game and a.col <= b.col group by all
  union all select season, col, null, sum(w * y) from design group by season, col)"""


@query("lam01_gram", "select season, i, j, round(g, 2) as g from equations where j is not null", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    return normal_matrix(t).select("season", "i", "j", r("g", 2).alias("g"))


@query("lam01_right_side", "select season, i, round(g, 4) as b from equations where j is null", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    return equations(t).where("j is null").select("season", "i", r("g", 4).alias("b"))


@query("lam02_ridge")
def _(t: Tables) -> DataFrame:
    return L.ridge(equations(t), "season", 5000.0, sd=True).select("season", (F.col("i") - 1).alias("player"), r("beta", 3).alias("rating"), r("sd", 6).alias("sd"))


@query("lam02_ridge_residual", "select season, count(distinct col) as columns, 0.0::double as residual from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    """The normal equations hold: what the solution leaves is zero to six places."""
    return L.ridge(equations(t), "season", 5000.0).groupBy("season").agg(F.count("*").alias("columns"), r(F.max(F.abs("residual")), 6).alias("residual"))


@query("lam04_kept_seasons", "select i, j, round(sum(g), 2) as g from equations where season <> 1997 group by all", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    return equations(t).where("season <> 1997").groupBy("i", "j").agg(r(F.sum("g"), 2).alias("g"))


@query("lam11_leave_season_out", "select season, (select count(distinct col) from design) as columns, 0.0::double as residual from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    return L.ridge_leaving(equations(t), "season", 5000.0).groupBy("season").agg(F.count("*").alias("columns"), r(F.max(F.abs("residual")), 6).alias("residual"))


@query("lam13_one_inverse")
def _(t: Tables) -> DataFrame:
    """Ratings without each season, all from one inverse."""
    return L.ridge_leaving_inverse(equations(t), "season", 5000.0).select("season", (F.col("i") - 1).alias("player"), r("beta", 3).alias("rating"))


@query("lam13_leave_out_sums", "select s.season, e.i, e.j, round(sum(e.g), 4) as g from equations e join (select distinct season from equations) s on true where s.season <> e.season group by all having round(sum(e.g), 4) <> 0", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    rows = stores.kept(stores.in_few(design_rows(t).select("season", "w", F.col("y")[0].alias("y"), "e")))  # its seasons are asked for first
    right = rows.select("season", "w", "y", F.explode("e").alias("a")).select("season", F.col("a.c").alias("i"), F.lit(None).cast("long").alias("j"), (F.col("w") * F.col("a.v") * F.col("y")).alias("g"))
    seasons = sorted(x.season for x in rows.select("season").distinct().collect() if x.season is not None)
    return L.leave_out(M.gram_terms(rows, ["season"]).unionByName(right), "season", seasons).select("season", "i", "j", r("g", 4).alias("g")).where("g <> 0")


@query("lam10_rated_coefficients")
def _(t: Tables) -> DataFrame:
    """Coefficients of the players with enough possessions in the season."""
    fit = L.ridge(equations(t), "season", 5000.0).select("season", (F.col("i") - 1).alias("player"), "beta")
    seen = t.played.groupBy("season", "player").agg(F.sum("poss").alias("poss")).where("poss >= 1000")
    return fit.join(seen, ["season", "player"]).select("season", "player", "poss", r("beta", 3).alias("rating"))


@query("lam10_rated_players", "select season, player from player_season where poss >= 1000")
def _(t: Tables) -> DataFrame:
    return t.player_season.where("poss >= 1000").select("season", "player")


@query("lam20_prior_plus_deviation", "select season, player, round(v - sum(v * poss) over w / sum(poss) over w, 4) as rating from (select season, player, poss, 0.7 * (sum(pts) over (partition by season, team) / sum(poss) over (partition by season, team)) + 0.3 * pts / poss as v from player_season) window w as (partition by season)")
def _(t: Tables) -> DataFrame:
    team = Window.partitionBy("season", "team")
    v = t.player_season.withColumn("v", 0.7 * (F.sum("pts").over(team) / F.sum("poss").over(team)) + 0.3 * F.col("pts") / F.col("poss"))
    return v.select("season", "player", r(M.centred(v, ["season"], "v", "poss")).alias("rating"))


@query("lam26_extrapolation", "select a.player, round(2 * b.v - a.v, 4) as at_zero from (select player, avg(poss) as v from fact where game % 2 = 0 group by 1) a join (select player, avg(poss) as v from fact where game % 4 <> 0 group by 1) b on a.player = b.player")
def _(t: Tables) -> DataFrame:
    wide = t.lines.groupBy("player").agg(F.avg(F.when(F.col("game") % 2 == 0, F.col("poss"))).alias("a"), F.avg(F.when(F.col("game") % 4 != 0, F.col("poss"))).alias("b"))
    return wide.where("a is not null and b is not null").select("player", r(2 * F.col("b") - F.col("a")).alias("at_zero"))


@query("lam28_two_layer_shrink", """select season, player, round(0.8 * (tm - lg) + 0.5 * (pts / poss - tm), 4) as rating from (select *, sum(pts) over (partition by season, team) / sum(poss) over (partition by season, team) as tm, sum(pts) over (partition by season) / sum(poss) over (partition by season) as lg from player_season)""")
def _(t: Tables) -> DataFrame:
    team, season = Window.partitionBy("season", "team"), Window.partitionBy("season")
    mean = F.sum("pts").over(team) / F.sum("poss").over(team)
    league = F.sum("pts").over(season) / F.sum("poss").over(season)
    return t.player_season.select("season", "player", r(0.8 * (mean - league) + 0.5 * (F.col("pts") / F.col("poss") - mean)).alias("rating"))


#: Teammates or opponents, on the court or the bench, with attack or defence: eight contexts as conditions on a line.
CONTEXTS = {f"{who}_{where}_{what}": (who == "mates", f"status = '{s}' and flag {f}") for who in ("mates", "others") for where, s in (("on", "O"), ("bench", "F")) for what, f in (("attack", "= 'A'"), ("defence", "<> 'A'"))}


def context_sql() -> tuple[str, str]:
    own = ", ".join(f"coalesce(sum(poss) filter (where {m}), 0) as p_{k}, count(*) filter (where {m}) as n_{k}" for k, (_, m) in CONTEXTS.items())
    rest = {k: ("g.{0}_%s - m.{0}_%s" % (k, k)) if mate else ("o.{0}_%s" % k) for k, (mate, _) in CONTEXTS.items()}
    means = ", ".join(f"round((sum(coalesce({x.format('p')}, 0)) + 250) / (sum(coalesce({x.format('n')}, 0)) + 10), 6)::double as {k}" for k, x in rest.items())
    return own, means


@query("lam30_context_means", f"""select m.player, {context_sql()[1]} from (select game, player % 2 as side, player, {context_sql()[0]} from fact group by all) m
  join (select game, player % 2 as side, {context_sql()[0]} from fact group by all) g on m.game = g.game and m.side = g.side
  left join (select game, 1 - player % 2 as side, {context_sql()[0]} from fact group by all) o on m.game = o.game and m.side = o.side group by 1""")
def _(t: Tables) -> DataFrame:
    """Eight padded means over teammates (totals less the own part) and opponents of a player's games."""
    sums = [F.expr(f"coalesce(sum(poss) filter (where {m}), 0.0)").alias(f"p_{k}") for k, (_, m) in CONTEXTS.items()] + [F.expr(f"count(*) filter (where {m})").alias(f"n_{k}") for k, (_, m) in CONTEXTS.items()]
    rows = t.lines.withColumn("side", F.col("player") % 2)
    own = rows.groupBy("game", "side", "player").agg(*sums)
    measures = [c for c in own.columns if c[:2] in ("p_", "n_")]
    whole = own.groupBy("game", "side").agg(*[F.sum(c).alias(c) for c in measures])
    facing = whole.select("game", (1 - F.col("side")).alias("side"), *[F.col(c).alias(f"o{c}") for c in measures])
    met = own.join(whole.select("game", "side", *[F.col(c).alias(f"g{c}") for c in measures]), ["game", "side"]).join(facing, ["game", "side"], "left")
    rest = lambda c, mate: F.sum(F.col(f"g{c}") - F.col(c)) if mate else F.sum(F.coalesce(f"o{c}", F.lit(0)))
    return met.groupBy("player").agg(*[r((rest(f"p_{k}", mate) + 250) / (rest(f"n_{k}", mate) + 10), 6).alias(k) for k, (mate, _) in CONTEXTS.items()])


@query("lam32_residual_spread", "select season, round((sum(w * w * u * u) - 2 * m * sum(w * w * u) + m * m * sum(w * w)) / sum(w * w), 6) as variance from (select *, sum(w * u) over (partition by season) / sum(w) over (partition by season) as m from (select season, poss as w, pts / poss / 1000 as u from player_season)) group by season, m")
def _(t: Tables) -> DataFrame:
    rows = t.player_season.select("season", F.col("poss").alias("w"), (F.col("pts") / F.col("poss") / 1000).alias("u"))
    w, u = F.col("w"), F.col("u")
    sums = rows.groupBy("season").agg(F.sum(w * w * u * u).alias("c"), F.sum(w * w * u).alias("b"), F.sum(w * w).alias("a"), (F.sum(w * u) / F.sum(w)).alias("m"))
    return sums.select("season", r((F.col("c") - 2 * F.col("m") * F.col("b") + F.col("m") * F.col("m") * F.col("a")) / F.col("a"), 6).alias("variance"))


@query("lam33_team_mix", "select c.customer, round(sum(c.p * k.rate) / sum(c.p), 4) as mix from (select customer, team, sum(poss) as p from fact group by all) c join (select team, sum(pts) / sum(poss) as rate from fact group by 1) k on c.team = k.team group by 1")
def _(t: Tables) -> DataFrame:
    rate = t.fact.groupBy("team").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    own = t.fact.groupBy("customer", "team").agg(F.sum("poss").alias("p"))
    return own.join(rate, "team").groupBy("customer").agg(r(F.sum(F.col("p") * F.col("rate")) / F.sum("p")).alias("mix"))


@query("lam38_fixed_team_totals", "select season, player, round(x - sum(x * poss) over w / sum(poss) over w + sum(pts) over w / sum(poss) over w, 4) as held from (select *, pts / poss * 0.5 as x from player_season) window w as (partition by season, team)")
def _(t: Tables) -> DataFrame:
    team = Window.partitionBy("season", "team")
    x = t.player_season.withColumn("x", F.col("pts") / F.col("poss") * 0.5)
    return x.select("season", "player", r(M.centred(x, ["season", "team"], "x", "poss") + F.sum("pts").over(team) / F.sum("poss").over(team)).alias("held"))


_PAIRS = """lines as (select season, lineup, sum(pts) / sum(poss) as rate, sum(poss) as poss from lineups group by all), outs as (select *, unnest(lineup) as o from lines), cores as (select *, list_filter(lineup, lambda x: x <> o) as core from outs)"""


@query("lam46_swap_residuals", "select a.season, count(*) as pairs, round(sum(h), 2) as information, round(sum(h * d) / sum(h), 3) as mean from (select a.season, a.poss * b.poss / (a.poss + b.poss) as h, a.rate - b.rate as d from cores a join cores b on a.season = b.season and a.core = b.core and a.lineup < b.lineup) a group by 1", _PAIRS)
def _(t: Tables) -> DataFrame:
    lines = t.lineups.groupBy("season", "lineup").agg((F.sum("pts") / F.sum("poss")).alias("rate"), F.sum("poss").alias("poss"))
    side = lambda s: lines.select("season", F.col("lineup").alias(s), F.col("rate").alias(f"r{s}"), F.col("poss").alias(f"p{s}"))
    both = R.swap_pairs(lines, ["season"]).join(side("a"), ["season", "a"]).join(side("b"), ["season", "b"])
    h = F.col("pa") * F.col("pb") / (F.col("pa") + F.col("pb"))
    return both.groupBy("season").agg(F.count("*").alias("pairs"), r(F.sum(h), 2).alias("information"), r(F.sum(h * (F.col("ra") - F.col("rb"))) / F.sum(h), 3).alias("mean"))


@query("lam53_observed_expected", "select l.game, round(any_value(l.pts) / (any_value(l.poss) * avg(q.rate)), 6) as ratio from (select game, pts, poss, unnest(lineup) as player from lineups) l join (select player, sum(pts) / sum(poss) as rate from fact group by 1) q on l.player = q.player group by 1")
def _(t: Tables) -> DataFrame:
    rate = t.lines.groupBy("player").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    slots = t.lineups.select("game", "pts", "poss", F.explode("lineup").alias("player"))
    return slots.join(rate, "player").groupBy("game").agg(r(F.max("pts") / (F.max("poss") * F.avg("rate")), 6).alias("ratio"))


@query("lam61_level_refit", "select season, round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x) / 1000, 4) as level from (select p.season, pts / poss as y, t.rate as x from player_season p join (select player, sum(pts) / sum(poss) as rate from fact group by 1) t on p.player = t.player) group by 1")
def _(t: Tables) -> DataFrame:
    rate = t.played.groupBy("player").agg((F.sum("pts") / F.sum("poss")).alias("x"))
    rows = t.player_season.join(rate, "player").withColumn("y", F.col("pts") / F.col("poss"))
    return rows.groupBy("season").agg(r(F.regr_slope("y", "x")).alias("slope"), r(F.regr_intercept("y", "x") / 1000).alias("level"))


@query("lam63_isotonic")
def _(t: Tables) -> DataFrame:
    """A monotone curve of rate against possessions, pooled by adjacent violators."""
    rows = t.player_season.select(F.col("poss").alias("feature"), (F.col("pts") / F.col("poss")).alias("label"), F.col("games").cast("double").alias("weight"), "season", "player")
    model = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(rows)
    return model.transform(rows).select("season", "player", r("prediction", 3).alias("curve"))


@query("lam69_points_per_win", "select season, round(1 / regr_slope(games::double, poss), 6) as per_win from player_season group by 1")
def _(t: Tables) -> DataFrame:
    return t.player_season.groupBy("season").agg(r(1 / F.regr_slope(F.col("games").cast("double"), F.col("poss")), 6).alias("per_win"))


@query("lam71_robust_slope", """select season, round(sxy / sxx, 6) as slope, round(sqrt(n / (n - 2.0) * meat) / sxx, 6) as se from (select season, count(*) as n, any_value(sxx) as sxx, any_value(sxy) as sxy, sum(w * w * dx * dx * (dy - sxy / sxx * dx) * (dy - sxy / sxx * dx)) as meat from (
  select *, sum(w * dx * dx) over s as sxx, sum(w * dx * dy) over s as sxy from (select season, games::double as w, poss / 100 - sum(games * poss / 100) over s / sum(games) over s as dx, pts / poss / 1000 - sum(games * pts / poss / 1000) over s / sum(games) over s as dy from player_season window s as (partition by season)) window s as (partition by season)) group by 1)""")
def _(t: Tables) -> DataFrame:
    rows = t.player_season.select("season", F.col("games").cast("double").alias("w"), (F.col("poss") / 100).alias("x"), (F.col("pts") / F.col("poss") / 1000).alias("y"))
    rows = rows.select("season", "w", M.centred(rows, ["season"], "x", "w").alias("dx"), M.centred(rows, ["season"], "y", "w").alias("dy"))
    w, dx, dy = F.col("w"), F.col("dx"), F.col("dy")
    sums = rows.groupBy("season").agg(F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.count("*").alias("n"), *[F.sum(w * w * dx * dx * m).alias(f"m{k}") for k, m in enumerate((dy * dy, dx * dy, dx * dx))])
    slope = F.col("sxy") / F.col("sxx")
    meat = F.col("m0") - 2 * slope * F.col("m1") + slope * slope * F.col("m2")
    return sums.select("season", r(slope, 6).alias("slope"), r(F.sqrt(F.col("n") / (F.col("n") - 2.0) * meat) / F.col("sxx"), 6).alias("se"))


def stats() -> dict[str, str]:
    """Fifteen stats of a player-season as aggregates."""
    return {f"n_{k}": f"count(*) filter (where {m})" for k, m in masks().items()} | {"poss": "sum(poss)", "pts": "sum(pts)", "lines": "count(*)", "games": "count(distinct game)"}


@query("lam72_unpivoted_stats", "select side, stat, round(avg(v), 4) as mean, count(*) as n from (" + " union all ".join(
    f"select '{s}' as side, '{k}' as stat, v from (select season, player, ({x})::double as v from fact where {c} group by all)" for s, c in (("off", "status = 'O'"), ("def", "status = 'F'"), ("total", "true")) for k, x in stats().items()) + ") group by all")
def _(t: Tables) -> DataFrame:
    """Fifteen stats of each side and both, in long form, from one pass a side."""
    parts = []
    for side, c in (("off", "status = 'O'"), ("def", "status = 'F'"), ("total", "true")):
        wide = t.played.where(c).groupBy("season", "player").agg(*[F.expr(x).cast("double").alias(k) for k, x in stats().items()])
        parts.append(wide.unpivot(["season", "player"], list(stats()), "stat", "v").withColumn("side", F.lit(side)))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("side", "stat").agg(r(F.avg("v")).alias("mean"), F.count("*").alias("n"))


@query("lam73_spline_basis", """select p_partkey, round((c1 - c4) / 30 - (c3 - c4) / 10, 4) as b1, round((c2 - c4) / 20 - (c3 - c4) / 10, 4) as b2 from (select p_partkey, pow(greatest(x - 10, 0), 3) as c1, pow(greatest(x - 20, 0), 3) as c2, pow(greatest(x - 30, 0), 3) as c3, pow(greatest(x - 40, 0), 3) as c4 from (select p_partkey, p_size::double as x from part))""")
def _(t: Tables) -> DataFrame:
    basis = L.spline_basis(F.col("p_size").cast("double"), [10.0, 20.0, 30.0, 40.0])
    return t.part.select("p_partkey", basis.alias("b")).select("p_partkey", r(F.col("b")[0]).alias("b1"), r(F.col("b")[1]).alias("b2"))


@query("lam74_ridge_logistic")
def _(t: Tables) -> DataFrame:
    rows = t.lines.select("game", "line", "player", "part", "poss", (F.col("flag") == "R").cast("double").alias("label"))
    features = VectorAssembler(inputCols=["poss", "line"], outputCol="features").transform(rows)
    model = LogisticRegression(regParam=0.01, elasticNetParam=0.0, maxIter=20).fit(features)
    return model.transform(features).groupBy("player").agg(r(F.avg("prediction")).alias("predicted"), r(F.avg("label")).alias("seen"))


@query("lam79_mixture_profiles")
def _(t: Tables) -> DataFrame:
    """Player profiles in four soft clusters (maximum likelihood; a variational mixture has no counterpart here)."""
    rows = t.player_season.select("season", "player", F.col("poss").cast("double"), F.col("games").cast("double"), (F.col("pts") / F.col("poss") / 1000).alias("rate"))
    features = VectorAssembler(inputCols=["poss", "games", "rate"], outputCol="features").transform(rows)
    model = GaussianMixture(k=4, seed=1, maxIter=20).fit(features)
    return model.transform(features).select("season", "player", F.col("prediction").alias("cluster"))


@query("lam82_boosted_residuals")
def _(t: Tables) -> DataFrame:
    """Each player's answer by trees that never saw them: one model a fold of players."""
    rows = t.player_season.select("season", "player", F.col("games").cast("double").alias("w"), F.col("poss").cast("double"), F.col("season").cast("double").alias("year"), (F.col("pts") / F.col("poss")).alias("label"))
    rows = rows.withColumn("fold", Q.arithmetic_fold(F.col("player"), 3))
    features = VectorAssembler(inputCols=["poss", "year"], outputCol="features").transform(rows).persist()
    parts = []
    for fold in range(3):
        model = GBTRegressor(labelCol="label", weightCol="w", maxIter=5, maxDepth=3, seed=1).fit(features.where(F.col("fold") != fold))
        parts.append(model.transform(features.where(F.col("fold") == fold)).select("season", "player", "fold", r("prediction", 3).alias("answer")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("lam84_bootstrap_weights", "select bag, count(*) as players, sum(k)::bigint as draws from (select bag, player, ((player * 2654435761 + bag * 40503) % 4294967296 % 3)::int as k from (select distinct player from fact), (select unnest(range(5)) as bag)) group by 1")
def _(t: Tables) -> DataFrame:
    bags = t.lines.select("player").distinct().select("player", F.explode(F.expr("sequence(0L, 4L)")).alias("bag"))
    k = F.pmod(F.pmod(F.col("player") * 2654435761 + F.col("bag") * 40503, F.lit(1 << 32)), F.lit(3))
    return bags.groupBy("bag").agg(F.count("*").alias("players"), F.sum(k).alias("draws"))


# ---- checks


@query("chk01_missed_games", """select player, team, count(*) as missed from (select p.player, p.team, g.number from (select player, team, min(number) as a, max(number) as b from seen group by all having count(*) >= 0.4 * (max(number) - min(number) + 1) and count(*) > 1) p
  join (select distinct team, number from seen) g on g.team = p.team and g.number between p.a and p.b left join seen m on m.player = p.player and m.team = p.team and m.number = g.number where m.player is null) group by all""",
       "seen as (select distinct player, p_size as team, dense_rank() over (partition by p_size order by day, game) as number from (select * from fact join part on part = p_partkey))")
def _(t: Tables) -> DataFrame:
    """Games of a team (here: a part's size) that its regulars, in at least 40 % from their first to their last, missed between: the span less the appearances, with no range join."""
    rows = t.fact.join(t.part.select(F.col("p_partkey").alias("part"), F.col("p_size").alias("team_size")), "part").select("player", F.col("team_size").alias("team"), "day", "game")
    games = rows.select("team", "day", "game").distinct()
    number = games.withColumn("number", F.row_number().over(Window.partitionBy("team").orderBy("day", "game")))
    own = rows.distinct().join(number, ["team", "day", "game"])
    span = F.max("number") - F.min("number") + 1
    got = own.groupBy("player", "team").agg(span.alias("span"), F.count("*").alias("n"))
    return got.where("n > 1 and n >= 0.4 * span and span > n").select("player", "team", (F.col("span") - F.col("n")).cast("long").alias("missed"))


@query("chk04_hac_error", """select round(sqrt(g0 + 2 * g) / n, 6) as se from (select count(*) as n, sum(e * e) as g0 from months), (
  select sum((1 - k / (l + 1.0)) * a.e * b.e) as g from months a, months b, (select floor(4 * pow(count(*) / 100.0, 2 / 9.0))::int as l from months), (select unnest(range(1, 100)) as k) where k <= l and b.i = a.i + k)""",
       "months as (select m, e, row_number() over (order by m) as i from (select season * 100 + month(day) as m, avg(poss) - 25.5 as e from fact group by 1))")
def _(t: Tables) -> DataFrame:
    """Bartlett weights over floor(4 (n / 100)^(2 / 9)) lags of a series of months, which is short whatever the rows are."""
    months = t.played.groupBy((F.col("season") * 100 + F.month("day")).alias("m")).agg((F.avg("poss") - 25.5).alias("e"))
    line = months.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "e"))), lambda x: x["e"]).alias("e")).withColumn("n", F.size("e"))
    lags = line.withColumn("l", F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9.0))).cast("int"))
    product = lambda k: F.aggregate(F.zip_with(F.slice("e", F.lit(1), F.col("n") - k), F.slice("e", k + 1, F.col("n") - k), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("l")), lambda k: F.when(k > 0, 2 * (1 - k / (F.col("l") + 1.0))).otherwise(1.0) * product(k)), F.lit(0.0), lambda s, x: s + x)
    return lags.select(r(F.sqrt(weighted) / F.col("n"), 6).alias("se"))


@query("chk06_eras", "select coalesce(era, 'all') as era, round(avg(d), 4) as mean, count(*) as seasons from (select season, case when season < 1997 then 'early' when season < 2000 then 'middle' else 'late' end as era, avg(case when flag = 'A' then poss end) - avg(case when flag = 'R' then poss end) as d from fact group by 1, 2) group by grouping sets ((era), ())")
def _(t: Tables) -> DataFrame:
    gap = F.avg(F.when(F.col("flag") == "A", F.col("poss"))) - F.avg(F.when(F.col("flag") == "R", F.col("poss")))
    era = F.when(F.col("season") < 1997, "early").when(F.col("season") < 2000, "middle").otherwise("late")
    rows = t.played.groupBy("season").agg(gap.alias("d")).withColumn("era", era)
    return rows.groupingSets([["era"], []], "era").agg(r(F.avg("d")).alias("mean"), F.count("*").alias("seasons")).select(F.coalesce("era", F.lit("all")).alias("era"), "mean", "seasons")


@query("chk09_weighted_percentile", "select season, player, round((below + same / 2) / total, 6) as percentile from (select *, sum(poss) over (partition by season order by games range between unbounded preceding and current row) - sum(poss) over (partition by season, games) as below, sum(poss) over (partition by season, games) as same, sum(poss) over (partition by season) as total from player_season)")
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("season").orderBy("games")
    upto, same = F.sum("poss").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("poss").over(line.rangeBetween(0, 0))
    return t.player_season.select("season", "player", r((upto - same / 2) / F.sum("poss").over(Window.partitionBy("season")), 6).alias("percentile"))


@F.pandas_udf(T.DoubleType())
def inverse_normal(p: pd.Series) -> pd.Series:
    return p.map(lambda x: NormalDist().inv_cdf(min(max(x, 1e-9), 1 - 1e-9)))


@query("chk10_normal_score")
def _(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("season").orderBy("poss", "player"))
    n = F.count("*").over(Window.partitionBy("season"))
    return t.player_season.select("season", "player", ((place - 0.5) / n).alias("p")).select("season", "player", F.round(inverse_normal("p"), 6).alias("score"))


@query("chk11_jackknife", "select round(sqrt((n - 1.0) / n * sum((x - m) * (x - m))), 4) as se from (select *, avg(x) over () as m, count(*) over () as n from (select (sum(a) over () - a) / (sum(b) over () - b) as x from (select season, sum(pts) as a, sum(poss) as b from fact group by 1))) group by n")
def _(t: Tables) -> DataFrame:
    every = Window.partitionBy(F.lit(0))
    seasons = t.played.groupBy("season").agg(F.sum("pts").alias("a"), F.sum("poss").alias("b"))
    left = seasons.select(((F.sum("a").over(every) - F.col("a")) / (F.sum("b").over(every) - F.col("b"))).alias("x"))
    return left.agg(r(F.sqrt((F.count("*") - 1) * F.var_pop("x"))).alias("se"))


@query("chk14_quantile_bins", """select bin, sum(n)::bigint as n, round(any_value(mean), 4) as mean, round(sqrt(sum(e * e)) / sum(n), 4) as se from (select bin, player, count(*) as n, any_value(mean) as mean, sum(rate - mean) as e from (
  select *, avg(rate) over (partition by bin) as mean from (select player, pts / poss as rate, (ntile(10) over (partition by season order by poss, player))::int as bin from player_season)) group by all) group by 1""")
def _(t: Tables) -> DataFrame:
    """Means of quantile bins with standard errors clustered by player."""
    bins = t.player_season.select("player", (F.col("pts") / F.col("poss")).alias("rate"), F.ntile(10).over(Window.partitionBy("season").orderBy("poss", "player")).alias("bin"))
    mean = bins.groupBy("bin").agg(F.avg("rate").alias("mean"))
    clusters = bins.join(F.broadcast(mean), "bin").groupBy("bin", "player").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("rate") - F.col("mean")).alias("e"))
    return clusters.groupBy("bin").agg(F.sum("n").alias("n"), r(F.first("mean")).alias("mean"), r(F.sqrt(F.sum(F.col("e") * F.col("e"))) / F.sum("n")).alias("se"))


@query("chk16_concentration", "select game, round(sum(p * p) / (sum(p) * sum(p)), 9) as share from (select game, player, sum(poss) as p from fact group by all) group by 1")
def _(t: Tables) -> DataFrame:
    own = t.lines.groupBy("game", "player").agg(F.sum("poss").alias("p"))
    return own.groupBy("game").agg(r(S.concentration(F.array_sort(F.collect_list("p"))), 9).alias("share"))


@query("chk18_repeatability", "select season, count(*) as players, round(corr(a, b), 6) as repeat from (select season, part as p, avg(pts) filter (where game % 2 = 0) as a, avg(pts) filter (where game % 2 = 1) as b from fact group by all) where a is not null and b is not null group by 1")
def _(t: Tables) -> DataFrame:
    got = M.split_half(t.fact.withColumn("one", F.lit(1.0)), ["season"], "part", (F.col("game") % 2).cast("int"), "pts", "one")
    return got.select("season", F.col("units").alias("players"), r("correlation", 6).alias("repeat"))


@query("chk20_penalty_choice")
def _(t: Tables) -> DataFrame:
    """Held-out error of a season's games under ridges fitted to the other seasons, by penalty."""
    fits = D.ridge_leaving(equations(t), (500.0, 5000.0, 50000.0), (0,))
    wide = fits.groupBy("season", F.col("i").alias("col")).pivot("penalty", [500.0, 5000.0, 50000.0]).agg(F.first("beta"))
    betas = wide.select("season", "col", F.array("`500.0`", "`5000.0`", "`50000.0`").alias("betas"))
    total = [F.sum(F.coalesce(F.col("betas")[k], F.lit(0.0))) for k in range(3)]
    games = design(t).join(betas, ["season", "col"], "left").groupBy("season", "game").agg(F.array(*total).alias("p"), F.max("y").alias("y"), F.max("w").alias("w"))
    off = [F.col("y") - F.col("p")[k] for k in range(3)]
    errors = games.groupBy("season").agg(F.array(*[r(F.sqrt(F.sum(F.col("w") * x * x) / F.sum("w")), 2) for x in off]).alias("errors"))
    return errors.select("season", F.inline(F.arrays_zip(F.col("errors").alias("error"), F.array(*map(F.lit, (500.0, 5000.0, 50000.0))).alias("penalty"))))


@query("cmd12_table_diff", "select side, count(*) as n from (select 'gone' as side, * from (select game, player, poss from fact where flag <> 'N' except all select game, player, poss from fact where status = 'O') union all select 'new', * from (select game, player, poss from fact where status = 'O' except all select game, player, poss from fact where flag <> 'N')) group by 1")
def _(t: Tables) -> DataFrame:
    cols = ["game", "player", "poss"]
    old, new = t.lines.where("flag <> 'N'").select(*cols), t.lines.where("status = 'O'").select(*cols)
    both = old.exceptAll(new).withColumn("side", F.lit("gone")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@query("cmd14_neighbour_scoring", """select a.season, round(sqrt(sum(a.poss * (a.pts / a.poss - b.pts / b.poss) * (a.pts / a.poss - b.pts / b.poss)) / sum(a.poss)), 4) as error, count(*) as players from player_season a join player_season b on a.player = b.player and b.season = a.season - 1 group by 1""")
def _(t: Tables) -> DataFrame:
    before = t.player_season.select("player", (F.col("season") + 1).alias("season"), (F.col("pts") / F.col("poss")).alias("old"))
    off = F.col("pts") / F.col("poss") - F.col("old")
    return t.player_season.join(before, ["player", "season"]).groupBy("season").agg(r(F.sqrt(F.sum(F.col("poss") * off * off) / F.sum("poss"))).alias("error"), F.count("*").alias("players"))


# ---- more linear algebra and checks


@query("lam12_absorbed_season", """select i, j, round(sum(g), 1) as g from (select i, j, g from equations where i > 0 union all select a.j, b.j, -a.g * b.g / n.g from equations a join equations b on a.season = b.season and a.i = 0 and b.i = 0 and a.j > 0 and (b.j >= a.j or b.j is null)
  join equations n on n.season = a.season and n.i = 0 and n.j = 0) group by all""", _EQUATIONS)
def _(t: Tables) -> DataFrame:
    """Season levels eliminated from the players' equations by the Schur complement, then summed over seasons."""
    return L.absorbed(equations(t), "season", 1)


@query("lam18_prior_sums", "select game, round(sum(q.pts / q.poss), 4) as prior from (select season, game, unnest(lineup) as player from lineups) l join (select season, player, sum(pts) as pts, sum(poss) as poss from fact group by all) q on l.player = q.player and l.season = q.season + 1 group by 1")
def _(t: Tables) -> DataFrame:
    """Sum of the players' priors, last season's rates."""
    prior = t.played.groupBy((F.col("season") + 1).alias("season"), "player").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    return t.lineups.select("season", "game", F.explode("lineup").alias("player")).join(prior, ["season", "player"]).groupBy("game").agg(r(F.sum("rate")).alias("prior"))


def on_off_counts() -> dict[str, str]:
    """Eleven counts by flag and status, and ten by zone: all tries and makes."""
    zones = {z: f"poss > {a} and poss <= {b}" for z, (a, b) in ZONES.items()}
    return masks() | {f"{z}_tries": m for z, m in zones.items()} | {f"{z}_made": f"{m} and flag <> 'N'" for z, m in zones.items()}


@query("lam31_team_on_off_rates", "select player, " + ", ".join(
    f"round((100 * sum(own.{k}) + 200) / (sum(own.poss) + 100), 4)::double as on_{k}, round((100 * sum(g.{k} - own.{k}) + 200) / (sum(g.poss - own.poss) + 100), 4)::double as off_{k}" for k in on_off_counts())
    + " from (select game, player, sum(poss) as poss, " + ", ".join(f"count(*) filter (where {m}) as {k}" for k, m in on_off_counts().items()) + " from fact group by all) own join (select game, sum(poss) as poss, "
    + ", ".join(f"count(*) filter (where {m}) as {k}" for k, m in on_off_counts().items()) + " from fact group by 1) g on own.game = g.game group by 1")
def _(t: Tables) -> DataFrame:
    """Twenty-one padded rates a player: his own lines, and the rest of his games by subtraction."""
    rows = t.lines.select("game", "player", "poss", *[F.expr(m).cast("int").alias(k) for k, m in on_off_counts().items()])
    rest = R.without_own(rows, ["player"], ["game"], ["poss", *on_off_counts()])
    rate = lambda k, p: r((100 * F.sum(k) + 200) / (F.sum(p) + 100))
    return rest.groupBy("player").agg(*[x for k in on_off_counts() for x in (rate(k, "poss").alias(f"on_{k}"), rate(f"other_{k}", "other_poss").alias(f"off_{k}"))])


@query("lam35_rating_differences", "select a.player as a, b.player as b, round(a.rate - b.rate, 4) as d from (select player, sum(pts) / sum(poss) as rate from fact group by 1) a join (select player, sum(pts) / sum(poss) as rate from fact group by 1) b on b.player = a.player + 1")
def _(t: Tables) -> DataFrame:
    rate = t.lines.groupBy("player").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    return rate.select(F.col("player").alias("a"), (F.col("player") + 1).alias("b"), F.col("rate").alias("ra")).join(rate.select(F.col("player").alias("b"), F.col("rate").alias("rb")), "b").select("a", "b", r(F.col("ra") - F.col("rb")).alias("d"))


@query("lam45_partialled_out", "select round(regr_slope(ry, rx), 6) as slope from (select y - (regr_intercept(y, z) over () + regr_slope(y, z) over () * z) as ry, x - (regr_intercept(x, z) over () + regr_slope(x, z) over () * z) as rx from (select pts / 1000 as y, poss as x, games::double as z from player_season))")
def _(t: Tables) -> DataFrame:
    """Frisch-Waugh-Lovell from one pass of centred sums."""
    rows = t.player_season.select((F.col("pts") / 1000).alias("y"), F.col("poss").alias("x"), F.col("games").cast("double").alias("z"))
    sums = rows.agg(*[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yz", "zz")])
    part = lambda a, az, b: F.col(a) - F.col(az) * F.col(b) / F.col("zz")
    return sums.select(r(part("xy", "xz", "yz") / part("xx", "xz", "xz"), 6).alias("slope"))


@query("lam47_leave_fold_out")
def _(t: Tables) -> DataFrame:
    """Ridge on all folds of games but one, for each fold."""
    rows = design(t).withColumn("fold", Q.arithmetic_fold(F.col("game"), 5).cast("long"))
    right = rows.groupBy("fold", F.col("col").alias("i")).agg(F.sum(F.col("w") * F.col("v") * F.col("y")).alias("g"))
    sums = M.gram(rows, ["fold"], "game", "col", "v", "w").select("fold", "i", "j", "g").unionByName(right.select("fold", "i", F.lit(None).cast("long").alias("j"), "g"))
    by_fold = D.Equations(design_rows(t).withColumn("fold", Q.arithmetic_fold(F.col("game"), 5).cast("long")), "fold", sums)
    return L.ridge_leaving(by_fold, "fold", 5000.0).select("fold", (F.col("i") - 1).alias("player"), r("beta", 3).alias("rating"))


@query("lam54_pair_slope", "select a.season, round(sum(h * d * e) / sum(h * e * e), 4) as slope from (select a.season, a.poss * b.poss / (a.poss + b.poss) as h, a.rate - b.rate as d, (a.poss - b.poss) / 100 as e from cores a join cores b on a.season = b.season and a.core = b.core and a.lineup < b.lineup) a group by 1", _PAIRS)
def _(t: Tables) -> DataFrame:
    lines = t.lineups.groupBy("season", "lineup").agg((F.sum("pts") / F.sum("poss")).alias("rate"), F.sum("poss").alias("poss"))
    side = lambda s: lines.select("season", F.col("lineup").alias(s), F.col("rate").alias(f"r{s}"), F.col("poss").alias(f"p{s}"))
    both = R.swap_pairs(lines, ["season"]).join(side("a"), ["season", "a"]).join(side("b"), ["season", "b"])
    h, d, e = F.col("pa") * F.col("pb") / (F.col("pa") + F.col("pb")), F.col("ra") - F.col("rb"), (F.col("pa") - F.col("pb")) / 100
    return both.groupBy("season").agg(r(F.sum(h * d * e) / F.sum(h * e * e)).alias("slope"))


@query("lam64_pace_rows", "select game, round(poss / 10, 4) as pace, greatest(poss, 15)::double as seconds from lineups where poss >= 15")
def _(t: Tables) -> DataFrame:
    return t.lineups.where("poss >= 15").select("game", r(F.col("poss") / 10).alias("pace"), F.greatest("poss", F.lit(15.0)).alias("seconds"))


@query("lam67_slot_leverage", """select season, player, round(100 * (sum(pts) / sum(poss) - any_value(rate)) / any_value(rate), 4) as wosa_off, round(100 * (sum(lost) / sum(poss) - any_value(loss)), 4) as wosa_def, round(avg(poss) - any_value(pace), 4) as wosa_pace,
  round(sum(poss * abs(poss - pace)) / sum(poss), 4) as leverage, round(sum(greatest(poss - pace, 0)), 4) as above_bar from (
  select season, unnest(lineup) as player, poss, pts, lost, avg(poss) over s as pace, sum(pts) over s / sum(poss) over s as rate, sum(lost) over s / sum(poss) over s as loss from (
  select l.*, coalesce(r.lost, 0) as lost from lineups l left join (select game, sum(poss) as lost from fact where flag = 'R' group by 1) r on l.game = r.game) window s as (partition by season)) group by all""")
def _(t: Tables) -> DataFrame:
    """Five columns over a player's games: attack, defence and pace against the season's games, leverage, and possessions above the season's mean game."""
    lost = t.lines.where("flag = 'R'").groupBy("game").agg(F.sum("poss").alias("lost"))
    games = t.lineups.join(lost, "game", "left").withColumn("lost", F.coalesce("lost", F.lit(0.0)))
    level = games.groupBy("season").agg(F.avg("poss").alias("pace"), (F.sum("pts") / F.sum("poss")).alias("rate"), (F.sum("lost") / F.sum("poss")).alias("loss"))
    slots = games.join(F.broadcast(level), "season").withColumn("player", F.explode("lineup"))
    own = lambda c: F.sum(c) / F.sum("poss")
    return slots.groupBy("season", "player").agg(
        r(100 * (own("pts") - F.first("rate")) / F.first("rate")).alias("wosa_off"), r(100 * (own("lost") - F.first("loss"))).alias("wosa_def"), r(F.avg("poss") - F.first("pace")).alias("wosa_pace"),
        r(F.sum(F.col("poss") * F.abs(F.col("poss") - F.col("pace"))) / F.sum("poss")).alias("leverage"), r(F.sum(F.greatest(F.col("poss") - F.col("pace"), F.lit(0.0)))).alias("above_bar"),
    )


@query("lam78_posterior_sd")
def _(t: Tables) -> DataFrame:
    found = L.ridge(equations(t), "season", 5000.0, sd=True)
    return found.where("i > 0").groupBy("season").agg(r(F.min("sd"), 6).alias("least"), r(F.max("sd"), 6).alias("most"))


@query("lam87_unseen_weights", "select customer, round(1.0 / len(list_filter([1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002], lambda y: not list_contains(list(distinct season), y))), 6) as weight from fact group by 1".replace("list_contains(list(distinct season), y)", "list_contains(s, y)").replace("from fact group by 1", "from (select customer, list(distinct season) as s from fact group by 1)"))
def _(t: Tables) -> DataFrame:
    own = t.played.groupBy("customer").agg(F.collect_set("season").alias("s"))
    unseen = F.size(F.filter(F.array(*map(F.lit, range(1995, 2003))), lambda y: ~F.array_contains("s", y)))
    return own.select("customer", r(1.0 / unseen, 6).alias("weight"))


@query("chk02_team_residuals", """select game, player, line, part, round(poss - m - coalesce(x / nullif(xx, 0), 0) * d, 6) as residual from (select *, sum(d * (poss - m)) over () as x, sum(d * d) over () as xx from (
  select *, avg(poss) over (partition by team) as m, (phase = 'PO')::int - avg((phase = 'PO')::int) over (partition by team) as d from fact))""")
def _(t: Tables) -> DataFrame:
    """Least squares on team levels and playoffs: team means are taken off both, then one slope, from sums, is."""
    team = Window.partitionBy("team")
    rows = t.fact.select("game", "player", "line", "part", (F.col("poss") - F.avg("poss").over(team)).alias("y"), ((F.col("phase") == "PO").cast("int") - F.avg((F.col("phase") == "PO").cast("int")).over(team)).alias("d"))
    slope = rows.agg(F.coalesce(F.sum(F.col("d") * F.col("y")) / F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0)), F.lit(0.0)).alias("slope"))
    return rows.join(F.broadcast(slope)).select("game", "player", "line", "part", r(F.col("y") - F.col("slope") * F.col("d"), 6).alias("residual"))


@query("chk05_paired_z", "select round(avg(d) / greatest(stddev_samp(d) / sqrt(count(*)), 0.05), 4) as z, count(*) as seasons from (select season, avg(poss) filter (where flag = 'A') - avg(poss) filter (where flag = 'N') as d from fact group by 1)")
def _(t: Tables) -> DataFrame:
    mean = lambda f: F.avg(F.when(F.col("flag") == f, F.col("poss")))
    gaps = t.played.groupBy("season").agg((mean("A") - mean("N")).alias("d"))
    return gaps.agg(r(F.avg("d") / F.greatest(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.05))).alias("z"), F.count("*").alias("seasons"))


@query("chk13_permutation_null", "select seed, round(avg(v) filter (where k % 2 = 0) - avg(v) filter (where k % 2 = 1), 6) as gap from (select seed, v, row_number() over (partition by season, seed order by ((game + 1) * 2654435761 + seed * 40503 * (game % 97 + 1)) % 4294967296, game) as k from g, (select unnest(range(20)) as seed)) group by 1",
       "g as (select season, game, sum(poss)::double as v from fact group by all)")
def _(t: Tables) -> DataFrame:
    """The gap between two halves of each season's games under twenty permutations inside the season."""
    games = t.played.groupBy("season", "game").agg(F.sum("poss").alias("v")).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    mixed = F.pmod((F.col("game") + 1) * 2654435761 + F.col("seed") * 40503 * (F.col("game") % 97 + 1), F.lit(1 << 32))
    flagged = games.select("seed", "v", (F.row_number().over(Window.partitionBy("season", "seed").orderBy(mixed, "game")) % 2).alias("flag"))
    return flagged.groupBy("seed").agg(r(F.avg(F.when(F.col("flag") == 0, F.col("v"))) - F.avg(F.when(F.col("flag") == 1, F.col("v"))), 6).alias("gap"))


@query("chk15_clustered_z", "select round(sum(s) / sqrt(sum(s * s)), 4) as z, count(*) as clusters from (select customer, sum(poss - 25.5) as s from fact group by 1)")
def _(t: Tables) -> DataFrame:
    clusters = t.played.groupBy("customer").agg(F.sum(F.col("poss") - 25.5).alias("s"))
    return clusters.agg(r(F.sum("s") / F.sqrt(F.sum(F.col("s") * F.col("s")))).alias("z"), F.count("*").alias("clusters"))


@query("chk19_last_n_as_of", "select team, game, count(*) over w as n, round(avg(poss) over w, 4) as mean from (select team, day, game, sum(poss) as poss from fact group by all) window w as (partition by team order by day, game rows between 10 preceding and 1 preceding)")
def _(t: Tables) -> DataFrame:
    games = t.fact.groupBy("team", "day", "game").agg(F.sum("poss").alias("poss"))
    before = Window.partitionBy("team").orderBy("day", "game").rowsBetween(-10, -1)
    return games.select("team", "game", F.count("*").over(before).alias("n"), r(F.avg("poss").over(before)).alias("mean"))


@query("lam37_line_of_own_fold", "select player, season, round(m.a + m.b * p.poss, 4) as fitted from player_season p join (select f.fold, regr_intercept(q.pts / q.poss, q.poss) as a, regr_slope(q.pts / q.poss, q.poss) as b from (select unnest(range(3)) as fold) f join player_season q on q.player * 2654435761 % 4294967296 % 3 <> f.fold group by 1) m on m.fold = p.player * 2654435761 % 4294967296 % 3")
def _(t: Tables) -> DataFrame:
    """Each player's fit by the line of the other folds: sums of the whole less the fold's own."""
    rows = t.player_season.withColumn("fold", Q.arithmetic_fold(F.col("player"), 3)).withColumn("y", F.col("pts") / F.col("poss"))
    x, y = F.col("poss"), F.col("y")
    sums = rows.groupBy("fold").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    every = Window.partitionBy(F.lit(0))
    rest = sums.select("fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    lines = rest.select("fold", slope.alias("b"), (F.col("y") / F.col("n") - slope * F.col("x") / F.col("n")).alias("a"))
    return rows.join(F.broadcast(lines), "fold").select("player", "season", r(F.col("a") + F.col("b") * F.col("poss")).alias("fitted"))


@query("lam40_prior_parts", "select season, player, round(pts / poss - sum(pts) over w / sum(poss) over w, 4) as own, round(sum(pts) over w / sum(poss) over w, 4) as context from player_season window w as (partition by season, team)")
def _(t: Tables) -> DataFrame:
    team = Window.partitionBy("season", "team")
    context = F.sum("pts").over(team) / F.sum("poss").over(team)
    return t.player_season.select("season", "player", r(F.col("pts") / F.col("poss") - context).alias("own"), r(context).alias("context"))


@query("lam58_penalty_sweep", "select season, 3::bigint as penalties, true as shrinking from design group by 1", _DESIGN)
def _(t: Tables) -> DataFrame:
    """More penalty, smaller deviations, on equations formed once."""
    formed = equations(t)
    parts = [L.ridge(formed, "season", p).where("i > 0").groupBy("season").agg(F.sum(F.col("beta") * F.col("beta")).alias("size")).withColumn("penalty", F.lit(p)) for p in (500.0, 5000.0, 50000.0)]
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("penalty", "size"))), lambda x: x["size"])
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("season").agg(sizes.alias("s"))
    return every.select("season", F.size("s").cast("long").alias("penalties"), ((F.col("s")[0] > F.col("s")[1]) & (F.col("s")[1] > F.col("s")[2])).alias("shrinking"))


@query("lam60_rating_over_share", "select game, round(sum(coalesce(q.pts / q.poss, 0) * l.share), 4) as strength from (select season, game, player, sum(poss) / sum(sum(poss)) over (partition by game) as share from fact group by season, game, player) l left join (select season, player, sum(pts) as pts, sum(poss) as poss from fact group by all) q on l.player = q.player and l.season = q.season + 1 group by 1")
def _(t: Tables) -> DataFrame:
    rate = t.played.groupBy((F.col("season") + 1).alias("season"), "player").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    own = t.played.groupBy("season", "game", "player").agg(F.sum("poss").alias("p"))
    share = own.withColumn("share", F.col("p") / F.sum("p").over(Window.partitionBy("game")))
    return share.join(rate, ["season", "player"], "left").groupBy("game").agg(r(F.sum(F.coalesce("rate", F.lit(0.0)) * F.col("share"))).alias("strength"))


@query("lam62_held_out_summary", """select season, round(sum(w * e * e) / sum(w) / 1e6, 6) as mse, round(sum(w * b * b) / sum(w) / 1e6, 6) as base, round(avg(known), 6) as coverage from (select g.season, g.w, g.y - coalesce(q.x, l.lv) as e, g.y - l.lv as b, (q.x is not null)::int as known from
  (select season, game, sum(poss) as w, sum(pts) / sum(poss) as y, min(player) as player from fact where game % 5 = 0 group by all) g join (select season, sum(pts) / sum(poss) as lv from fact where game % 5 <> 0 group by 1) l on g.season = l.season left join (select season, player, sum(pts) / sum(poss) as x from fact where game % 5 <> 0 group by all) q on g.season = q.season and g.player = q.player) group by 1""")
def _(t: Tables) -> DataFrame:
    fit, held = t.played.where("game % 5 <> 0"), t.played.where("game % 5 = 0")
    games = held.groupBy("season", "game").agg(F.sum("poss").alias("w"), (F.sum("pts") / F.sum("poss")).alias("y"), F.min("player").alias("player"))
    sums = fit.groupBy("season", "player").agg(F.sum("pts").alias("a"), F.sum("poss").alias("b"))
    level = sums.groupBy("season").agg((F.sum("a") / F.sum("b")).alias("lv"))
    rows = games.join(F.broadcast(level), "season").join(sums.select("season", "player", (F.col("a") / F.col("b")).alias("x")), ["season", "player"], "left")
    e, b = F.col("y") - F.coalesce("x", "lv"), F.col("y") - F.col("lv")
    error = lambda v: r(F.sum(F.col("w") * v * v) / F.sum("w") / 1e6, 6)
    return rows.groupBy("season").agg(error(e).alias("mse"), error(b).alias("base"), r(F.avg(F.col("x").isNotNull().cast("int")), 6).alias("coverage"))


@query("lam70_points_per_win_weighted", "select round(1 / (sum(w * x * y) / sum(w * x * x)), 6) as per_win from (select games as w, pts / poss / 1000 - 1.5 as x, games / 100.0 as y from player_season)")
def _(t: Tables) -> DataFrame:
    w, x, y = F.col("games"), F.col("pts") / F.col("poss") / 1000 - 1.5, F.col("games") / 100.0
    return t.player_season.agg(r(1 / (F.sum(w * x * y) / F.sum(w * x * x)), 6).alias("per_win"))


@query("lam76_grouped_contributions", "select player, flag, round(sum(poss * (pts / poss - 1400)) / 1000, 4) as part from fact group by all")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("player", "flag").agg(r(F.sum(F.col("poss") * (F.col("pts") / F.col("poss") - 1400)) / 1000).alias("part"))


@query("chk03_error_by_slice", "select season, phase, round(sqrt(sum(poss * (pts / poss / 1000 - 1.5) * (pts / poss / 1000 - 1.5)) / sum(poss)), 6) as error from fact group by all")
def _(t: Tables) -> DataFrame:
    e = F.col("pts") / F.col("poss") / 1000 - 1.5
    return t.played.groupBy("season", "phase").agg(r(F.sqrt(F.sum(F.col("poss") * e * e) / F.sum("poss")), 6).alias("error"))


@query("chk12_calibration_out_of_fold", "select bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as seen from (select x.y, m.p, floor(m.p * 20)::bigint as bin from (select game, player, (flag = 'A')::int as y, game % 3 as fold from fact) x join (select f.fold, q.player, avg((q.flag = 'A')::int) as p from (select unnest(range(3)) as fold) f join fact q on q.game % 3 <> f.fold group by all) m on m.fold = x.fold and m.player = x.player) group by 1")
def _(t: Tables) -> DataFrame:
    """A player's share in the other folds against what their own fold saw: totals less the fold's own."""
    own = t.lines.withColumn("fold", F.col("game") % 3).groupBy("player", "fold").agg(F.count_if(F.col("flag") == "A").alias("a"), F.count("*").alias("n"))
    over = Window.partitionBy("player")
    rest = own.select("a", "n", ((F.sum("a").over(over) - F.col("a")) / F.nullif(F.sum("n").over(over) - F.col("n"), F.lit(0))).alias("p")).where("p is not null")
    bins = rest.groupBy(F.floor(F.col("p") * 20).alias("bin"))
    return bins.agg(F.sum("n").alias("n"), r(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("predicted"), r(F.sum("a") / F.sum("n"), 6).alias("seen"))
