"""Further features, sources, filters and aggregates (SCL, SRC, FLT, JOI, AGG, WIN, SRT, SET, TIM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.functions import text as X
from stintforge.operators import moments as M
from stintforge.operators import relations as R
from stintforge.plans.registry import query
from stintforge.plans.relational import r
from stintforge.sources import stores, synthetic
from stintforge.sources.tables import Tables

# ---- sources and sinks


@query("src05_box_score", "select game, player, count(*) as n, count(*) filter (where flag <> 'N') as made, sum(poss)::double as poss from fact group by all")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("game", "player").agg(F.count("*").alias("n"), F.count_if(F.col("flag") != "N").alias("made"), F.sum("poss").alias("poss"))


@query("src06_period_box", "select game, player, count(*) as n, round(sum(pts), 4) as pts from fact where part * 37 % 28800 >= 7200 and part * 37 % 28800 < 14400 group by all")
def _(t: Tables) -> DataFrame:
    """The box of the second period: its range of tenths of a second is a scalar expression, and the filter a range."""
    period, tenths = F.lit(2), F.col("part") * 37 % 28800
    return t.lines.where((tenths >= (period - 1) * 7200) & (tenths < period * 7200)).groupBy("game", "player").agg(F.count("*").alias("n"), r(F.sum("pts")).alias("pts"))


@query("src16_csv_scan", "select p_partkey, p_name || ', \"' || p_brand || '\"' as label, case when p_size % 7 = 0 then null else p_size end as size from part")
def _(t: Tables) -> DataFrame:
    """Commas, quotes and missing numbers survive a CSV file read with a declared schema."""
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    rows = t.part.select("p_partkey", label.alias("label"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"))
    return stores.round_trip(rows, "csv")


@query("src23_checked_folds", "select (game % 5)::int as fold, count(distinct game) as games, round(sum(poss), 4) as poss from fact group by 1")
def _(t: Tables) -> DataFrame:
    """Stored folds are read only if every game is in one of them."""
    store = stores.PartitionStore(t.spark, "fold").upsert(t.fact.select((F.col("game") % 5).cast("int").alias("fold"), "game", "poss"))
    rows = store.read()
    twice = rows.groupBy("game").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).where("a <> b")
    fault = F.when(F.count("*") > 0, F.raise_error(F.lit("a game is in two folds")).cast("int")).otherwise(0)
    return rows.join(F.broadcast(twice.agg(fault.alias("fault")))).where("fault = 0").groupBy("fold").agg(F.countDistinct("game").alias("games"), r(F.sum("poss")).alias("poss"))


@query("src27_stored_equations", "select season, count(*) as n, round(sum(pts * poss), 0) as cross_sum from player_season group by 1")
def _(t: Tables) -> DataFrame:
    """Sums for later fits are stored by season, and one season's are replaced without touching the others."""
    sums = t.player_season.groupBy("season").agg(F.count("*").alias("n"), r(F.sum(F.col("pts") * F.col("poss")), 0).alias("cross_sum"))
    store = stores.PartitionStore(t.spark, "season").upsert(sums.withColumn("n", -F.col("n")))
    return store.upsert(sums).read().select("season", "n", "cross_sum")


@query("src29_dereferenced_json", "select p_partkey, p_name as name, p_size::bigint as size from part")
def _(t: Tables) -> DataFrame:
    """A JSON list whose first entry holds, by name, the places of the values in the same list."""
    text = F.concat(F.lit('[{"name":1,"size":2},'), F.to_json(F.struct("p_name")).substr(F.lit(11), F.length(F.to_json(F.struct("p_name"))) - 11), F.lit(","), F.col("p_size").cast("string"), F.lit("]"))
    rows = t.part.select("p_partkey", F.from_json(text, "array<string>").alias("e"))
    at = rows.withColumn("at", F.from_json(F.col("e")[0], "name int, size int"))
    return at.select("p_partkey", F.get("e", F.col("at.name")).alias("name"), F.get("e", F.col("at.size")).cast("long").alias("size"))


@query("src38_documents_by_season", "select season, count(*) as n from player_season where season >= 1996 group by 1")
def _(t: Tables) -> DataFrame:
    """A JSON folder a season; a season that the new run does not have loses its old folder."""
    place = stores.shared_folder(t.spark)
    rows = t.player_season.select("season", "player", r("poss").alias("poss"))
    for kept in (rows, rows.where("season >= 1996")):
        kept.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("season").json(place)
    return t.spark.read.schema("player long, poss double, season int").json(place).groupBy("season").agg(F.count("*").alias("n"))


@query("src39_coordinate_matrix", "select game, count(*) as entries, round(sum(v * x), 4) as product from (select game, player, sum(poss) as v, player % 7 as x from fact group by game, player) group by 1")
def _(t: Tables) -> DataFrame:
    """A sparse matrix stored as coordinates with its column keys beside it, then multiplied by a vector."""
    entries = t.lines.groupBy("game", "player").agg(F.sum("poss").alias("v"))
    keys = entries.select("player").distinct().withColumn("col", F.dense_rank().over(Window.orderBy("player")) - 1)
    matrix = stores.round_trip(entries.join(keys, "player").select("game", "col", "v"), "parquet")
    names = stores.round_trip(keys, "parquet")
    back = matrix.join(names, "col").withColumn("x", F.col("player") % 7)
    return back.groupBy("game").agg(F.count("*").alias("entries"), r(F.sum(F.col("v") * F.col("x"))).alias("product"))


_DIFF = """a as (select * from player_season where season <> 1997), b as (select season, team, player, case when player % 10 = 0 then poss + 2 else poss end as poss, games from player_season where season <> 1996),
j as (select coalesce(a.season, b.season) as s, a.player as pa, b.player as pb, a.poss as x, b.poss as y, a.games as gx, b.games as gy from a full join b on a.season = b.season and a.player = b.player)"""


@query("src40_table_diff", """select name, only_left, only_right, differ, most from (select 'poss' as name, count(*) filter (where pb is null) as only_left, count(*) filter (where pa is null) as only_right, count(*) filter (where x <> y) as differ, max(abs(x - y)) as most from j
  union all select 'games', count(*) filter (where pb is null), count(*) filter (where pa is null), count(*) filter (where gx <> gy), max(abs(gx - gy))::double from j)""", _DIFF)
def _(t: Tables) -> DataFrame:
    rows = t.player_season
    changed = rows.where("season <> 1996").withColumn("poss", F.when(F.col("player") % 10 == 0, F.col("poss") + 2).otherwise(F.col("poss"))).drop("pts")
    return R.table_diff(rows.where("season <> 1997"), changed, ["season", "player"], ("team",))


@query("src41_synthetic_league", """select player, round(truth, 6) as truth, count(*) as games, round(avg(y), 5) as y from (select s.game, s.side, s.player, s.truth, t.y from seated s join (select game, side, sum(truth) + ((((game * 2 + side + 99) % 1048576) * 2654435761 + 12345) % 4294967296 / 4294967296.0::double - 0.5) / 10 as y from seated group by game, side) t on s.game = t.game and s.side = t.side) group by player, truth""",
    """slots as (select g.game, unnest(range(10)) as slot from (select unnest(range(3000)) as game) g), seated as (select distinct game, slot // 5 as side, player, ((player + 777) * 2654435761 + 12345) % 4294967296 / 4294967296.0::double - 0.5 as truth from (
  select game, slot, ((floor(((game * 131 + slot * 7) % 1048576 * 2654435761 + 12345) % 4294967296 / 4294967296.0::double * 200)::bigint + slot * 17) % 200)::bigint as player from slots))""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """Every player's known truth beside the mean result of their sides."""
    made = synthetic.league(t.spark, 3000, 200)
    return made.groupBy("player", r("truth", 6).alias("truth")).agg(F.count("*").alias("games"), r(F.avg("y"), 5).alias("y"))


# ---- filters, joins, aggregates, order


@query("flt16_other_target", "select season, round(sum(w * y) / sum(w), 4) as mean from (select season, poss * 2 as w, ln(pts / poss) as y from player_season) group by 1")
def _(t: Tables) -> DataFrame:
    """The same design with another response and weight."""
    rows = t.player_season.select("season", (F.col("pts") / F.col("poss")).alias("y"), F.col("poss").alias("w"))
    swapped = rows.withColumns({"y": F.log("y"), "w": F.col("w") * 2})
    return swapped.groupBy("season").agg(r(F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"))


@query("flt23_eligible", "select p.season, p.player, case when q.games >= 50 then 'full' when q.games >= 20 then 'part' else 'none' end as tier from player_season p left join (select player, sum(games) as games from player_season group by 1) q on p.player = q.player where p.games >= 3 and p.poss >= 100")
def _(t: Tables) -> DataFrame:
    quality = t.player_season.groupBy("player").agg(F.sum("games").alias("all_games"))
    tier = F.when(F.col("all_games") >= 50, "full").when(F.col("all_games") >= 20, "part").otherwise("none")
    return t.player_season.where("games >= 3 and poss >= 100").join(quality, "player", "left").select("season", "player", tier.alias("tier"))


@query("joi20_aligned_prior", "select p.season, p.player, coalesce(round(q.pts / q.poss, 4), 0)::double as prior from player_season p left join player_season q on p.player = q.player and p.season = q.season + 1 and q.player % 4 <> 0")
def _(t: Tables) -> DataFrame:
    """Last season's rate, where it is known (here: not for every fourth player); 0 else."""
    known = t.player_season.where("player % 4 <> 0").select((F.col("season") + 1).alias("season"), "player", r(F.col("pts") / F.col("poss")).alias("rate"))
    return t.player_season.join(known, ["season", "player"], "left").select("season", "player", F.coalesce("rate", F.lit(0.0)).alias("prior"))


@query("agg29_foul_counts", "select season, player, count(*) filter (where flag = 'R') as personal, count(*) filter (where flag = 'R' and status = 'F') as shooting, count(*) filter (where flag = 'A') as drawn, count(*) filter (where flag = 'N' and poss > 40) as technical, count(*) filter (where status = 'O' and poss < 5) as loose from fact group by all")
def _(t: Tables) -> DataFrame:
    rules = {"personal": "flag = 'R'", "shooting": "flag = 'R' and status = 'F'", "drawn": "flag = 'A'", "technical": "flag = 'N' and poss > 40", "loose": "status = 'O' and poss < 5"}
    return t.played.groupBy("season", "player").agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()])


@query("agg61_pace", "select season, round(sum(poss) / sum(games), 6) as pace from player_season group by 1")
def _(t: Tables) -> DataFrame:
    return t.player_season.groupBy("season").agg(r(F.sum("poss") / F.sum("games"), 6).alias("pace"))


@query("win04_halves_at_build", "select half, phase, count(*) as games from (select game, phase, case when row_number() over (partition by season, phase order by day, game) % 2 = 1 then 'A' else 'B' end as half from (select game, any_value(season) as season, any_value(phase) as phase, any_value(day) as day from fact group by 1)) group by all")
def _(t: Tables) -> DataFrame:
    games = t.played.groupBy("game").agg(F.max("season").alias("season"), F.max("phase").alias("phase"), F.max("day").alias("day"))
    place = F.row_number().over(Window.partitionBy("season", "phase").orderBy("day", "game"))
    return games.withColumn("half", F.when(place % 2 == 1, "A").otherwise("B")).groupBy("half", "phase").agg(F.count("*").alias("games"))


@query("win22_recentred", "select season, player, round(x - sum(x * games) over w / sum(games) over w, 4) as x from (select *, pts / poss as x from player_season) window w as (partition by season)")
def _(t: Tables) -> DataFrame:
    rows = t.player_season.withColumn("x", F.col("pts") / F.col("poss"))
    return rows.select("season", "player", r(M.centred(rows, ["season"], "x", "games")).alias("x"))


def nearest_seasons(seasons: DataFrame, n: int, reach: int = 40, apart: int = 1) -> DataFrame:
    """(season, other, place): the n nearest other seasons at least ``apart`` away, the earlier one first on ties.

    Candidates come from a bounded sequence of years around each season, by an equality join.
    """
    asked = seasons.select("season", F.explode(F.sequence(F.col("season") - reach, F.col("season") + reach)).alias("other")).where(F.abs(F.col("other") - F.col("season")) >= apart)
    found = asked.join(seasons.select(F.col("season").alias("other")), "other", "left_semi")
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.abs(F.col("other") - F.col("season")), "other"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("season", "other", "place")


@query("srt11_nearest_seasons", "select season, other, place::int as place from (select a.season, b.season as other, row_number() over (partition by a.season order by abs(a.season - b.season), b.season) as place from (select distinct season from fact) a, (select distinct season from fact) b where abs(a.season - b.season) >= 2) where place <= 3")
def _(t: Tables) -> DataFrame:
    return nearest_seasons(t.fact.select("season").distinct(), 3, apart=2)


@query("set10_panel_filled", "select season, player, round(coalesce(x, avg(x) over ()), 4) as x from (select season, player, case when games >= 3 then pts / poss end as x from player_season where season in (1995, 1996, 1997))")
def _(t: Tables) -> DataFrame:
    """Season panels in one union; a missing input takes the mean of all seasons, found in one aggregate."""
    panel = lambda s: t.player_season.where(F.col("season") == s).select("season", "player", F.when(F.col("games") >= 3, F.col("pts") / F.col("poss")).alias("x"))
    rows = panel(1995).unionByName(panel(1996)).unionByName(panel(1997))
    mean = rows.agg(F.avg("x").alias("mean"))
    return rows.join(F.broadcast(mean)).select("season", "player", r(F.coalesce("x", "mean")).alias("x"))


# ---- scalars


@query("scl03_substitute_names")
def _(t: Tables) -> DataFrame:
    """A name on a substitution line to a roster id: by key, then by a family name that is unique, then by likeness."""
    roster = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    asked = roster.select(F.when(F.col("id") % 3 == 0, F.upper("name")).when(F.col("id") % 3 == 1, F.substring_index("name", " ", -1)).otherwise(F.regexp_replace("name", "[aeiou]", "")).alias("asked")).distinct()
    keyed = roster.withColumn("key", S.name_key(F.col("name"))).withColumn("family", F.substring_index("key", " ", -1))
    by_key = keyed.groupBy("key").agg(F.min("id").alias("id"))
    by_family = keyed.groupBy(F.col("family").alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    want = asked.withColumn("key", S.name_key(F.col("asked")))
    first = want.join(by_key, "key").select("asked", "id", F.lit("key").alias("rule"))
    left = want.join(by_key, "key", "left_anti")
    second = left.join(by_family, "key").select("asked", "id", F.lit("family").alias("rule"))
    third = X.fuzzy(left.join(by_family, "key", "left_anti").select("asked"), roster.select("name"), 0.75).join(roster, "name").select("asked", "id", F.lit("likeness").alias("rule"))
    return first.unionByName(second).unionByName(third)


@query("scl07_match_key", "select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as key from customer")
def _(t: Tables) -> DataFrame:
    spoilt = F.concat(F.regexp_replace("c_name", "#", " .#' "), F.when(F.col("c_custkey") % 3 == 0, " Jr.").otherwise(""))
    return t.customer.select("c_custkey", F.replace(S.name_key(spoilt), F.lit(" "), F.lit("")).alias("key"))


@query("scl08_clock_to_number", "select p_partkey, (p_partkey % 12 * 60 + p_size)::double as seconds from part")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("PT"), (F.col("p_partkey") % 12).cast("string"), F.lit("M"), F.col("p_size").cast("string"), F.lit("S"))
    return t.part.select("p_partkey", S.clock_seconds(text).alias("seconds"))


@query("scl19_era_kernel", "select a.season as rated, b.season, round(power(0.5, greatest(abs(a.season - b.season) - 1, 0) / 2.5), 6) as weight from (select distinct season from fact) a, (select distinct season from fact) b")
def _(t: Tables) -> DataFrame:
    seasons = t.played.select("season").distinct()
    pairs = seasons.select(F.col("season").alias("rated"), F.explode(F.sequence(F.col("season") - 40, F.col("season") + 40)).alias("season")).join(seasons, "season", "left_semi")
    return pairs.select("rated", "season", r(S.half_life(F.col("season") - F.col("rated"), 2.5, 1.0), 6).alias("weight"))


@query("scl21_blended_scale", "select season, round(0.3 * avg(pts / poss) + 0.7 * sum(pts) / sum(poss), 4) as scale from player_season group by 1")
def _(t: Tables) -> DataFrame:
    held, fitted, weight = F.avg(F.col("pts") / F.col("poss")), F.sum("pts") / F.sum("poss"), 0.3
    return t.player_season.groupBy("season").agg(r(weight * held + (1 - weight) * fitted).alias("scale"))


@query("scl28_ratio_against_league", "select season, player, round((made + 40 * lm / ln_) / (n + 40) - (lm + 40 * lm / ln_) / (ln_ + 40), 6) as above from (select *, sum(made) over w as lm, sum(n) over w as ln_ from (select season, player, count(*) filter (where flag <> 'N') as made, count(*) as n from fact group by all) window w as (partition by season))")
def _(t: Tables) -> DataFrame:
    """A padded ratio less the league's under the same padding."""
    own = t.played.groupBy("season", "player").agg(F.count_if(F.col("flag") != "N").alias("made"), F.count("*").alias("n"))
    league = Window.partitionBy("season")
    made, n = F.sum("made").over(league), F.sum("n").over(league)
    padded = lambda m, k: (m + 40 * made / n) / (k + 40)
    return own.select("season", "player", r(padded(F.col("made"), F.col("n")) - padded(made, n), 6).alias("above"))


_SPOTS = """spots as (select season, player, sum((part % 3 = 0)::int) as m0, sum((part % 3 = 1)::int) as m1, sum((part % 3 = 2)::int) as m2, sum((part % 3 = 0 and flag = 'R')::int) as a0, sum((part % 3 = 1 and flag = 'R')::int) as a1, sum((part % 3 = 2 and flag = 'R')::int) as a2, count(*) / 9.0 as e from fact group by all)"""


@query("scl30_unassisted_estimate", "select season, player, round(m0 - least((a0 + 0.5) / (e + 0.5) * e, m0) + m1 - least((a1 + 0.5) / (e + 0.5) * e, m1) + m2 - least((a2 + 0.5) / (e + 0.5) * e, m2), 6) as own from spots", _SPOTS)
def _(t: Tables) -> DataFrame:
    """Of each spot group's misses, those that did not follow a pass: the expected passed ones scaled by the lean toward assists."""
    spot = lambda k, rule="true": F.count_if(F.expr(f"part % 3 = {k} and {rule}"))
    rows = t.played.groupBy("season", "player").agg(*[spot(k).alias(f"m{k}") for k in range(3)], *[spot(k, "flag = 'R'").alias(f"a{k}") for k in range(3)], (F.count("*") / 9.0).alias("e"))
    own = [F.col(f"m{k}") - F.least((F.col(f"a{k}") + 0.5) / (F.col("e") + 0.5) * F.col("e"), F.col(f"m{k}")) for k in range(3)]
    return rows.select("season", "player", r(own[0] + own[1] + own[2], 6).alias("own"))


@query("scl31_shot_quality", """select season, player, round((x2 + 50 * l2) / (n2 + 50), 6) as expected2, round((m2 - x2) / (n2 + 250), 6) as over2, round((2 * x2 + 3 * x3 + 100 * 1.1) / (n2 + n3 + 100), 6) as per_shot, round((x3 + 50 * l3) / (n3 + 50), 6) as expected3, round((m3 - x3) / (n3 + 450), 6) as over3, round((2 * (m2 - x2) + 3 * (m3 - x3)) / (n2 + n3 + 300), 6) as over_per_shot from (
  select *, sum(m2) over w / sum(n2) over w as l2, sum(m3) over w / sum(n3) over w as l3 from (select season, player, count(*) filter (where poss <= 35) as n2, count(*) filter (where poss > 35) as n3, count(*) filter (where poss <= 35 and flag <> 'N') as m2, count(*) filter (where poss > 35 and flag <> 'N') as m3, count(*) filter (where poss <= 35) * 0.48 as x2, count(*) filter (where poss > 35) * 0.35 as x3 from fact group by all) window w as (partition by season))""")
def _(t: Tables) -> DataFrame:
    kinds = {"2": "poss <= 35", "3": "poss > 35"}
    tries = [F.count_if(F.expr(rule)).alias(f"n{k}") for k, rule in kinds.items()]
    made = [F.count_if(F.expr(f"{rule} and flag <> 'N'")).alias(f"m{k}") for k, rule in kinds.items()]
    rows = t.played.groupBy("season", "player").agg(*tries, *made).withColumns({"x2": F.col("n2") * 0.48, "x3": F.col("n3") * 0.35})
    league = Window.partitionBy("season")
    rate = lambda k: F.sum(f"m{k}").over(league) / F.sum(f"n{k}").over(league)
    pad = lambda number, n, k, level: r((number + k * level) / (n + k), 6)
    two, three, every = F.col("n2"), F.col("n3"), F.col("n2") + F.col("n3")
    above = lambda k: F.col(f"m{k}") - F.col(f"x{k}")
    return rows.select(
        "season", "player", pad(F.col("x2"), two, 50, rate(2)).alias("expected2"), pad(above(2), two, 250, F.lit(0.0)).alias("over2"), pad(2 * F.col("x2") + 3 * F.col("x3"), every, 100, F.lit(1.1)).alias("per_shot"),
        pad(F.col("x3"), three, 50, rate(3)).alias("expected3"), pad(above(3), three, 450, F.lit(0.0)).alias("over3"), pad(2 * above(2) + 3 * above(3), every, 300, F.lit(0.0)).alias("over_per_shot"),
    )


@query("scl34_sigmoid", "select p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) as p from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r(S.sigmoid((F.col("p_size") - 25) / 10.0), 6).alias("p"))


@query("scl36_lead_kept", "select game, round(0.9 - 0.04 * (1 - count(*) / 8.0), 6) as kept from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("game").agg(r(0.9 - 0.04 * (1 - F.count("*") / 8.0), 6).alias("kept"))


@query("scl41_flat_share", "select game, player, sum(poss) / sum(sum(poss)) over (partition by game) < 0.25 as flat from fact group by game, player")
def _(t: Tables) -> DataFrame:
    own = t.lines.groupBy("game", "player").agg(F.sum("poss").alias("p"))
    return own.select("game", "player", (F.col("p") / F.sum("p").over(Window.partitionBy("game")) < 0.25).alias("flat"))


@query("scl49_pad_toward_level", """select season, player, round((poss * x + k * level) / (poss + k), 4) as padded from (select *, case when spread > 1e-12 then 900.0 / spread else 1e9 end as k from (
  select *, sum(poss * (x - level) * (x - level)) over w / sum(poss) over w - 900.0 * count(*) over w / sum(poss) over w as spread from (select season, player, poss, pts / poss as x, sum(pts) over (partition by season, team) / sum(poss) over (partition by season, team) as level from player_season) window w as (partition by season)))""")
def _(t: Tables) -> DataFrame:
    """Pad toward each row's own level, the pad from the spread beyond noise of known size."""
    team, season = Window.partitionBy("season", "team"), Window.partitionBy("season")
    rows = t.player_season.select("season", "player", "poss", (F.col("pts") / F.col("poss")).alias("x"), (F.sum("pts").over(team) / F.sum("poss").over(team)).alias("level"))
    gap = F.col("x") - F.col("level")
    spread = (F.sum(F.col("poss") * gap * gap).over(season) - 900.0 * F.count("*").over(season)) / F.sum("poss").over(season)
    k = F.when(spread > 1e-12, 900.0 / spread).otherwise(1e9)
    return rows.withColumn("k", k).select("season", "player", r(S.shrink(F.col("poss"), F.col("x"), F.col("k"), F.col("level"))).alias("padded"))


@query("scl54_expected_threes", "select f.season, f.player, count(*) as tries, round(sum(c.rate), 6) as expected from (select *, (part % 8)::int as spot from fact where poss > 35 and part % 24 <> 0) f join (select season, (part % 8)::int as spot, avg((flag <> 'N')::int) as rate from fact where poss > 35 and part % 24 <> 0 group by all) c on f.season = c.season and f.spot = c.spot group by all")
def _(t: Tables) -> DataFrame:
    """A make's chance at each spot, summed over a player's own tries, late heaves left out."""
    tries = t.played.where("poss > 35 and part % 24 <> 0").groupBy("season", "player", (F.col("part") % 8).cast("int").alias("spot")).agg(F.count("*").alias("n"), F.count_if(F.col("flag") != "N").alias("made"))
    cell = Window.partitionBy("season", "spot")
    rated = tries.withColumn("rate", F.sum("made").over(cell) / F.sum("n").over(cell))
    return rated.groupBy("season", "player").agg(F.sum("n").alias("tries"), r(F.sum(F.col("n") * F.col("rate")), 6).alias("expected"))


@query("scl56_rates_by_half", "select player, half, round((made + 25 * level) / (n + 25), 6) as rate, round(((made + 25 * level) / (n + 25)) / level, 6) as ratio from (select *, sum(made) over (partition by half) / sum(n) over (partition by half) as level from (select player, case when game % 2 = 0 then 'A' else 'B' end as half, count(*) filter (where flag <> 'N') as made, count(*) as n from fact group by all union all select player, 'ALL', count(*) filter (where flag <> 'N'), count(*) from fact group by player))")
def _(t: Tables) -> DataFrame:
    """Padded rates of each half and of both, and their ratio to the level, from one pass over the halves."""
    halves = t.lines.groupBy("player", F.when(F.col("game") % 2 == 0, "A").otherwise("B").alias("half")).agg(F.count_if(F.col("flag") != "N").alias("made"), F.count("*").alias("n"))
    both = halves.groupBy("player").agg(F.sum("made").alias("made"), F.sum("n").alias("n")).withColumn("half", F.lit("ALL"))
    rows = halves.unionByName(both)
    over = Window.partitionBy("half")
    rows = rows.withColumn("level", F.sum("made").over(over) / F.sum("n").over(over))
    rate = S.shrink(F.col("n"), F.col("made") / F.col("n"), 25.0, F.col("level"))
    return rows.select("player", "half", r(rate, 6).alias("rate"), r(rate / F.col("level"), 6).alias("ratio"))


@query("scl57_shooters_with_league", "select player, count(*) as n, count(*) filter (where flag <> 'N') as made, (select round(avg((flag <> 'N')::int), 6) from fact) as league from fact group by 1")
def _(t: Tables) -> DataFrame:
    """Totals of the players, with the level of all of them on every row (one row is broadcast)."""
    own = t.lines.groupBy("player").agg(F.count("*").alias("n"), F.count_if(F.col("flag") != "N").alias("made"))
    level = own.agg(r(F.sum("made") / F.sum("n"), 6).alias("league"))
    return own.join(F.broadcast(level)).select("player", "n", "made", "league")


_TIERS = "kept as (select season, player, (pts / poss - 1400) / 1000 as beta, poss / (poss + 3000) as s, case when poss < 100 then 0 when poss < 300 then 1 else 2 end as tier from player_season)"


@query("scl59_unshrunk", "select season, player, round(beta / greatest(s, 800 / 3800.0) + (1 - s / greatest(s, 800 / 3800.0)) * avg(beta) over w / avg(s) over w, 4) as label from kept window w as (partition by season, tier)", _TIERS)
def _(t: Tables) -> DataFrame:
    """A ridge coefficient over the share it kept, the share held at a least one, the rest from the player's tier."""
    tier = F.when(F.col("poss") < 100, 0).when(F.col("poss") < 300, 1).otherwise(2)
    rows = t.player_season.select("season", "player", ((F.col("pts") / F.col("poss") - 1400) / 1000).alias("beta"), (F.col("poss") / (F.col("poss") + 3000)).alias("s"), tier.alias("tier"))
    own = Window.partitionBy("season", "tier")
    held = F.greatest(F.col("s"), F.lit(800 / 3800.0))
    return rows.select("season", "player", r(F.col("beta") / held + (1 - F.col("s") / held) * F.avg("beta").over(own) / F.avg("s").over(own)).alias("label"))


@query("scl62_renamed", "select case flag when 'N' then 'none' when 'R' then 'returned' else flag end as name, count(*) as n from fact group by 1")
def _(t: Tables) -> DataFrame:
    names = F.create_map(F.lit("N"), F.lit("none"), F.lit("R"), F.lit("returned"))
    return t.lines.groupBy(F.coalesce(F.try_element_at(names, F.col("flag")), "flag").alias("name")).agg(F.count("*").alias("n"))


# ---- time


@query("tim07_last_good_state", "select season, count(*) as games from (select distinct season, game from fact where season <= 1996) group by 1")
def _(t: Tables) -> DataFrame:
    """A new state replaces the stored one only when its checks pass; here the second has a season without rows enough."""
    games = t.fact.select("season", "game").distinct().groupBy("season").agg(F.count("*").alias("games"))
    store = stores.PartitionStore(t.spark, "season")
    for state, least in ((games.where("season <= 1996"), 1), (games.where("season >= 1997"), 1 << 40)):
        if state.where(F.col("games") < least).isEmpty():
            store.upsert(state)
    return store.read().select("season", "games")


@query("tim09_season_in_progress", "select p.season, p.player, round(case when p.season = 1998 then m.rate * 0.75 + p.pts / p.poss * 0.25 else p.pts / p.poss end, 4) as rating from player_season p left join (select player, sum(pts) / sum(poss) as rate from player_season where season < 1998 group by 1) m on p.player = m.player where p.season in (1997, 1998) and (p.season < 1998 or m.rate is not null)")
def _(t: Tables) -> DataFrame:
    """The open season is rated with parameters of its share, and nothing is learned from it."""
    learned = t.player_season.where("season < 1998").groupBy("player").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    share = S.step_value(F.col("season"), [(1990, 1.0), (1998, 0.25)])
    rows = t.player_season.where(F.col("season").isin(1997, 1998)).join(learned, "player", "left").withColumn("share", share)
    own = F.col("pts") / F.col("poss")
    return rows.where("season < 1998 or rate is not null").select("season", "player", r(F.when(F.col("share") == 1, own).otherwise(F.col("rate") * (1 - F.col("share")) + own * F.col("share"))).alias("rating"))
