"""Scalar functions and derived features (SCL, and the text rules of FLT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.functions import text as X
from stintforge.operators import relations as R
from stintforge.plans.registry import query
from stintforge.plans.relational import masks, r, zone_masks
from stintforge.sources.tables import Tables

_CLOCK = "'PT' || lpad((p_partkey % 12)::varchar, 2, '0') || 'M' || lpad((p_size)::varchar, 2, '0') || '.00S'"


def clock_text() -> F.Column:
    return F.concat(F.lit("PT"), F.lpad((F.col("p_partkey") % 12).cast("string"), 2, "0"), F.lit("M"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".00S"))


@query("flt02_clock_seconds", f"select p_partkey, regexp_extract({_CLOCK}, 'PT(\\d+)M', 1)::double * 60 + regexp_extract({_CLOCK}, 'M([\\d.]+)S', 1)::double as seconds from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.clock_seconds(clock_text()).alias("seconds"))


@query("flt03_regulation_left", "select p_partkey, case when p_size % 6 + 1 <= 4 then (4 - (p_size % 6 + 1)) * 720 + p_partkey % 720 else 0 end::double as remaining from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.regulation_left(F.col("p_size") % 6 + 1, F.col("p_partkey") % 720).cast("double").alias("remaining"))


@query("flt05_made_from_text", "select p_partkey, (p_type || ' (' || p_size || ' PTS)') like '%PTS)' and p_type not like 'SMALL%' as made from part")
def _(t: Tables) -> DataFrame:
    line = F.concat("p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(" PTS)"))
    return t.part.select("p_partkey", (F.endswith(line, F.lit("PTS)")) & ~F.startswith("p_type", F.lit("SMALL"))).alias("made"))


@query("scl01_letters_only", "select p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') as key from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.letters_only(F.col("p_name")).alias("key"))


@query("scl02_first_token", "select token, count(*) as n from (select split_part(p_name, ' ', 1) as token from part) group by 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("token")).agg(F.count("*").alias("n"))


@query("scl04_fuzzy_match")
def _(t: Tables) -> DataFrame:
    """Best roster name for each misspelt one, by longest matching blocks; candidates share a first letter."""
    roster = t.part.select(F.col("p_name").alias("name")).distinct()
    asked = roster.select(F.regexp_replace("name", "[aeiou]", "").alias("asked")).distinct()
    return X.fuzzy(asked, roster, 0.6)


@query("scl05_name_suffix", "select c_custkey, trim(regexp_replace(lower(c_name || case when c_custkey % 3 = 0 then ' Jr.' else '' end), '[^a-z0-9]+', ' ', 'g')) as plain from customer where c_custkey % 3 <> 0")
def _(t: Tables) -> DataFrame:
    named = t.customer.select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " Jr.").otherwise("")).alias("n"))
    return named.where("c_custkey % 3 <> 0").select("c_custkey", S.name_key(F.col("n")).alias("plain"))


@query("scl09_minutes_text", "select p_partkey, (p_size + (p_partkey % 60) / 60.0)::double as minutes from part")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit(":"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"))
    return t.part.select("p_partkey", S.minutes(text).alias("minutes"))


@query("scl10_season_label", "select distinct season, (season - 1) || '-' || lpad((season % 100)::varchar, 2, '0') as label from fact")
def _(t: Tables) -> DataFrame:
    return t.played.select("season", S.season_label(F.col("season")).alias("label")).distinct()


@query("scl11_season_of_game", "select id, (case when (id // 100000) % 100 >= 90 then 1900 + (id // 100000) % 100 else 2000 + (id // 100000) % 100 end + 1)::int as season from (select o_orderkey * 7919 as id from orders)")
def _(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_orderkey") * 7919).alias("id")).select("id", S.season_of_game(F.col("id")).alias("season"))


@query("scl12_period_range", "select distinct line as period, case when line <= 4 then (line - 1) * 7200 else 28800 + (line - 5) * 3000 end::int as first, case when line <= 4 then line * 7200 else 28800 + (line - 4) * 3000 end::int as last from fact")
def _(t: Tables) -> DataFrame:
    p = F.col("line")
    first, last = F.when(p <= 4, (p - 1) * 7200).otherwise(28800 + (p - 5) * 3000), F.when(p <= 4, p * 7200).otherwise(28800 + (p - 4) * 3000)
    return t.lines.select(p.alias("period"), first.cast("int").alias("first"), last.cast("int").alias("last")).distinct()


@query("scl14_first_neutral_date", "select season, count(*) as n from fact where day >= make_date(season, 7, 1) group by 1")
def _(t: Tables) -> DataFrame:
    return t.played.where(F.col("day") >= F.make_date("season", F.lit(7), F.lit(1))).groupBy("season").agg(F.count("*").alias("n"))


@query("scl15_zero_pad", "select o_orderkey, lpad(o_orderkey::varchar, 10, '0') as id from orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"))


@query("scl16_range_lookup", "select team, season, count(*) as n, case when team = 3 and season between 1995 and 1997 then 103 when team = 3 then 203 else team end::int as franchise from fact group by team, season")
def _(t: Tables) -> DataFrame:
    moves = t.spark.createDataFrame([(3, 1995, 1997, 103), (3, 1998, 9999, 203)], "team int, first int, last int, moved int")
    n = t.fact.groupBy("team", "season").agg(F.count("*").alias("n")).alias("n")
    inside = (F.col("n.team") == F.col("m.team")) & F.col("season").between(F.col("first"), F.col("last"))
    return n.join(F.broadcast(moves.alias("m")), inside, "left").select("n.team", "season", "n", F.coalesce("moved", F.col("n.team")).alias("franchise"))


@query("scl17_step_function", "select distinct season, case when season >= 1999 then 0.84 when season >= 1996 then 0.89 else 1.0 end::double as factor from fact")
def _(t: Tables) -> DataFrame:
    return t.played.select("season", S.step_value(F.col("season"), [(1990, 1.0), (1996, 0.89), (1999, 0.84)]).alias("factor")).distinct()


@query("scl18_half_life", "select distinct season, round(pow(0.5, abs(season - 1998) / 2.0), 6) as weight, round(pow(0.5, greatest(abs(season - 1998) - 1, 0) / 2.0), 6) as delayed from fact")
def _(t: Tables) -> DataFrame:
    off = F.col("season") - 1998
    return t.played.select("season", r(S.half_life(off, 2.0), 6).alias("weight"), r(S.half_life(off, 2.0, 1.0), 6).alias("delayed")).distinct()


@query("scl20_ramp_blend", "select season, player, round(s * pts / poss + (1 - s) * 36000, 4) as blended from (select *, least(greatest((poss - 200) / 800.0, 0), 1) as s from player_season)")
def _(t: Tables) -> DataFrame:
    share = S.ramp(F.col("poss"), 200.0, 1000.0)
    return t.player_season.select("season", "player", r(share * F.col("pts") / F.col("poss") + (1 - share) * 36000).alias("blended"))


_PADDED = """league as (select season, sum(pts) / sum(poss) as rate from player_season group by 1),
edges as (select quantile_cont(poss, 0.01) as a, max(poss) as b from player_season),
bins as (select p.*, (select sum((p.poss > exp(ln(e.a) + i * (ln(e.b) - ln(e.a)) / 5))::int) from edges e, (select unnest([0, 1, 2, 3, 4]) as i))::int as bin from player_season p),
goals as (select season, bin, count(*) as n, sum(pts) / sum(poss) as rate from bins group by all),
pooled as (select bin, count(*) as n, sum(pts) / sum(poss) as rate from bins group by 1)"""


@query("scl22_padded_rate", """select b.season, b.team, b.player, b.bin, round((b.pts + 400 * case when g.n >= 5 then g.rate when p.n >= 5 then p.rate else l.rate end) / (b.poss + 400), 4) as padded
  from bins b join goals g on b.season = g.season and b.bin = g.bin join pooled p on b.bin = p.bin join league l on b.season = l.season""", _PADDED)
def _(t: Tables) -> DataFrame:
    """Rates padded toward their possession bin: of the season, else pooled, else the league (slice of the whole engine)."""
    rows = t.player_season
    edge = rows.agg(F.percentile("poss", F.lit(0.01)).alias("a"), F.max("poss").alias("b"))
    steps = F.array(*[F.exp(F.log("a") + i * (F.log("b") - F.log("a")) / 5) for i in range(5)])
    bins = rows.join(F.broadcast(edge.select(steps.alias("edges"))), F.size("edges") > 0).withColumn("bin", F.size(F.filter("edges", lambda e: F.col("poss") > e))).drop("edges")
    season, pooled, league = Window.partitionBy("season", "bin"), Window.partitionBy("bin"), Window.partitionBy("season")
    rate = lambda w: F.sum("pts").over(w) / F.sum("poss").over(w)
    goals = bins.groupBy("season", "bin").agg(F.count("*").alias("n"), F.sum("pts").alias("pts"), F.sum("poss").alias("poss"))
    goal = F.when(F.col("n") >= 5, F.col("pts") / F.col("poss")).when(F.sum("n").over(pooled) >= 5, rate(pooled)).otherwise(rate(league))
    small = goals.select("season", "bin", goal.alias("goal"))
    padded = S.shrink(F.col("poss"), F.col("pts") / F.col("poss"), 400.0, F.col("goal"))
    return bins.join(small, ["season", "bin"]).select("season", "team", "player", "bin", r(padded).alias("padded"))


@query("scl24_bin_index", "select season, player, ((poss > 200)::int + (poss > 400)::int + (poss > 800)::int)::int as bin from player_season")
def _(t: Tables) -> DataFrame:
    return t.player_season.select("season", "player", S.bin_index(F.col("poss"), [200.0, 400.0, 800.0]).alias("bin"))


#: Linear combinations of a player's counts per 100 possessions.
COMBINATIONS = {
    "creation": {"a": 0.4, "n": 0.2, "r": -0.1}, "finishing": {"ao": 1.0, "no": -0.5}, "spacing": {"a_long": 0.7, "a_deep": 1.1, "n_deep": -0.3}, "rim_pressure": {"a_rim": 1.0, "n_rim": 0.44},
    "turnover_cost": {"r": -1.2}, "second_chances": {"n_short": 0.5, "n_mid": 0.25}, "volume": {"a": 1.0, "n": 1.0}, "closing": {"af": 0.8, "nf": -0.4}, "defence": {"ro": 0.6, "rf": 0.9}, "activity": {"a": 0.3, "n": 0.3, "r": 0.3, "o": -0.05},
}


def combined_sql(weights: dict[str, float]) -> str:
    every = masks() | zone_masks()
    total = " + ".join(f"{w} * count(*) filter (where {every[k]})" for k, w in weights.items())
    return f"round(100 * ({total}) / sum(poss), 6)"


@query("scl26_linear_features", "select player, " + ", ".join(f"({combined_sql(w)})::double as {k}" for k, w in COMBINATIONS.items()) + " from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("player").agg(*[F.expr(combined_sql(w)).cast("double").alias(k) for k, w in COMBINATIONS.items()])


#: Ratios of counts as (part, whole, pad, prior).
RATIOS = {
    "made": ("a", "lines", 50, 0.25), "missed": ("n", "lines", 50, 0.5), "lost": ("r", "lines", 50, 0.25), "open_made": ("ao", "a", 30, 0.1), "late_made": ("af", "a", 30, 0.9), "rim_made": ("a_rim", "a", 40, 0.12),
    "deep_made": ("a_deep", "a", 40, 0.3), "deep_tries": ("n_deep", "n", 40, 0.3), "open_lost": ("ro", "r", 20, 0.1), "long_lost": ("r_long", "r", 20, 0.2),
}


def padded_sql(part: str, whole: str, pad: int, prior: float) -> str:
    every = masks() | zone_masks() | {"lines": "true"}
    return f"round((count(*) filter (where {every[part]}) + {pad} * {prior}) / (count(*) filter (where {every[whole]}) + {pad}), 6)"


@query("scl27_padded_ratio", "select player, " + ", ".join(f"({padded_sql(*x)})::double as {k}" for k, x in RATIOS.items()) + " from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("player").agg(*[F.expr(padded_sql(*x)).cast("double").alias(k) for k, x in RATIOS.items()])


@query("scl29_unassisted", "select player, round(count(*) * (1 - least(greatest(avg((flag = 'R')::int), 0.05), 0.95)), 6) as own from fact group by 1")
def _(t: Tables) -> DataFrame:
    share = F.least(F.greatest(F.avg((F.col("flag") == "R").cast("int")), F.lit(0.05)), F.lit(0.95))
    return t.lines.groupBy("player").agg(r(F.count("*") * (1 - share), 6).alias("own"))


#: Seven regressions as response and what it is regressed on.
REGRESSIONS = {
    "rate_on_load": ("pts / poss", "poss"), "rate_on_games": ("pts / poss", "games"), "load_on_games": ("poss", "games"), "pts_on_load": ("pts / 1000", "poss"), "pts_on_games": ("pts / 1000", "games"),
    "pace_on_load": ("poss / games", "poss"), "pace_on_rate": ("poss / games", "pts / poss"),
}


@query("scl32_residual", "select season, team, player, " + ", ".join(
    f"round(({y}) - (wy_{k} / w) - coalesce((wxy_{k} / w - wx_{k} / w * wy_{k} / w) / nullif(wxx_{k} / w - wx_{k} / w * wx_{k} / w, 0), 0) * (({x}) - wx_{k} / w), 3) as {k}" for k, (y, x) in REGRESSIONS.items())
    + " from player_season join (select season, team % 2 as side, sum(poss) as w, " + ", ".join(f"sum(poss * ({y})) as wy_{k}, sum(poss * ({x})) as wx_{k}, sum(poss * ({x}) * ({y})) as wxy_{k}, sum(poss * ({x}) * ({x})) as wxx_{k}" for k, (y, x) in REGRESSIONS.items())
    + " from player_season group by all having count(*) > 3) using (season) where team % 2 = side")
def _(t: Tables) -> DataFrame:
    """Residuals of seven regressions weighted by possessions, apart by season and side (here: a team's parity), where a side has over three players."""
    side = (F.col("team") % 2).alias("side")
    rows = t.player_season.select("*", side)
    names = [(k, F.expr(y), F.expr(x)) for k, (y, x) in REGRESSIONS.items()]
    w = F.col("poss")
    sums = [z for k, y, x in names for z in (F.sum(w * y).alias(f"wy_{k}"), F.sum(w * x).alias(f"wx_{k}"), F.sum(w * x * y).alias(f"wxy_{k}"), F.sum(w * x * x).alias(f"wxx_{k}"))]
    fitted = rows.groupBy("season", "side").agg(F.sum("poss").alias("w"), F.count("*").alias("players"), *sums).where("players > 3")
    both = rows.join(F.broadcast(fitted), ["season", "side"])

    def residual(k: str, y: Column, x: Column) -> Column:
        mean_y, mean_x = F.col(f"wy_{k}") / F.col("w"), F.col(f"wx_{k}") / F.col("w")
        slope = F.coalesce((F.col(f"wxy_{k}") / F.col("w") - mean_x * mean_y) / F.nullif(F.col(f"wxx_{k}") / F.col("w") - mean_x * mean_x, F.lit(0.0)), F.lit(0.0))
        return r(y - mean_y - slope * (x - mean_x), 3).alias(k)

    return both.select("season", "team", "player", *[residual(*x) for x in names])


@query("scl33_logit", "select player, round(ln(p / (1 - p)), 6) as odds, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) as back from (select player, least(greatest(avg((flag = 'A')::int), 1e-6), 1 - 1e-6) as p from fact group by 1)")
def _(t: Tables) -> DataFrame:
    odds = S.logit(F.avg((F.col("flag") == "A").cast("int")))
    return t.lines.groupBy("player").agg(odds.alias("o")).select("player", r("o", 6).alias("odds"), r(S.sigmoid(F.col("o")), 6).alias("back"))


@query("scl35_time_left", "select p_partkey, round(greatest(2880 - p_partkey % 2880, 1) / 2880.0, 6) as share, round(greatest(2880 - p_partkey % 2880 - p_size / 2.0, 1) / 2880.0, 6) as middle from part")
def _(t: Tables) -> DataFrame:
    left = 2880 - F.col("p_partkey") % 2880
    share = lambda x: r(F.greatest(x, F.lit(1)) / 2880.0, 6)
    return t.part.select("p_partkey", share(left).alias("share"), share(left - F.col("p_size") / 2).alias("middle"))


@query("scl37_interpolated_spread", "select p_partkey, round(greatest(case when x <= 10 then 2.0 when x < 20 then 2.0 + (x - 10) * 0.3 when x < 40 then 5.0 + (x - 20) * 0.2 else 9.0 end, 0.5), 6) as spread from (select p_partkey, p_size::double as x from part)")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r(F.greatest(S.interpolate(F.col("p_size").cast("double"), [(10.0, 2.0), (20.0, 5.0), (40.0, 9.0)]), F.lit(0.5)), 6).alias("spread"))


@query("scl38_win_chance", """select p_partkey, round(case when z >= 0 then (1 + e) / 2 else (1 - e) / 2 end, 6) as chance from (select p_partkey, z, 1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-x * x) as e
  from (select p_partkey, z, abs(z) / sqrt(2.0) as x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) as t from (select p_partkey, (p_size - 25) / 10.0 as z from part)))""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r(S.normal_cdf((F.col("p_size") - 25) / 10.0), 6).alias("chance"))


@query("scl42_mean_error", "select season, round(sqrt(avg(e * e)) * sqrt(2 / pi()), 6) as mae from (select season, poss - 25.5 as e from fact) group by 1")
def _(t: Tables) -> DataFrame:
    off = F.col("poss") - 25.5
    return t.played.groupBy("season").agg(r(F.sqrt(F.avg(off * off)) * F.sqrt(2 / F.pi()), 6).alias("mae"))


@query("scl43_scale_to_spread", "select season, player, round((pts / poss - avg(pts / poss) over w) / nullif(stddev_pop(pts / poss) over w, 0) * 2.5, 6) as scaled from player_season window w as (partition by season)")
def _(t: Tables) -> DataFrame:
    over, y = Window.partitionBy("season"), F.col("pts") / F.col("poss")
    return t.player_season.select("season", "player", r((y - F.avg(y).over(over)) / F.nullif(F.stddev_pop(y).over(over), F.lit(0.0)) * 2.5, 6).alias("scaled"))


@query("scl45_standardised", "select player, round(coalesce((poss - avg(poss) over ()) / nullif(stddev_pop(poss) over (), 0), 0), 6) as z from (select player, sum(poss) as poss from fact group by 1)")
def _(t: Tables) -> DataFrame:
    own = t.lines.groupBy("player").agg(F.sum("poss").alias("poss"))
    moments = own.agg(F.avg("poss").alias("m"), F.stddev_pop("poss").alias("s"), F.lit(1).alias("one"))
    z = F.coalesce((F.col("poss") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0))
    return own.join(F.broadcast(moments), F.lit(1) == F.col("one")).select("player", r(z, 6).alias("z"))


@query("scl46_distances_in_label", """select vec_id, near, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 4) as d from (
  select vec_id, lag(vec_id) over w as near, embedding[1:34] as a, lag(embedding[1:34]) over w as b from embeddings window w as (partition by label order by vec_id)) where near is not null""")
def _(t: Tables) -> DataFrame:
    """Distance over 34 inputs, summed in their order, from each row to the one before it in its label."""
    vector = F.transform(F.slice("embedding", 1, 34), lambda x: x.cast("double"))
    over = Window.partitionBy("label").orderBy("vec_id")
    rows = t.embeddings.select("vec_id", "label", vector.alias("a")).withColumn("near", F.lag("vec_id").over(over)).withColumn("b", F.lag("a").over(over))
    return rows.where("near is not null").select("vec_id", "near", r(S.distance(F.col("a"), F.col("b"))).alias("d"))


@query("scl47_moments_per_input", "select i, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd from (select unnest(embedding)::double as v, unnest(range(64)) as i from embeddings) group by 1")
def _(t: Tables) -> DataFrame:
    long = t.embeddings.select(F.posexplode("embedding").alias("i", "v")).select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    return long.groupBy("i").agg(r(F.avg("v"), 6).alias("mean"), r(F.stddev_pop("v"), 6).alias("sd"))


@query("scl51_placebo_permutation", "select a.game, b.v from (select game, v, row_number() over (partition by season order by game) as k from g) a join (select season, v, row_number() over (partition by season order by (game * 2654435761) % 4294967296, game) as k from g) b on a.k = b.k join g on g.game = a.game and g.season = b.season",
       "g as (select season, game, sum(poss)::double as v from fact group by all)")
def _(t: Tables) -> DataFrame:
    games = t.played.groupBy("season", "game").agg(F.sum("poss").alias("v"))
    own = Window.partitionBy("season")
    plain = games.select("season", "game", F.row_number().over(own.orderBy("game")).alias("k"))
    mixed = games.select("season", "v", F.row_number().over(own.orderBy(F.pmod(F.col("game") * 2654435761, F.lit(1 << 32)), "game")).alias("k"))
    return plain.join(mixed, ["season", "k"]).select("game", "v")


@query("scl52_other_half", "select player, case when half = 'A' then 'B' when half = 'B' then 'A' else 'ALL' end as other, n from (select player, case flag when 'A' then 'A' when 'N' then 'B' else 'C' end as half, count(*) as n from fact group by all)")
def _(t: Tables) -> DataFrame:
    half = F.when(F.col("flag") == "A", "A").when(F.col("flag") == "N", "B").otherwise("C")
    own = t.lines.groupBy("player", half.alias("half")).agg(F.count("*").alias("n"))
    return own.select("player", F.when(F.col("half") == "A", "B").when(F.col("half") == "B", "A").otherwise("ALL").alias("other"), "n")


@query("scl53_expected_from_other_half", """select game, round(sum(n * coalesce(p, 0.25)), 6) as expected from (select game, player, (game % 2)::int as half, count(*) as n from fact group by all) x
  left join (select player, (game % 2)::int as half, (count(*) filter (where flag = 'A') + 20 * 0.25) / (count(*) + 20) as p from fact group by all) y on x.player = y.player and x.half = 1 - y.half group by 1""")
def _(t: Tables) -> DataFrame:
    half = (F.col("game") % 2).cast("int")
    tries = t.lines.groupBy("game", "player").agg(F.count("*").alias("n")).withColumn("half", half)
    rate = t.lines.groupBy("player", (1 - half).alias("half")).agg(((F.count_if(F.col("flag") == "A") + 5.0) / (F.count("*") + 20)).alias("p"))
    return tries.join(rate, ["player", "half"], "left").groupBy("game").agg(r(F.sum(F.col("n") * F.coalesce("p", F.lit(0.25))), 6).alias("expected"))


@query("scl58_response_pieces", "select game, round(sum(case when flag = 'A' then pts else 0 end), 4) as threes, round(sum(case when flag = 'N' then pts else 0 end), 4) as twos, round(sum(case when flag = 'R' then pts else 0 end), 4) as frees from fact group by 1")
def _(t: Tables) -> DataFrame:
    part = lambda f, name: r(F.sum(F.when(F.col("flag") == f, F.col("pts")).otherwise(0.0))).alias(name)
    return t.lines.groupBy("game").agg(part("A", "threes"), part("N", "twos"), part("R", "frees"))


@query("scl61_one_hot", "select game, " + ", ".join(f"max((team = {k})::int)::int as t{k}" for k in range(25)) + " from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.fact.groupBy("game").agg(*[F.max((F.col("team") == k).cast("int")).alias(f"t{k}") for k in range(25)])


@query("psm17_leave_game_out", "select game, player, round((ta - a + 10 * 0.25) / (tn - n + 10), 6) as share from (select game, player, count(*) filter (where flag = 'A') as a, count(*) as n, sum(count(*) filter (where flag = 'A')) over (partition by player) as ta, sum(count(*)) over (partition by player) as tn from fact group by game, player)")
def _(t: Tables) -> DataFrame:
    own = t.lines.groupBy("game", "player").agg(F.count_if(F.col("flag") == "A").alias("a"), F.count("*").alias("n"))
    rest = R.without_own(own, ["game"], ["player"], ["a", "n"])
    return rest.select("game", "player", r((F.col("other_a") + 2.5) / (F.col("other_n") + 10), 6).alias("share"))


@query("psm03_set_algebra", "select game, list_sort(list(distinct player) filter (where flag <> 'R')) as kept, count(distinct player) filter (where flag <> 'R') as size from fact group by 1 having count(*) filter (where flag <> 'R') > 0")
def _(t: Tables) -> DataFrame:
    sets = t.lines.groupBy("game").agg(F.collect_set(F.when(F.col("flag") != "R", F.col("player"))).alias("kept"))
    return sets.where(F.size("kept") > 0).select("game", F.array_sort("kept").alias("kept"), F.size("kept").cast("long").alias("size"))


# ---- more derived features


@query("scl06_named_pattern", "select regexp_extract(p_name || ' (' || p_type || ' ' || p_size || ' AST)', '\\((.+) [0-9]+ AST\\)', 1) as kind, count(*) as n from part group by 1")
def _(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit(" AST)"))
    return t.part.groupBy(F.regexp_extract(text, r"\((.+) [0-9]+ AST\)", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("scl13_eastern_day", "select event_id, strftime(ts - interval 9 hours, '%Y-%m-%d') as day from events")
def _(t: Tables) -> DataFrame:
    """The day in US Eastern time, which begins at four in the morning (January: five hours behind)."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York") - F.expr("interval 4 hours")
    return t.events.select("event_id", F.date_format(local, "yyyy-MM-dd").alias("day"))


@query("scl23_log_edges", "select i, round(exp(ln(a) + i * (ln(b) - ln(a)) / 5), 4) as edge from (select quantile_cont(poss, 0.01) as a, max(poss) as b from player_season), (select unnest([0, 1, 2, 3, 4, 5])::int as i)")
def _(t: Tables) -> DataFrame:
    ends = t.player_season.agg(F.percentile("poss", F.lit(0.01)).alias("a"), F.max("poss").alias("b"))
    edges = ends.select(F.posexplode(F.array(*[F.exp(F.log("a") + i * (F.log("b") - F.log("a")) / 5) for i in range(6)])).alias("i", "edge"))
    return edges.select("i", r("edge").alias("edge"))


@query("scl25_padded_counts", "select season, player, round((count(*) filter (where flag = 'A') + 30 * 0.25) / (count(*) + 30), 6) as a, round((count(*) filter (where flag = 'N') + 30 * 0.5) / (count(*) + 30), 6) as n, round((count(*) filter (where flag = 'R') + 30 * 0.25) / (count(*) + 30), 6) as r from fact group by all")
def _(t: Tables) -> DataFrame:
    targets = {"A": 0.25, "N": 0.5, "R": 0.25}
    n = F.count("*").cast("double")
    return t.played.groupBy("season", "player").agg(*[r(S.shrink(n, F.count_if(F.col("flag") == f) / n, 30.0, F.lit(x)), 6).alias(f.lower()) for f, x in targets.items()])


@query("scl39_leverage", """select p_partkey, round((1 / (1 + exp(-(p_size - 24) / 10.0)) - 1 / (1 + exp(-(p_size - 26) / 10.0))) / 2, 6) as leverage from part""")
def _(t: Tables) -> DataFrame:
    chance = lambda shift: S.sigmoid((F.col("p_size") - 25 + shift) / 10.0)
    return t.part.select("p_partkey", r((chance(1) - chance(-1)) / 2, 6).alias("leverage"))


@query("scl40_share_multiplier", "select p_partkey, round(case when x <= 0.25 then 0.6 when x < 0.5 then 0.6 + (x - 0.25) * 0.8 when x < 1 then 0.8 + (x - 0.5) * 0.4 else 1.0 end, 6) as m, x < 0.25 as early from (select p_partkey, p_size / 50.0 as x from part)")
def _(t: Tables) -> DataFrame:
    x = F.col("p_size") / 50.0
    return t.part.select("p_partkey", r(S.interpolate(x, [(0.25, 0.6), (0.5, 0.8), (1.0, 1.0)]), 6).alias("m"), (x < 0.25).alias("early"))


@query("scl44_published_digits", "select player, round(100 * avg((flag = 'A')::int) + 1e-9, 1) as percent, round(sum(pts) / sum(poss) + 1e-9, 2) as rating from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("player").agg(r(100 * F.avg((F.col("flag") == "A").cast("int")) + 1e-9, 1).alias("percent"), r(F.sum("pts") / F.sum("poss") + 1e-9, 2).alias("rating"))


@query("scl48_stored_z", "select season, player, round((poss - 500) / 120.0, 6) as z from player_season")
def _(t: Tables) -> DataFrame:
    return t.player_season.select("season", "player", r((F.col("poss") - 500) / 120.0, 6).alias("z"))


@query("scl50_relative_to_league", "select season, player, round(((pts + 400 * lg) / (poss + 400) - lg) / lg, 6) as above from (select *, sum(pts) over (partition by season) / sum(poss) over (partition by season) as lg from player_season)")
def _(t: Tables) -> DataFrame:
    season = Window.partitionBy("season")
    rows = t.player_season.withColumn("lg", F.sum("pts").over(season) / F.sum("poss").over(season))
    return rows.select("season", "player", r((S.shrink(F.col("poss"), F.col("pts") / F.col("poss"), 400.0, F.col("lg")) - F.col("lg")) / F.col("lg"), 6).alias("above"))


@query("scl55_luck_adjusted", "select game, round(sum(pts) - 0.75 * (sum(case when flag = 'A' then pts else 0 end) - sum((flag = 'A')::int) * (select avg(pts) from fact where flag = 'A')), 4) as adjusted from fact group by 1")
def _(t: Tables) -> DataFrame:
    level = t.lines.where("flag = 'A'").agg(F.avg("pts").alias("level"), F.lit(1).alias("one"))
    games = t.lines.groupBy("game").agg(F.sum("pts").alias("all"), F.sum(F.when(F.col("flag") == "A", F.col("pts")).otherwise(0.0)).alias("threes"), F.count_if(F.col("flag") == "A").alias("n"))
    return games.join(F.broadcast(level), F.lit(1) == F.col("one")).select("game", r(F.col("all") - 0.75 * (F.col("threes") - F.col("n") * F.col("level")), 4).alias("adjusted"))


@query("scl60_penalty_blocks", "select distinct flag, case flag when 'A' then 5000.0 when 'N' then 30000.0 else 0.0 end::double as penalty from fact")
def _(t: Tables) -> DataFrame:
    penalties = F.create_map(*[F.lit(x) for pair in (("A", 5000.0), ("N", 30000.0), ("R", 0.0)) for x in pair])
    return t.lines.select("flag", F.try_element_at(penalties, F.col("flag")).alias("penalty")).distinct()


@query("scl63_season_list", "select unnest([1996, 1997, 1998, 2001])::int as season")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(y,) for y in X.season_list("1996-1998,2001")], "season int")


@query("scl64_step_table", "select * from (values (1995, 0.89), (1996, 0.89), (1997, 0.84), (1998, 0.84)) v(season, factor)".replace("0.89)", "0.89::double)").replace("0.84)", "0.84::double)"))
def _(t: Tables) -> DataFrame:
    steps = X.step_table("0.89,1997:0.84")
    return t.spark.createDataFrame([(y,) for y in range(1995, 1999)], "season int").select("season", S.step_value(F.col("season"), steps).alias("factor"))
