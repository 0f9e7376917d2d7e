"""Windows, sorts, sets and time (WIN, SRT, SET, TIM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.operators import machine
from stintforge.operators import nearest as N
from stintforge.operators import sequences as Q
from stintforge.plans.registry import query
from stintforge.plans.relational import r
from stintforge.sources.tables import Tables
from stintforge.streaming import sessions as stream

EVENTS = "ev as (select *, epoch_us(ts) as us from events)"


def micros(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


# ---- windows


@query("win01_islands", """select user_id, island::bigint as island, min(event_type) as kind, count(*) as n, round(sum(value), 4) as value from (
  select *, sum(start) over (partition by user_id order by us, event_id) as island from (select *, (event_type is distinct from lag(event_type) over (partition by user_id order by us, event_id))::int as start from ev)) x group by user_id, x.island""", EVENTS)
def _(t: Tables) -> DataFrame:
    runs = Q.islands(micros(t.events), ["user_id"], ["us", "event_id"], ["event_type"])
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("kind"), F.count("*").alias("n"), r(F.sum("value")).alias("value"))


@query("win01_sessions", """select user_id, session::bigint as session, count(*) as n, (max(us) - min(us)) // 1000000 as seconds from (
  select *, sum(start) over (partition by user_id order by us, event_id) as session from (select *, coalesce(us - lag(us) over (partition by user_id order by us, event_id) > 1800000000, true)::int as start from ev)) x group by user_id, x.session""", EVENTS)
def _(t: Tables) -> DataFrame:
    own = Q.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", ["event_id"], 1800)
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return own.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.floor(span / 1_000_000).alias("seconds"))


@query("win02_chronology", "select game, (row_number() over (partition by season order by case when phase = 'RS' then 0 else 1 end, day, game))::int as number from (select distinct season, phase, day, game from fact)")
def _(t: Tables) -> DataFrame:
    games = t.played.select("season", "phase", "day", "game").distinct()
    order = Window.partitionBy("season").orderBy(F.when(F.col("phase") == "RS", 0).otherwise(1), "day", "game")
    return games.select("game", F.row_number().over(order).alias("number"))


@query("win03_alternate_halves", "select game, case when (row_number() over (partition by season order by day, game) - 1) % 2 = 0 then 'A' else 'B' end as half from (select distinct season, day, game from fact)")
def _(t: Tables) -> DataFrame:
    games = t.played.select("season", "day", "game").distinct()
    return games.select("game", Q.alternate(["season"], ["day", "game"]).alias("half"))


@query("win05_next_same", "select event_id, coalesce(lead(event_type) over w = event_type, false) as same from ev window w as (partition by user_id order by us, event_id)", EVENTS)
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("us", "event_id")
    return micros(t.events).select("event_id", F.coalesce(F.lead("event_type").over(line) == F.col("event_type"), F.lit(False)).alias("same"))


@query("win06_durations", "select event_id, greatest(0, coalesce(lead(us) over w - us, 0)) as micros from ev window w as (partition by user_id order by us, event_id)", EVENTS)
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("us", "event_id")
    return micros(t.events).select("event_id", F.greatest(F.lit(0), F.coalesce(F.lead("us").over(line) - F.col("us"), F.lit(0))).alias("micros"))


@query("win07_time_on_court", """select event_id, (sum(d) over (partition by user_id, island order by us, event_id rows between unbounded preceding and current row) - d)::bigint as before from (
  select *, greatest(0, coalesce(lead(us) over (partition by user_id order by us, event_id) - us, 0)) as d, sum(start) over (partition by user_id order by us, event_id) as island from (
  select *, (event_type is distinct from lag(event_type) over (partition by user_id order by us, event_id))::int as start from ev))""", EVENTS)
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("us", "event_id")
    runs = Q.islands(micros(t.events), ["user_id"], ["us", "event_id"], ["event_type"])
    runs = runs.withColumn("d", F.greatest(F.lit(0), F.coalesce(F.lead("us").over(line) - F.col("us"), F.lit(0))))
    upto = Window.partitionBy("user_id", "island").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.select("event_id", (F.sum("d").over(upto) - F.col("d")).alias("before"))


@query("win08_season_runs", """select k.player, a.season as start, s.size, a.season + o.o as season from own a join own k on a.player = k.player and a.season = k.season join (select unnest([1, 2, 3]) as size) s on true
  join (select unnest([0, 1, 2]) as o) o on o.o < s.size where (select count(*) from own b where b.player = a.player and b.season between a.season and a.season + s.size - 1) = s.size""", "own as (select distinct player, season from fact where flag = 'R' and phase = 'PO')")
def _(t: Tables) -> DataFrame:
    own = t.played.where("flag = 'R' and phase = 'PO'").select("player", "season")
    return Q.runs_of(own, "player", "season", 3).select("player", "start", "size", "season")


_MAIN = "main as (select customer, season, max_by(team, p * 1000 - team) as team from (select customer, season, team, sum(poss) as p from fact group by all) group by all)"


def main_team(t: Tables) -> DataFrame:
    p = t.fact.groupBy("customer", "season", "team").agg(F.sum("poss").alias("p"))
    return p.groupBy("customer", "season").agg(F.max_by("team", F.col("p") * 1000 - F.col("team")).alias("team"))


for _name, _breaks in (("win09_team_streak", False), ("win10_streak_broken_by_gap", True)):
    _gap = " or lag(season) over (partition by customer order by season) <> season - 1" if _breaks else ""

    @query(_name, f"""select customer, season, (row_number() over (partition by customer, run order by season))::int as streak from (select *, sum(c) over (partition by customer order by season) as run from (
      select *, (lag(team) over (partition by customer order by season) is distinct from team{_gap})::int as c from main))""", _MAIN)
    def _(t: Tables, breaks: bool = _breaks) -> DataFrame:
        return Q.streaks(main_team(t), ["customer"], "season", "team", breaks).select("customer", "season", "streak")


@query("win11_forward_fill", """select event_id, coalesce(filled - lag(filled) over (partition by user_id order by us, event_id), 0) as change from (select *, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by us, event_id) as filled from ev)""", EVENTS)
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("us", "event_id")
    filled = micros(t.events).withColumn("filled", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(line))
    return filled.select("event_id", F.coalesce(F.col("filled") - F.lag("filled").over(line), F.lit(0.0)).alias("change"))


@query("win12_last_labelled_before", "select event_id, max(case when event_type = 'error' then event_id end) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as before from ev", EVENTS)
def _(t: Tables) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return micros(t.events).select("event_id", F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(before).alias("before"))


@query("win13_before_else_after", "select event_id, coalesce(lag(event_type) over w, lead(event_type) over w) as beside from ev window w as (partition by user_id order by us, event_id)", EVENTS)
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("us", "event_id")
    return micros(t.events).select("event_id", F.coalesce(F.lag("event_type").over(line), F.lead("event_type").over(line)).alias("beside"))


@query("win14_first_within_three", """select event_id, case when lead(event_type, 1) over w = 'purchase' then 1 when lead(event_type, 2) over w = 'purchase' then 2 when lead(event_type, 3) over w = 'purchase' then 3 end as steps from ev window w as (partition by user_id order by us, event_id)""", EVENTS)
def _(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("us", "event_id")
    near = lambda k: F.lead("event_type", k).over(line) == "purchase"
    return micros(t.events).select("event_id", F.when(near(1), 1).when(near(2), 2).when(near(3), 3).alias("steps"))


@query("win15_within_eleven_before_stop", """select event_id, count(*) filter (where k is not null) > 0 as hit from (select e.event_id, x.k from num e left join (select a.event_id, b.n as k from num a join num b on a.user_id = b.user_id and b.n between a.n + 1 and a.n + 11 and b.event_type = 'purchase'
  and not exists (select 1 from num c where c.user_id = a.user_id and c.n > a.n and c.n < b.n and c.event_type = 'error')) x on e.event_id = x.event_id) group by 1""", EVENTS + ", num as (select *, row_number() over (partition by user_id order by us, event_id) as n from ev)")
def _(t: Tables) -> DataFrame:
    ahead = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(1, 11)
    rows = micros(t.events).withColumn("next", F.collect_list("event_type").over(ahead))
    hit, stop = F.array_position("next", "purchase"), F.array_position("next", "error")
    return rows.select("event_id", ((hit > 0) & ((stop == 0) | (hit < stop))).alias("hit"))


@query("win16_top_creator", "select game, player from (select game, player, row_number() over (partition by game order by sum(poss) desc, player) as rk from fact group by game, player) where rk = 1")
def _(t: Tables) -> DataFrame:
    own = t.lines.groupBy("game", "player").agg(F.sum("poss").alias("p"))
    return own.groupBy("game").agg(F.min_by("player", F.struct(-F.col("p"), "player")).alias("player"))


@query("win17_rank_in_season", "select season, player, (row_number() over (partition by season order by poss desc, player))::int as place from player_season")
def _(t: Tables) -> DataFrame:
    return t.player_season.select("season", "player", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("poss"), "player")).alias("place"))


@query("win18_rank_gaps", """select season, player, round((ra - rb) / nullif(stddev_samp(ra - rb) over (partition by season), 0), 6) as z from (select season, player, rank() over (partition by season order by poss) + (count(*) over (partition by season, poss) - 1) / 2.0 as ra,
  rank() over (partition by season order by games) + (count(*) over (partition by season, games) - 1) / 2.0 as rb from player_season)""")
def _(t: Tables) -> DataFrame:
    ranks = t.player_season.select("season", "player", Q.average_rank(["season"], F.col("poss")).alias("ra"), Q.average_rank(["season"], F.col("games")).alias("rb"))
    gap = F.col("ra") - F.col("rb")
    return ranks.select("season", "player", r(gap / F.nullif(F.stddev_samp(gap).over(Window.partitionBy("season")), F.lit(0.0)), 6).alias("z"))


@query("win19_centred", "select season, player, round(pts / poss - sum(pts) over w / sum(poss) over w, 4) as rate from player_season window w as (partition by season)")
def _(t: Tables) -> DataFrame:
    over = Window.partitionBy("season")
    return t.player_season.select("season", "player", r(F.col("pts") / F.col("poss") - F.sum("pts").over(over) / F.sum("poss").over(over)).alias("rate"))


@query("win20_team_deviation", "select season, player, round(sum(pts) over w / sum(poss) over w, 4) as team_rate, round(pts / poss - sum(pts) over w / sum(poss) over w, 4) as deviation from player_season window w as (partition by season, team)")
def _(t: Tables) -> DataFrame:
    over = Window.partitionBy("season", "team")
    mean = F.sum("pts").over(over) / F.sum("poss").over(over)
    return t.player_season.select("season", "player", r(mean).alias("team_rate"), r(F.col("pts") / F.col("poss") - mean).alias("deviation"))


@query("win24_spread_hold", """select season, player, round(dev * 0.5 * sqrt(v0 / nullif(v1, 0)), 4) as held from (select *, sum(poss * dev * dev) over (partition by season) as v0, sum(poss * dev * dev * 0.25) over (partition by season) as v1 from (
  select season, player, poss, pts / poss - sum(pts) over (partition by season, team) / sum(poss) over (partition by season, team) as dev from player_season))""")
def _(t: Tables) -> DataFrame:
    over, season = Window.partitionBy("season", "team"), Window.partitionBy("season")
    dev = t.player_season.withColumn("dev", F.col("pts") / F.col("poss") - F.sum("pts").over(over) / F.sum("poss").over(over))
    spread = F.sum(F.col("poss") * F.col("dev") * F.col("dev")).over(season)
    return dev.select("season", "player", r(F.col("dev") * 0.5 * F.sqrt(spread / F.nullif(F.sum(F.col("poss") * F.col("dev") * F.col("dev") * 0.25).over(season), F.lit(0.0)))).alias("held"))


@query("win25_leave_one_out", "select season, team, player, round(case when count(*) over w > 1 then (sum(pts / poss) over w - pts / poss) / (count(*) over w - 1) end, 4) as others from player_season window w as (partition by season, team)")
def _(t: Tables) -> DataFrame:
    over, rate = Window.partitionBy("season", "team"), F.col("pts") / F.col("poss")
    n = F.count("*").over(over)
    return t.player_season.select("season", "team", "player", r(F.when(n > 1, (F.sum(rate).over(over) - rate) / (n - 1))).alias("others"))


@query("win26_relative_to_game", "select game, player, round(sum(pts) / sum(poss) / (sum(sum(pts)) over (partition by game) / sum(sum(poss)) over (partition by game)), 6) as ratio from fact group by game, player")
def _(t: Tables) -> DataFrame:
    own, over = t.lines.groupBy("game", "player").agg(F.sum("pts").alias("a"), F.sum("poss").alias("b")), Window.partitionBy("game")
    return own.select("game", "player", r(F.col("a") / F.col("b") / (F.sum("a").over(over) / F.sum("b").over(over)), 6).alias("ratio"))


@query("win30_round_robin_folds", "select game, ((row_number() over (partition by season order by (game * 2654435761) % 4294967296, game) - 1) % 5)::int as fold from (select distinct season, game from fact)")
def _(t: Tables) -> DataFrame:
    games = t.played.select("season", "game").distinct()
    order = Window.partitionBy("season").orderBy(F.pmod(F.col("game") * 2654435761, F.lit(1 << 32)), "game")
    return games.select("game", ((F.row_number().over(order) - 1) % 5).alias("fold"))


@query("win31_serpentine_folds", "select season, player, (case when k < 5 then k else 9 - k end)::int as fold from (select season, player, (row_number() over (partition by season order by poss desc, player) - 1) % 10 as k from player_season)")
def _(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("poss"), "player")) - 1
    return t.player_season.select("season", "player", Q.serpentine(place, 5).alias("fold"))


@query("win32_id_folds", "select ((game * 2654435761) % 4294967296 % 5)::int as fold, count(*) as n, count(distinct game) as games from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy(Q.arithmetic_fold(F.col("game"), 5).alias("fold")).agg(F.count("*").alias("n"), F.countDistinct("game").alias("games"))


# ---- sorts and limits


@query("srt02_sorted_lineups", "select game, list_sort(list(distinct player)) as lineup, count(*) = count(distinct player) as clean from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("game").agg(F.array_sort(F.collect_set("player")).alias("lineup"), (F.count("*") == F.countDistinct("player")).alias("clean"))


@query("srt03_nearest_others", """select vec_id, near, place from (select a.vec_id, b.vec_id as near, (row_number() over (partition by a.vec_id order by round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 5), b.vec_id))::int as place
  from embeddings a join embeddings b on a.label <> b.label where a.vec_id % 20 = 0) where place <= 5""")
def _(t: Tables) -> DataFrame:
    """A stated query set (ids divisible by 20) against all rows, in blocks; only each block's five nearest are shuffled."""
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").alias("vector"))
    near = N.nearest_others(rows.where("vec_id % 20 = 0"), rows, 5)
    return Q.top(near, ["vec_id"], [F.col("d"), F.col("near")], 5).select("vec_id", "near", "place")


@query("srt06_top_twenty", "select player, sum(poss)::double as poss from fact group by 1 order by poss desc, player limit 20")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("player").agg(F.sum("poss").alias("poss")).orderBy(F.desc("poss"), "player").limit(20)


@query("srt07_latest_full_season", "select max(season) as season from (select season, median(poss) as m from player_season group by 1) where m >= 250")
def _(t: Tables) -> DataFrame:
    return t.player_season.groupBy("season").agg(F.median("poss").alias("m")).where("m >= 250").agg(F.max("season").alias("season"))


@query("srt09_nearest_seasons", "select season, other from (select a.season, b.season as other, row_number() over (partition by a.season order by abs(a.season - b.season), b.season) as rk from (select distinct season from fact) a join (select distinct season from fact) b on a.season <> b.season) where rk <= 3")
def _(t: Tables) -> DataFrame:
    seasons = t.played.select("season").distinct()
    all_of = seasons.agg(F.array_sort(F.collect_set("season")).alias("all"))
    pairs = seasons.join(F.broadcast(all_of)).select("season", F.explode("all").alias("other")).where("season <> other")
    return Q.top(pairs, ["season"], [F.abs(F.col("season") - F.col("other")), F.col("other")], 3).select("season", "other")


@query("srt12_tail_folded", "select season, case when rk <= 5 then team else -1 end as team, sum(p)::double as poss from (select season, team, sum(poss) as p, row_number() over (partition by season order by sum(poss) desc, team) as rk from fact group by season, team) group by all")
def _(t: Tables) -> DataFrame:
    teams = t.fact.groupBy("season", "team").agg(F.sum("poss").alias("p"))
    rk = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("p"), "team"))
    return teams.withColumn("team", F.when(rk <= 5, F.col("team")).otherwise(-1)).groupBy("season", "team").agg(F.sum("p").alias("poss"))


# ---- sets


@query("set01_phase_union", "select season, phase, count(*) as n from (select * from fact where phase = 'RS' union all select * from fact where phase = 'PO') group by all")
def _(t: Tables) -> DataFrame:
    return t.fact.where("phase = 'RS'").unionByName(t.fact.where("phase = 'PO'")).groupBy("season", "phase").agg(F.count("*").alias("n"))


@query("set03_numbered_players", "select season, player, row_number() over (order by season, player) - 1 as number from (select distinct season, player from fact)")
def _(t: Tables) -> DataFrame:
    """Numbers in sorted order without one task for all rows: counts of the seasons before, and the place inside."""
    own = t.played.select("season", "player").distinct()
    before = own.groupBy("season").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("season").orderBy("player"))
    return own.join(F.broadcast(before.drop("n")), "season").select("season", "player", (F.col("before") + inside - 1).alias("number"))


@query("set05_season_sets", "select seasons, count(*) as n from (select customer, list_sort(list(distinct season)) as seasons from fact group by 1) group by 1")
def _(t: Tables) -> DataFrame:
    sets = t.played.groupBy("customer").agg(F.array_sort(F.collect_set("season")).alias("seasons"))
    return sets.groupBy("seasons").agg(F.count("*").alias("n"))


@query("set06_difference", "select season, customer from (select distinct season, customer from fact) except select season + 1, customer from fact")
def _(t: Tables) -> DataFrame:
    """Customers of a season whom the season before did not have."""
    return t.fact.select("season", "customer").subtract(t.fact.select(F.col("season") + 1, "customer"))


@query("set07_logged_not_built", "select o_orderkey as game, o_orderstatus = 'P' as accepted from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(t: Tables) -> DataFrame:
    built = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(built, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("game"), (F.col("o_orderstatus") == "P").alias("accepted"))


@query("set08_complete_folds", "select season, list_sort(list(distinct fold)) = [0, 1, 2, 3, 4] as complete from (select season, (game % 5)::int as fold from fact) group by 1")
def _(t: Tables) -> DataFrame:
    folds = t.played.select("season", (F.col("game") % 5).cast("int").alias("fold"))
    return folds.groupBy("season").agg((F.array_sort(F.collect_set("fold")) == F.array(*map(F.lit, range(5)))).alias("complete"))


# ---- time


_GAMES = "games as (select season, day, game, row_number() over (partition by season order by day, game) as rk, count(*) over (partition by season) as n from (select distinct season, day, game from fact))"


@query("tim01_prefix_cut", "select season, max(day)::varchar as until, count(*) as games from games g where day <= (select min(day) from games h where h.season = g.season and rk >= n * 0.5) group by 1", _GAMES)
def _(t: Tables) -> DataFrame:
    own = Window.partitionBy("season")
    games = t.played.select("season", "day", "game").distinct()
    games = games.withColumn("rk", F.row_number().over(own.orderBy("day", "game"))).withColumn("n", F.count("*").over(own))
    cut = F.min(F.when(F.col("rk") >= F.col("n") * 0.5, F.col("day"))).over(own)
    return games.withColumn("cut", cut).where("day <= cut").groupBy("season").agg(F.max("day").cast("string").alias("until"), F.count("*").alias("games"))


@query("tim02_snapshots", "select s.share, g.season, count(*) as games from games g, (select unnest([0.25, 0.5, 0.75])::double as share) s where rk <= n * s.share group by all", _GAMES)
def _(t: Tables) -> DataFrame:
    own = Window.partitionBy("season")
    games = t.played.select("season", "day", "game").distinct()
    games = games.withColumn("rk", F.row_number().over(own.orderBy("day", "game"))).withColumn("n", F.count("*").over(own))
    shares = F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return games.withColumn("share", shares).where(F.col("rk") <= F.col("n") * F.col("share")).groupBy("share", "season").agg(F.count("*").alias("games"))


@query("tim04_latest_closed", "select max(season) as season from (select season, max(month(day)) as m from fact group by 1) where m = 12")
def _(t: Tables) -> DataFrame:
    return t.played.groupBy("season").agg(F.max(F.month("day")).alias("m")).where("m = 12").agg(F.max("season").alias("season"))


@query("tim11_past_future", "select day < date '1999-01-01' as past, count(*) as n, count(distinct game) as games from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.played.groupBy((F.col("day") < "1999-01-01").alias("past")).agg(F.count("*").alias("n"), F.countDistinct("game").alias("games"))


@query("tim13_possessions", """select user_id, poss::bigint as poss, count(*) as n, round(sum(case when event_type in ('click', 'view') then value else 0 end), 4) as value, max(case when event_type in ('purchase', 'error') then event_type end) as ending from (
  select *, coalesce(sum((event_type in ('purchase', 'error'))::int) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as poss from ev) x group by user_id, x.poss""", EVENTS)
def _(t: Tables) -> DataFrame:
    """The state machine's native form: a possession ends with a purchase or an error."""
    return machine.possessions(micros(t.events), ["user_id"], ["us", "event_id"])


@query("tim13_possessions_stateful", """select user_id, poss::bigint as poss, count(*) as n, round(sum(case when event_type in ('click', 'view') then value else 0 end), 4) as value, max(case when event_type in ('purchase', 'error') then event_type end) as ending from (
  select *, coalesce(sum((event_type in ('purchase', 'error'))::int) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as poss from ev) x group by user_id, x.poss""", EVENTS)
def _(t: Tables) -> DataFrame:
    """The same by a fold over ordered batches with state carried between them."""
    return machine.possessions_folded(micros(t.events), "user_id")


@query("tim13_possessions_streamed", """select (epoch_us(date_trunc('hour', ts)) // 1000000)::bigint as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2""")
def _(t: Tables) -> DataFrame:
    """Hourly counts by a drained stream with a watermark; the final table equals the batch one."""
    return stream.hourly_counts(t.spark, f"{t.root}/events.parquet")


@query("tim15_last_ten", """select team, game, round(sum(poss) over (partition by team order by day, game rows between 10 preceding and 1 preceding), 4) as last_ten from (select team, day, game, sum(poss) as poss from fact group by all)""")
def _(t: Tables) -> DataFrame:
    own = t.fact.groupBy("team", "day", "game").agg(F.sum("poss").alias("poss"))
    return own.select("team", "game", r(F.sum("poss").over(Window.partitionBy("team").orderBy("day", "game").rowsBetween(-10, -1))).alias("last_ten"))


# ---- more windows, sorts and sets


@query("win21_demeaned_scaled", "select game, player, line, part, round(sqrt(poss) * (pts / 1000 - avg(pts / 1000) over (partition by game, team)), 3) as x from fact")
def _(t: Tables) -> DataFrame:
    y = F.col("pts") / 1000
    return t.fact.select("game", "player", "line", "part", r(F.sqrt("poss") * (y - F.avg(y).over(Window.partitionBy("game", "team"))), 3).alias("x"))


@query("win23_team_mean_or_own", "select season, player, round(case when count(*) over w >= 4 then sum(pts) over w / sum(poss) over w else pts / poss end, 4) as rate from player_season window w as (partition by season, team)")
def _(t: Tables) -> DataFrame:
    team = Window.partitionBy("season", "team")
    rate = F.when(F.count("*").over(team) >= 4, F.sum("pts").over(team) / F.sum("poss").over(team)).otherwise(F.col("pts") / F.col("poss"))
    return t.player_season.select("season", "player", r(rate).alias("rate"))


@query("win27_blowout_weight", "select player, round(sum(case when abs(poss - 25) >= 20 then 0.5 * poss else poss end), 4) as weighted from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.lines.groupBy("player").agg(r(F.sum(F.when(F.abs(F.col("poss") - 25) >= 20, 0.5 * F.col("poss")).otherwise(F.col("poss")))).alias("weighted"))


@query("win28_mean_until_season", "select season, player, round(coalesce(case when games >= 60 then pts / poss end, (select avg(pts / poss) from player_season where games >= 60 and season <= 1998)), 4) as rate from player_season")
def _(t: Tables) -> DataFrame:
    rate = F.col("pts") / F.col("poss")
    mean = t.player_season.where("games >= 60 and season <= 1998").agg(F.avg(rate).alias("mean"), F.lit(1).alias("one"))
    return t.player_season.join(F.broadcast(mean), F.lit(1) == F.col("one")).select("season", "player", r(F.coalesce(F.when(F.col("games") >= 60, rate), F.col("mean"))).alias("rate"))


@query("win29_pair_sums_by_fold", """select fold, count(*) as pairs, round(sum(x), 2) as total from (select distinct on (a.game, a.player, b.player, f.fold) a.game, f.fold, a.p * b.p as x from own a join own b on a.game = b.game and a.player < b.player
  join (select unnest([0, 1, 2]) as fold) f on f.fold in (a.player % 3, b.player % 3)) group by 1""", "own as (select game, player, sum(poss) as p from fact group by all)")
def _(t: Tables) -> DataFrame:
    """Products of a game's pairs, once for each fold that either player is in; pairs come from the game's own array."""
    own = t.lines.groupBy("game", "player").agg(F.sum("poss").alias("p"))
    sets = own.groupBy("game").agg(F.array_sort(F.collect_list(F.struct("player", "p"))).alias("e"))
    left = sets.select("e", F.posexplode("e").alias("at", "a"))
    pairs = left.select("a", F.explode(F.slice("e", F.col("at") + 2, F.size("e") - F.col("at"))).alias("b"))
    folds = F.explode(F.array_distinct(F.array(F.pmod("a.player", F.lit(3)), F.pmod("b.player", F.lit(3)))))
    return pairs.select((F.col("a.p") * F.col("b.p")).alias("x"), folds.alias("fold")).groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("pairs"), r(F.sum("x"), 2).alias("total"))


@query("srt01_stable_sort", "select game, player, (row_number() over (partition by game order by line, player, part, poss, pts))::int as seq from fact")
def _(t: Tables) -> DataFrame:
    return t.lines.select("game", "player", F.row_number().over(Window.partitionBy("game").orderBy("line", "player", "part", "poss", "pts")).alias("seq"))


@query("srt04_two_key_rank", "select team, (row_number() over (order by best desc, first, team))::int as place from (select team, max(poss) as best, min(season) as first from player_season group by 1)")
def _(t: Tables) -> DataFrame:
    teams = t.player_season.groupBy("team").agg(F.max("poss").alias("best"), F.min("season").alias("first"))
    return teams.select("team", F.row_number().over(Window.orderBy(F.desc("best"), "first", "team")).alias("place"))


@query("srt05_own_rank", """select vec_id, 1 + count(*) filter (where not same and d < own) as place from (select *, min(d) filter (where same and vec_id <> near) over (partition by vec_id) as own from (
  select a.vec_id, b.vec_id as near, a.label = b.label as same, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 5) as d
  from embeddings a cross join embeddings b where a.vec_id % 20 = 0)) where own is not null group by 1""")
def _(t: Tables) -> DataFrame:
    """For a stated query set: where its nearest row of the same label ranks among all rows of other labels."""
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").alias("vector"))
    return N.own_rank(rows.where("vec_id % 20 = 0"), rows)


@query("srt08_top_starters", "select player from (select player, count(distinct game) as g, sum(poss) as p from fact group by 1) order by g desc, p desc, player limit 150")
def _(t: Tables) -> DataFrame:
    own = t.lines.groupBy("player").agg(F.countDistinct("game").alias("g"), F.sum("poss").alias("p"))
    return own.orderBy(F.desc("g"), F.desc("p"), "player").limit(150).select("player")


@query("srt10_near_season_mean", "select season, round(avg(rate), 4) as mean from (select a.season, b.rate, row_number() over (partition by a.season order by abs(a.season - b.season), b.season) as rk from yearly a join yearly b on a.season <> b.season) where rk <= 4 group by 1", "yearly as (select season, sum(pts) / sum(poss) as rate from fact group by 1)")
def _(t: Tables) -> DataFrame:
    yearly = t.played.groupBy("season").agg((F.sum("pts") / F.sum("poss")).alias("rate"))
    every = yearly.agg(F.array_sort(F.collect_list(F.struct("season", "rate"))).alias("all"))
    pairs = yearly.select("season").join(F.broadcast(every)).select("season", F.explode("all").alias("o")).where("season <> o.season")
    near = Q.top(pairs, ["season"], [F.abs(F.col("season") - F.col("o.season")), F.col("o.season")], 4)
    return near.groupBy("season").agg(r(F.avg("o.rate")).alias("mean"))


@query("srt13_renamed", "select season, player as player_id, round(poss, 2) as possessions from player_season")
def _(t: Tables) -> DataFrame:
    names = {"season": "season", "player": "player_id", "poss": "possessions"}
    rows = t.player_season.withColumn("poss", r("poss", 2))
    return rows.select([F.col(c).alias(n) for c, n in names.items()])


@query("set02_renumbered_union", "select part, (dense_rank() over (order by part) - 1)::bigint as number from (select distinct part from fact)")
def _(t: Tables) -> DataFrame:
    """Pieces a season and phase, united; their parts get numbers in sorted order."""
    pieces = [t.played.where((F.col("phase") == p) & (F.col("season") % 2 == k)).select("part") for p in ("RS", "PO") for k in (0, 1)]
    return Q.numbered(reduce(DataFrame.union, pieces).distinct(), "part", "number")


@query("set04_neighbour_seasons", "select customer, list_sort(list_filter([min(season) - 1, max(season) + 1], lambda s: s between 1995 and 2001)) as wanted from fact group by 1")
def _(t: Tables) -> DataFrame:
    own = t.played.groupBy("customer").agg(F.array(F.min("season") - 1, F.max("season") + 1).alias("s"))
    return own.select("customer", F.array_sort(F.filter("s", lambda x: x.between(1995, 2001))).alias("wanted"))


@query("set09_dealt_seasons", "select season, ((row_number() over (order by season) - 1) % 3)::int as worker from (select distinct season from fact)")
def _(t: Tables) -> DataFrame:
    seasons = t.played.select("season").distinct()
    return seasons.select("season", ((F.row_number().over(Window.orderBy("season")) - 1) % 3).alias("worker"))


@query("set11_seasons_by_share", "select season, share, round(sum(poss) * share, 4) as poss from fact, (select unnest([0.25, 0.5, 1.0])::double as share) group by season, share")
def _(t: Tables) -> DataFrame:
    seasons = t.played.groupBy("season").agg(F.sum("poss").alias("p"))
    return seasons.select("season", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0)))).alias("share"), "p").select("season", "share", r(F.col("p") * F.col("share")).alias("poss"))


@query("set12_checks_union", "select 'fact' as what, count(*) > 0 as ok, null::double as value from fact union all select 'mean', null, round(avg(poss), 6) from fact")
def _(t: Tables) -> DataFrame:
    flags = t.fact.agg(F.lit("fact").alias("what"), (F.count("*") > 0).alias("ok"), F.lit(None).cast("double").alias("value"))
    return flags.unionByName(t.fact.agg(F.lit("mean").alias("what"), F.lit(None).cast("boolean").alias("ok"), r(F.avg("poss"), 6).alias("value")))
