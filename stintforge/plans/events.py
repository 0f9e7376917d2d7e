"""The event machine on game logs (PSM), and its streaming twin (TIM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintforge.operators import gamelog, machine
from stintforge.operators import sequences as Q
from stintforge.plans.ordered import EVENTS
from stintforge.plans.registry import query
from stintforge.sources.tables import Tables
from stintforge.streaming import machine as streamed

_PLAYS = """numbered as (select *, row_number() over (partition by game order by line, player, part, poss, pts) as k, (part % 10)::int as kind, (player % 2)::bigint as side from fact),
points as (select game, side, sum(case when kind <= 5 and flag <> 'N' then case when poss > 35 then 3 else 2 end when kind = 7 then (flag <> 'N')::int + (status = 'F')::int else 0 end)::bigint as points from numbered group by all)"""


def found(t: Tables) -> DataFrame:
    return gamelog.possessions(gamelog.from_lines(t.fact))


@query("psm06_points", "select game, side as team, points from points where points > 0", _PLAYS)
def _(t: Tables) -> DataFrame:
    """What possessions score is what shots and free throws scored."""
    return found(t).groupBy("game", "team").agg(F.sum("points").alias("points")).where("points > 0")


@query("psm06_counters", """select game, side as team, sum((kind <= 5 and poss <= 35)::int)::bigint as twos, sum((kind <= 5 and poss <= 35 and flag <> 'N')::int)::bigint as two_makes, sum((kind <= 5 and poss > 35)::int)::bigint as threes,
  sum((kind <= 5 and poss > 35 and flag <> 'N')::int)::bigint as three_makes, sum((kind = 7)::int * 2)::bigint as throws, sum(case when kind = 7 then (flag <> 'N')::int + (status = 'F')::int else 0 end)::bigint as throw_makes from numbered where kind <= 7 group by all""", _PLAYS)
def _(t: Tables) -> DataFrame:
    """Tries and makes by kind over a side's possessions."""
    return found(t).groupBy("game", "team").agg(*[F.sum(c).alias(c) for c in ("twos", "two_makes", "threes", "three_makes", "throws", "throw_makes")])


@query("psm06_shooters", """select game, side as team, player, count(*) as tries, sum((flag <> 'N')::int)::bigint as makes, sum((poss > 35)::int)::bigint as threes from numbered where kind <= 5 group by all""", _PLAYS)
def _(t: Tables) -> DataFrame:
    """Tries, makes and threes of each shooter, from the plays."""
    shots = gamelog.from_lines(t.lines).where("action = 'shot'")
    return shots.groupBy("game", "team", "player").agg(F.count("*").alias("tries"), F.count_if(F.col("detail") == "made").alias("makes"), F.count_if(F.col("value") == 3).alias("threes"))


@query("psm07_turnovers", "select game, count(*) as turnovers from numbered where kind = 6 group by 1", _PLAYS)
def _(t: Tables) -> DataFrame:
    return found(t).where("reason = 'turnover'").groupBy("game").agg(F.count("*").alias("turnovers"))


@query("psm12_attempts", "select game, side as team, sum(counted)::bigint as attempts from (select game, side, 1 as counted from numbered where kind <= 5 union all select t.game, t.side, case when e.open = t.side and j.lost is null then 0 else 1 end from trips t left join before e on t.game = e.game and t.no = e.no + 1 left join lost j on j.game = t.game and j.no = t.no) group by all",
       _PLAYS + """, counted as (select *, coalesce(sum((kind <= 7)::int) over (partition by game order by k rows between unbounded preceding and 1 preceding), 0) + 1 as no from numbered),
  trips as (select game, side, no from counted where kind = 7),
  before as (select game, no, kind <= 5 and flag <> 'N' as made, case when kind <= 5 then case when flag <> 'N' or part // 10 % 2 = side then side end when kind = 7 and status <> 'F' then side end as open from counted where kind <= 7),
  lost as (select distinct c.game, c.no, 1 as lost from counted c join before e on c.game = e.game and c.no = e.no + 1 where c.kind = 9 and (e.made or c.side <> e.open))""")
def _(t: Tables) -> DataFrame:
    """Attempts as the machine counts them: shots, and trips but for those whose foul the open possession of the shooters drew."""
    return found(t).groupBy("game", "team").agg(F.sum("attempts").alias("attempts")).where("attempts > 0")


@query("psm08_endings")
def _(t: Tables) -> DataFrame:
    return found(t).groupBy("reason").agg(F.count("*").alias("n"), F.sum("points").alias("points"), F.sum("rebounds").alias("rebounds"))


@query("psm16_attempt_identity", "select 0::bigint as broken")
def _(t: Tables) -> DataFrame:
    """In a possession every attempt but the first needs a rebound or a retained ball, so continuations never exceed attempts."""
    return found(t).agg(F.count_if(F.col("rebounds") + F.col("retained") - F.col("dead") > F.greatest(F.col("attempts"), F.lit(0))).alias("broken"))


@query("psm02_starters", """select game, 1::int as period, side as team, list_sort(list(distinct player)) as starters from (select game, side, player, min(first) as first, min(came) as came from (
  select game, player, case when kind <= 5 or kind in (6, 8, 9) then side end as side, k * 4 as first, case when kind = 8 and flag <> 'N' then k * 4 end as came from numbered where kind <> 7
  union all select game, player, (part // 10 % 2)::bigint, k * 4 + 1, null from numbered where kind <= 5 and flag = 'N' union all select game, player, 1 - side, k * 4, null from numbered where kind = 7
  union all select game, player, side, k * 4 + 1, null from numbered where kind = 7) group by 1, 2, 3) where came is null or first < came group by game, side""", _PLAYS)
def _(t: Tables) -> DataFrame:
    return gamelog.starters(gamelog.from_lines(t.fact))


@query("psm04_lineup_stints")
def _(t: Tables) -> DataFrame:
    """Runs of possessions with the same players on both sides."""
    both = found(t).withColumn("five", F.to_json(F.array_sort(F.array("offence", "defence"))))
    runs = Q.islands(both, ["game"], ["number"], ["five"])
    return runs.groupBy("game", "island").agg(F.count("*").alias("possessions"), F.sum("points").alias("points"))


@query("psm01_starters_with_box")
def _(t: Tables) -> DataFrame:
    """Starters by first plays; where these are not two, from the players of the box score."""
    plays = gamelog.from_lines(t.fact)
    box = plays.where("player is not null").groupBy("game", "period", "team").agg(F.array_sort(F.collect_set("player")).alias("played"))
    return gamelog.starters_with_box(plays, box, 2)


@query("psm05_jump_balls")
def _(t: Tables) -> DataFrame:
    return found(t).where("reason = 'jump_ball'").groupBy("game", "team").agg(F.count("*").alias("lost"))


@query("psm09_free_throws", "select game, side as team, count(*) as ended, sum((flag <> 'N')::int + 1)::bigint as scored from numbered where kind = 7 and status = 'F' group by game, side", _PLAYS)
def _(t: Tables) -> DataFrame:
    """Every trip whose last throw is made ends its possession; that possession holds the trip's points beside those of its shots."""
    plays = gamelog.from_lines(t.fact)
    ended = gamelog.possessions(plays).where("reason = 'made_ft'").select("game", "team", "first_seq", "last_seq")
    throws = plays.where("action = 'free_throw'").select("game", "team", "seq", F.startswith("detail", F.lit("made")).cast("int").alias("made"), (F.col("seq") - F.pmod("seq", F.lit(4))).alias("trip"))
    whole = throws.groupBy("game", "team", "trip").agg(F.max("seq").alias("last_seq"), F.sum("made").alias("made"))
    return ended.join(whole, ["game", "team", "last_seq"]).groupBy("game", "team").agg(F.count("*").alias("ended"), F.sum("made").alias("scored"))


@query("psm10_technical_points", """select game, side as team, sum(case when kind <= 5 and flag <> 'N' then case when poss > 35 then 3 else 2 end when kind = 7 and flag <> 'N' then 1 else 0 end)::bigint as points from numbered where kind <= 7 group by game, side having count(*) filter (where kind <= 6) > 0""", _PLAYS)
def _(t: Tables) -> DataFrame:
    """Technical throws in place of trips: their points reach a turn of the team, a later or an earlier one."""
    plays = gamelog.from_lines(t.fact).where("action <> 'foul' and detail not like '%2 of 2'")
    technical = F.when(F.col("action") == "free_throw", F.concat(F.split_part("detail", F.lit(" "), F.lit(1)), F.lit(" 1 of 1 technical"))).otherwise(F.col("detail"))
    return gamelog.possessions(plays.withColumn("detail", technical)).groupBy("game", "team").agg(F.sum("points").alias("points"))


@query("psm11_trip_lineups")
def _(t: Tables) -> DataFrame:
    """Whom possessions that ended inside a trip are credited to."""
    return found(t).where("reason = 'made_ft'").select("game", "number", "team", "offence", "defence")


@query("psm13_foul_kinds")
def _(t: Tables) -> DataFrame:
    """Attempts and endings when every other foul before a trip is not a shooting foul."""
    plays = gamelog.from_lines(t.fact)
    kind = F.when((F.col("action") == "foul") & (F.col("seq") % 8 == 0), "personal").otherwise(F.col("detail"))
    return gamelog.possessions(plays.withColumn("detail", kind)).groupBy("reason").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("psm14_one_open_end", "select 0::bigint as broken")
def _(t: Tables) -> DataFrame:
    """A game of one period has at most one possession that the period's end closed, and it is the last."""
    last = F.max("number").over(Window.partitionBy("game"))
    return found(t).withColumn("last", last).agg(F.count_if((F.col("reason") == "period_end") & (F.col("number") != F.col("last"))).alias("broken"))


@query("psm15_continuations", "select 0::bigint as broken")
def _(t: Tables) -> DataFrame:
    """At most the last continuation of a possession is dead, and only where there was one."""
    return found(t).agg(F.count_if((F.col("dead") > 1) | (F.col("dead") > F.col("rebounds"))).alias("broken"))


@query("tim14_start_kinds", """select event_id, user_id, coalesce(last_value(case when event_type in ('purchase', 'error') then event_type end ignore nulls) over b, 'start') as start, poss::bigint as poss, round((us - min(us) over (partition by user_id, poss)) / 1000000.0, 3)::double as seconds
  from (select *, coalesce(sum((event_type in ('purchase', 'error'))::int) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as poss from ev) x window b as (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding)""", EVENTS)
def _(t: Tables) -> DataFrame:
    """How each event's possession began, and the seconds into it."""
    rows = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return machine.within_possessions(rows, ["user_id"], ["us", "event_id"], "us").select("event_id", "user_id", "start", F.col("poss").cast("long").alias("poss"), "seconds")


@query("tim14_possessions_streaming", """select user_id, poss::bigint as poss, count(*) as n, round(sum(case when event_type in ('click', 'view') then value else 0 end), 4) as value, max(case when event_type in ('purchase', 'error') then event_type end) as ending from (
  select *, coalesce(sum((event_type in ('purchase', 'error'))::int) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) as poss from ev) x group by user_id, x.poss having max(case when event_type in ('purchase', 'error') then event_type end) is not null""", EVENTS)
def _(t: Tables) -> DataFrame:
    """The fold as a stateful stream; its closed possessions are the batch's."""
    return streamed.closed_possessions(t.spark, f"{t.root}/events.parquet")
