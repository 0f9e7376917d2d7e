"""Sources, sinks and incremental work (SRC, TIM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintforge.plans.registry import query
from stintforge.plans.relational import r
from stintforge.sources import stores
from stintforge.sources.tables import Tables

_PS = "select season, team, player, poss, games from player_season"


def plain(t: Tables) -> DataFrame:
    return t.player_season.select("season", "team", "player", "poss", "games")


for _name, _kind in (("src34_parquet_sink", "parquet"), ("src35_csv_sink", "csv"), ("src34_json_sink", "json"), ("src34_orc_sink", "orc")):

    @query(_name, _PS)
    def _(t: Tables, kind: str = _kind) -> DataFrame:
        return stores.round_trip(plain(t), kind)


@query("src04_rows_by_file", "select count(*) as n, 1::bigint as files from events")
def _(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.countDistinct(F.col("_metadata.file_name")).alias("files"))


@query("src07_typed_empty", "select game, poss from fact where false")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], "game long, poss double")


@query("src08_evict", "select season, count(*) as n from player_season where season <> 1998 group by 1")
def _(t: Tables) -> DataFrame:
    """A partition's files are deleted; the others are not touched."""
    kept = stores.PartitionStore(t.spark, "season").upsert(plain(t)).evict(1998).read()
    return kept.groupBy("season").agg(F.count("*").alias("n"))


@query("src09_incremental_pull", "select season, count(*) as n from player_season group by 1")
def _(t: Tables) -> DataFrame:
    """Only keys without a partition are fetched in the second pull."""
    store = stores.PartitionStore(t.spark, "season").upsert(plain(t).where("season <= 1997"))
    store.upsert(plain(t).join(F.broadcast(store.missing(plain(t))), "season", "left_semi"))
    return store.read().groupBy("season").agg(F.count("*").alias("n"))


@query("src11_partition_pruned", _PS + " where season in (1996, 1999)")
def _(t: Tables) -> DataFrame:
    store = stores.PartitionStore(t.spark, "season").upsert(plain(t))
    return store.read().where(F.col("season").isin(1996, 1999)).select("season", "team", "player", "poss", "games")


@query("src12_name_dimension", """select c_custkey, coalesce(case when c_custkey % 5 = 0 then null else c_name end, g.name, 'unknown') as name
  from customer left join (select customer, max_by(priority, (season, game)) as name from (select distinct customer, priority, season, game from fact) group by 1) g on c_custkey = g.customer""")
def _(t: Tables) -> DataFrame:
    """Names from one table; those it lacks from the latest game log that has the player."""
    first = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    logs = t.played.groupBy(F.col("customer").alias("c_custkey")).agg(F.max_by("priority", F.struct("season", "game")).alias("logged"))
    return t.customer.join(logs, "c_custkey", "left").select("c_custkey", F.coalesce(first, "logged", F.lit("unknown")).alias("name"))


@query("src14_side_teams", "select game, case when rk = 1 then 'home' else 'away' end as side, team from (select game, team, row_number() over (partition by game order by team) as rk from (select distinct game, team from fact)) where rk <= 2")
def _(t: Tables) -> DataFrame:
    rk = F.row_number().over(Window.partitionBy("game").orderBy("team"))
    sides = t.fact.select("game", "team").distinct().withColumn("rk", rk).where("rk <= 2")
    return sides.select("game", F.when(F.col("rk") == 1, "home").otherwise("away").alias("side"), "team")


@query("src15_resigned", "select season, player, round(-pts / poss, 4) as d from player_season")
def _(t: Tables) -> DataFrame:
    return t.player_season.select("season", "player", r(-F.col("pts") / F.col("poss")).alias("d"))


@query("src17_phase_union_checked", "select season, game, min(phase) as phase, min(team) as team from fact group by all")
def _(t: Tables) -> DataFrame:
    """Regular season then playoffs, with teams joined; a row without a team is an error."""
    games = t.fact.groupBy("season", "game").agg(F.min("phase").alias("phase"))
    teams = t.fact.groupBy("game").agg(F.min("team").alias("team"))
    both = games.where("phase = 'RS'").unionByName(games.where("phase = 'PO'")).join(teams, "game", "left")
    checked = F.when(F.col("team").isNull(), F.raise_error(F.lit("a game has no team")).cast("int")).otherwise(F.col("team"))
    return both.select("season", "game", "phase", checked.alias("team"))


@query("src18_schema_probe", "select 'l_orderkey' as name, true as there union all select 'l_partkey', true union all select 'l_missing', false")
def _(t: Tables) -> DataFrame:
    have = set(t.lineitem.columns)
    return t.spark.createDataFrame([(c, c in have) for c in ("l_orderkey", "l_partkey", "l_missing")], "name string, there boolean")


@query("src19_stacked_phases", "select phase, season, player, sum(poss)::double as poss from fact group by all")
def _(t: Tables) -> DataFrame:
    own = lambda p: t.played.where(F.col("phase") == p).groupBy("season", "player").agg(F.sum("poss").alias("poss")).withColumn("phase", F.lit(p))
    return own("RS").unionByName(own("PO"))


@query("src22_pairs_of_games", "select a.player as attacker, b.player as defender, count(*) as n from (select distinct game, player from fact) a join (select distinct game, player from fact) b on a.game = b.game and a.player <> b.player group by 1, 2")
def _(t: Tables) -> DataFrame:
    """Ordered pairs inside the asked games, from a game's sorted set, bounded by its few players; a game without lines is an error."""
    asked = t.lineitem.select(F.col("l_orderkey").alias("game")).distinct()
    return pairs_of_games(t.fact, asked)


def pairs_of_games(fact: DataFrame, asked: DataFrame) -> DataFrame:
    """(attacker, defender, n) over the games of ``asked``; raises where ``fact`` has nothing of one."""
    sets = asked.join(fact.groupBy("game").agg(F.collect_set("player").alias("p")), "game", "left")
    missing = sets.where("p is null").limit(5).collect()
    if missing:
        raise ValueError(f"games without lines, among them {[m.game for m in missing]}")
    pairs = sets.select(F.explode("p").alias("attacker"), "p").select("attacker", F.explode("p").alias("defender")).where("attacker <> defender")
    return pairs.groupBy("attacker", "defender").agg(F.count("*").alias("n"))


@query("src24_fold_games", "select (game * 2654435761 % 4294967296 % 5)::int as fold, game % 2 = 0 as fit, count(*) as games from (select distinct game from fact) group by all")
def _(t: Tables) -> DataFrame:
    fold = F.pmod(F.pmod(F.col("game") * 2654435761, F.lit(1 << 32)), F.lit(5)).cast("int")
    return t.lines.select("game").distinct().groupBy(fold.alias("fold"), (F.col("game") % 2 == 0).alias("fit")).agg(F.count("*").alias("games"))


@query("src25_held_back", "select game, sum(poss)::double as poss from fact where game % 5 = 2 group by 1 having sum(poss) > 0")
def _(t: Tables) -> DataFrame:
    return t.lines.where("game % 5 = 2").groupBy("game").agg(F.sum("poss").alias("poss")).where("poss > 0")


@query("src26_stored_sums", "select season, round(sum(pts), 4) as pts from fact group by 1")
def _(t: Tables) -> DataFrame:
    sums = t.played.groupBy("season").agg(r(F.sum("pts")).alias("pts"))
    return stores.round_trip(sums, "parquet")


@query("src28_html_numbers", "select s_suppkey as player, round(s_acctbal / 1000, 1) as offense, round(s_nationkey / 10.0, 1)::double as defense from supplier")
def _(t: Tables) -> DataFrame:
    """Rows of an HTML table; player ids stand in the links, numbers in cells with marks around them."""
    cell = lambda x: F.concat(F.lit('<td class="n"><b>'), F.format_string("%+.1f", x), F.lit("</b></td>"))
    link = F.concat(F.lit('<td><a href="/player/'), F.col("s_suppkey").cast("string"), F.lit('?x=1">'), F.col("s_name"), F.lit("</a></td>"))
    row = F.concat(F.lit("<tr>"), link, cell(F.round(F.col("s_acctbal") / 1000, 1)), cell(F.round(F.col("s_nationkey") / 10.0, 1)), F.lit("</tr>"))
    page = F.concat(F.lit("<html><table><tr><th>Player</th><th>O</th><th>D</th></tr>"), row, F.lit("</table></html>"))
    return html_table(t.supplier.select(page.alias("html")))


def html_table(pages: DataFrame) -> DataFrame:
    """(player, offense, defense) of every table row that links to a player and has two numbers."""
    rows = pages.select(F.explode(F.regexp_extract_all("html", F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("tr"))
    cells = rows.select(F.nullif(F.regexp_extract("tr", "/player/([0-9]+)", 1), F.lit("")).cast("long").alias("player"), F.regexp_extract_all("tr", F.lit("(?s)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("td"))
    number = lambda i: F.regexp_replace(F.get("td", F.lit(i)), "<[^>]*>|[+ ]", "").try_cast("double")
    return cells.where("player is not null").select("player", number(1).alias("offense"), number(2).alias("defense"))


@query("src31_json_lists", "select ts::date as day, event_id, json_extract(props, '$.k')::bigint as v from events")
def _(t: Tables) -> DataFrame:
    """Documents that hold lists of numbers by date: {"2024-01-01": [[event, k]]}."""
    k = F.from_json("props", "k bigint")["k"]
    document = F.to_json(F.create_map(F.date_format("ts", "yyyy-MM-dd"), F.array(F.array("event_id", k))))
    rows = t.events.select(F.explode(F.from_json(document, "map<string,array<array<bigint>>>")).alias("day", "lists")).select("day", F.explode("lists").alias("e"))
    return rows.select(F.col("day").cast("date").alias("day"), F.col("e")[0].alias("event_id"), F.col("e")[1].alias("v"))


@query("tim03_open_seasons", "select season, max(month(day)) < 12 as open from fact group by 1")
def _(t: Tables) -> DataFrame:
    return t.played.groupBy("season").agg((F.max(F.month("day")) < 12).alias("open"))


@query("tim05_late_guard", "select count(*) as n from events where epoch_us(ts) <= (select max(epoch_us(ts)) from events) - 4 * 3600 * 1000000::bigint")
def _(t: Tables) -> DataFrame:
    """Rows of the last four hours are not admitted yet."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    last = t.events.agg(F.max(us).alias("last"))
    return t.events.select(us.alias("us")).join(F.broadcast(last), F.col("us") <= F.col("last") - 4 * 3600 * 1_000_000).agg(F.count("*").alias("n"))


@query("tim06_audit", "select 'gone' as change, count(*) as n from (select distinct game from fact where flag <> 'N' except select game from fact where flag <> 'R') union all select 'new', count(*) from (select distinct game from fact where flag <> 'R' except select game from fact where flag <> 'N')")
def _(t: Tables) -> DataFrame:
    changes = stores.audit(t.fact.where("flag <> 'N'"), t.fact.where("flag <> 'R'"), ["game"])
    return changes.groupBy("change").agg(F.count("*").alias("n"))


@query("tim08_late_arrivals", "select o_orderkey as game, coalesce(x.n, 0) as lines, x.n is null as retry from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) x on o_orderkey = x.l_orderkey")
def _(t: Tables) -> DataFrame:
    have = t.lineitem.groupBy(F.col("l_orderkey").alias("game")).agg(F.count("*").alias("n"))
    return t.orders.select(F.col("o_orderkey").alias("game")).join(have, "game", "left").select("game", F.coalesce("n", F.lit(0)).alias("lines"), F.col("n").isNull().alias("retry"))


@query("tim10_micro_batch_upsert", "select event_type, count(*) as n, round(sum(value), 4) as value from events group by 1")
def _(t: Tables) -> DataFrame:
    """A drained stream replaces its partitions in a store; running a batch again changes nothing."""
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.root).select("event_id", "event_type", "value")
    store = stores.PartitionStore(t.spark, "event_type").upsert_stream(rows)
    return store.read().groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value")).alias("value"))


@query("tim12_prefix_folds", "select (game * 2654435761 % 4294967296 % 5)::int as fold, count(distinct game) as games from fact where day < date '1998-01-01' group by 1")
def _(t: Tables) -> DataFrame:
    fold = F.pmod(F.pmod(F.col("game") * 2654435761, F.lit(1 << 32)), F.lit(5)).cast("int")
    return t.played.where(F.col("day") < "1998-01-01").groupBy(fold.alias("fold")).agg(F.countDistinct("game").alias("games"))
