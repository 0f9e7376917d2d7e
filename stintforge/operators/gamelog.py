"""Game logs to possessions: a fold over ordered plays with the rules of the game.

Plays (game, seq, period, team, player, action, detail, value) of one game are read in order; team and player are
null where a play has none.  Actions are ``shot`` (detail made or missed, value what it counts), ``rebound``,
``turnover``, ``free_throw`` (detail ``made 1 of 2`` and so on, a single one where it says no count; ``technical`` or ``retained`` among its words),
``foul`` (detail shooting, personal, technical), ``sub`` (detail in or out), ``jump`` and ``period`` (detail start or
end).  A possession is one team's turn; it ends with a made shot (unless a shooting foul of the other side follows
at once), a defensive rebound, a turnover, a last made free throw, a won jump ball, the end of a period, or by
force, when the other team acts although nothing ended it.

A possession is credited to the players on the court when it ends; one that ends inside a free-throw trip, to those on
the court at the made shot of an extra throw, else at the foul.  An offensive rebound (a continuation) after which
nothing is attempted is dead, but a team's rebound (without a player) as the period expires is taken back instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("game", "seq", "period", "team", "player", "action", "detail", "value")
SCHEMA = "game long, number long, period int, team long, first_seq long, last_seq long, points long, attempts int, rebounds int, retained int, dead int, reason string, offence array<long>, defence array<long>, twos int, two_makes int, threes int, three_makes int, throws int, throw_makes int"


@dataclass
class Possession:
    team: int
    period: int
    first: int
    last: int
    points: int = 0
    attempts: int = 0
    rebounds: int = 0
    retained: int = 0
    dead: int = 0
    idle: bool = False  # continued, and nothing attempted since
    by_team: bool = False  # the last continuation was a team's rebound
    at_shot: tuple[list[int], list[int]] | None = None
    twos: int = 0
    two_makes: int = 0
    threes: int = 0
    three_makes: int = 0
    throws: int = 0
    throw_makes: int = 0


class Game:
    """The state of one game between plays."""

    def __init__(self, game: int, five: int | None = None):
        self.five = five  # so many players make a lineup; any number where it is not given
        self.game, self.number, self.period, self.seq = game, 0, 1, 0
        self.open: Possession | None = None
        self.court: dict[int, set[int]] = {}
        self.loose = False  # a miss waits for its rebound
        self.made = False  # a made shot may still get its extra free throw
        self.trip: Possession | None = None  # whose free throws are being shot
        self.at_foul: tuple[list[int], list[int]] | None = None  # lineups at the last foul that gave a trip, shooters first
        self.credit: tuple[list[int], list[int]] | None = None  # lineups of the trip under way
        self.held: dict[int, int] = {}  # technical points that wait for their team's next turn
        self.done: list[tuple] = []

    # possessions

    def lineups(self, team: int) -> tuple[list[int] | None, list[int] | None]:
        """The team's players on the court and the others; None where they are not as many as make a lineup."""
        others = [p for t, s in self.court.items() if t != team for p in s]
        both = sorted(self.court.get(team, ())), sorted(others)
        return tuple(x if self.five is None or len(x) == self.five else None for x in both)

    def turn(self, team: int) -> Possession:
        """The open possession of ``team``; the other team's is closed, by force if nothing ended it."""
        if self.open is not None and self.open.team != team:
            self.close("made_fg" if self.made else "forced")
        if self.open is None:
            self.open = Possession(team, self.period, self.seq, self.seq)
            self.open.points += self.held.pop(team, 0)
        self.open.last = self.seq
        return self.open

    def close(self, reason: str) -> None:
        p = self.open
        if p is not None:
            self.settle(p, reason)
            offence, defence = (self.credit if reason == "made_ft" else None) or self.lineups(p.team)
            self.done.append((self.game, self.number, p.period, p.team, p.first, p.last, p.points, p.attempts, p.rebounds, p.retained, p.dead, reason, offence, defence, p.twos, p.two_makes, p.threes, p.three_makes, p.throws, p.throw_makes))
            self.number += 1
        self.open, self.trip, self.loose, self.made, self.credit = None, None, False, False, None

    @staticmethod
    def settle(p: Possession, reason: str) -> None:
        """The last continuation, if nothing was attempted after it."""
        if p.idle and p.by_team and reason == "period_end":
            p.rebounds -= 1
        elif p.idle:
            p.dead += 1

    # plays

    def take(self, seq: int, period: int, team: int | None, player: int | None, action: str, detail: str, value: int) -> None:
        self.seq, self.period = seq, period
        if self.made and action not in ("foul", "free_throw", "sub"):
            self.close("made_fg")
        if team is not None and player is not None and action != "sub":
            self.court.setdefault(team, set()).add(player)
        handler = getattr(self, f"on_{action}", None)
        if handler is not None and (team is not None or action == "period"):
            handler(team, player, detail or "", value or 0)

    def on_shot(self, team, player, detail, value) -> None:
        p = self.turn(team)
        p.attempts += 1
        kind = "three" if value == 3 else "two"
        setattr(p, f"{kind}s", getattr(p, f"{kind}s") + 1)
        setattr(p, f"{kind}_makes", getattr(p, f"{kind}_makes") + (detail == "made"))
        p.idle, p.at_shot = False, None
        if detail == "made":
            p.points += value
            p.at_shot = self.lineups(team)
            self.made, self.loose = True, False
        else:
            self.loose = True

    def on_rebound(self, team, player, detail, value) -> None:
        if self.open is None or not self.loose:
            return
        if team == self.open.team:
            self.open.rebounds += 1
            self.open.idle, self.open.by_team = True, player is None
            self.open.last, self.loose = self.seq, False
        else:
            self.open.last = self.seq
            self.close("dreb")

    def on_turnover(self, team, player, detail, value) -> None:
        self.turn(team)
        self.close("turnover")

    def on_jump(self, team, player, detail, value) -> None:
        if self.open is not None and team != self.open.team:
            self.close("jump_ball")

    def on_foul(self, team, player, detail, value) -> None:
        if "technical" in detail:
            return
        self.at_foul = self.lineups(team)[::-1]
        if self.made and self.open is not None and (team == self.open.team or "shooting" not in detail):
            self.close("made_fg")
        if self.open is not None and team != self.open.team and "shooting" in detail:
            self.trip, self.made = self.open, False

    def on_free_throw(self, team, player, detail, value) -> None:
        words = detail.split()
        made = "made" in words
        if "technical" in words:
            if self.open is not None and self.open.team == team:
                self.open.points += made
            else:
                self.held[team] = self.held.get(team, 0) + made
            return
        p = self.turn(team)
        self.made = False
        count = re.search(r"(\d+) of (\d+)", detail)
        first, last = (count[1] == "1", int(count[1]) >= int(count[2])) if count else (True, True)
        if first:
            self.credit = p.at_shot or self.at_foul
            p.idle = False
            if self.trip is None:
                p.attempts += 1  # a trip without a shot before it
        self.trip = p
        p.points += made
        p.throws, p.throw_makes = p.throws + 1, p.throw_makes + made
        if last:
            self.trip = self.at_foul = p.at_shot = None
            if "retained" in words:
                p.retained += 1
            elif made:
                self.close("made_ft")
            else:
                self.loose = True

    def on_sub(self, team, player, detail, value) -> None:
        five = self.court.setdefault(team, set())
        if detail == "in":
            five.add(player)
        else:
            five.discard(player)

    def on_period(self, team, player, detail, value) -> None:
        if detail == "end":
            self.finish()
            self.court.clear()

    def finish(self) -> list[tuple]:
        """Close what is open; technical points that found no later turn go to the team's last possession."""
        if self.open is not None:
            self.close("made_fg" if self.made else "period_end")
        for team, points in list(self.held.items()):
            for k in range(len(self.done) - 1, -1, -1):
                if self.done[k][3] == team:
                    self.done[k] = (*self.done[k][:6], self.done[k][6] + points, *self.done[k][7:])
                    del self.held[team]
                    break
        return self.done


def possessions(plays: DataFrame, five: int | None = None) -> DataFrame:
    """Possessions of every game.  Plays stream through a task sorted; one game's state is held at a time.

    With ``five`` a possession's lineups are null unless so many players of the side are known to be on the court.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Game | None = None
        for batch in batches:
            out: list[tuple] = []
            for game, *play in zip(*[batch.column(c).to_pylist() for c in COLUMNS], strict=True):
                if own is None or game != own.game:
                    if own is not None:
                        out += own.finish()
                    own = Game(game, five)
                own.take(*play)
            yield rows_of(out)
        if own is not None:
            yield rows_of(own.finish())

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        longs = pa.int64()
        kinds = [longs, longs, pa.int32(), longs, longs, longs, longs, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(longs), pa.list_(longs), *[pa.int32()] * 6]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    cast = [F.col(c).cast("long") if c in ("game", "seq", "team", "player", "value") else F.col(c) for c in COLUMNS]
    ordered = plays.select(*[c.alias(n) for c, n in zip(cast, COLUMNS, strict=True)]).repartition("game").sortWithinPartitions("game", "seq")
    return ordered.mapInArrow(run, SCHEMA)


def starters(plays: DataFrame) -> DataFrame:
    """(game, period, team, starters): players whose first play of a period is not their coming in."""
    acts = plays.where("player is not null and team is not null")
    came = F.min(F.when((F.col("action") == "sub") & (F.col("detail") == "in"), F.col("seq")))
    own = acts.groupBy("game", "period", "team", "player").agg(F.min("seq").alias("first"), came.alias("came"))
    began = own.where("came is null or first < came")
    return began.groupBy("game", "period", "team").agg(F.array_sort(F.collect_set("player")).alias("starters"))


def starters_with_box(plays: DataFrame, box: DataFrame, five: int = 5) -> DataFrame:
    """(game, period, team, starters, rule): starters by first plays, else from box scores, else null.

    ``box`` is (game, period, team, played), the sorted players of a period's box score.  Where the plays do not give
    ``five``, the period's box must: those who played and did not come on, with those found by plays.  Where that is
    not five either, the starters stay unknown.
    """
    came = plays.where("action = 'sub' and detail = 'in'").groupBy("game", "period", "team").agg(F.collect_set("player").alias("came"))
    keys = ["game", "period", "team"]
    none = F.array().cast("array<bigint>")
    rows = box.join(starters(plays), keys, "left").join(came, keys, "left").select(*keys, "played", F.coalesce("starters", none).alias("found"), F.coalesce("came", none).alias("came"))
    union = F.array_sort(F.array_union(F.array_except("played", F.array_except("came", "found")), "found"))
    rule = F.when(F.size("found") == five, "plays").when(F.size(union) == five, "box")
    return rows.select(*keys, F.when(F.size("found") == five, F.col("found")).when(F.size(union) == five, union).alias("starters"), rule.alias("rule"))


def from_lines(fact: DataFrame) -> DataFrame:
    """A synthetic game log from the fact relation: every line becomes a play or two, in a fixed order."""
    from pyspark.sql import Window

    order = Window.partitionBy("game").orderBy("line", "player", "part", "poss", "pts")
    lines = fact.withColumn("k", F.row_number().over(order))
    kind, team, other = F.pmod("part", F.lit(10)), F.pmod("player", F.lit(2)), F.pmod(F.floor(F.col("part") / 10), F.lit(2))
    made, value = F.col("flag") != "N", F.when(F.col("poss") > 35, 3).otherwise(2)

    def play(place: int, team_, action, detail, points):
        return F.struct((F.col("k") * 4 + place).alias("seq"), team_.alias("team"), F.lit(action).alias("action"), detail.alias("detail"), points.cast("long").alias("value"))

    none = F.lit(0)
    shot = play(0, team, "shot", F.when(made, "made").otherwise("missed"), value)
    board = play(1, other, "rebound", F.lit(""), none)
    throws = [play(i, team, "free_throw", F.concat(F.when(good, "made ").otherwise("missed "), F.lit(f"{i} of 2")), none) for i, good in ((1, made), (2, F.col("status") == "F"))]
    plays = (
        F.when((kind <= 5) & made, F.array(shot)).when(kind <= 5, F.array(shot, board)).when(kind == 6, F.array(play(0, team, "turnover", F.lit(""), none)))
        .when(kind == 7, F.array(play(0, 1 - team, "foul", F.lit("shooting"), none), *throws)).when(kind == 8, F.array(play(0, team, "sub", F.when(made, "in").otherwise("out"), none)))
        .otherwise(F.array(play(0, team, "jump", F.lit(""), none)))
    )
    return lines.select("game", F.lit(1).alias("period"), F.col("player"), F.explode(plays).alias("p")).select("game", "p.seq", "period", "p.team", "player", "p.action", "p.detail", "p.value")
