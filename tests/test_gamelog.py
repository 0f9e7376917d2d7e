"""The rules of the game on hand-made logs."""

from stintforge.operators import gamelog
from stintforge.operators.gamelog import Game


def play(*rows):
    game = Game(1)
    for seq, (team, player, action, detail, value) in enumerate(rows):
        game.take(seq, 1, team, player, action, detail, value)
    return [(p[3], p[6], p[7], p[8], p[9], p[11]) for p in game.finish()]  # team, points, attempts, rebounds, retained, reason


def test_made_shot_ends_a_turn():
    assert play((0, 1, "shot", "made", 2), (1, 9, "turnover", "", 0)) == [(0, 2, 1, 0, 0, "made_fg"), (1, 0, 0, 0, 0, "turnover")]


def test_rebounds():
    log = [(0, 1, "shot", "missed", 0), (0, 2, "rebound", "", 0), (0, 2, "shot", "missed", 0), (1, 9, "rebound", "", 0)]
    assert play(*log) == [(0, 0, 2, 1, 0, "dreb")]


def test_and_one_stays_one_turn():
    log = [(0, 1, "shot", "made", 2), (1, 9, "foul", "shooting", 0), (0, 1, "free_throw", "made 1 of 1", 0), (1, 9, "turnover", "", 0)]
    assert play(*log) == [(0, 3, 1, 0, 0, "made_ft"), (1, 0, 0, 0, 0, "turnover")]


def test_missed_last_free_throw_waits_for_its_rebound():
    log = [(1, 9, "foul", "shooting", 0), (0, 1, "free_throw", "made 1 of 2", 0), (0, 1, "free_throw", "missed 2 of 2", 0), (1, 9, "rebound", "", 0)]
    assert play(*log) == [(0, 1, 1, 0, 0, "dreb")]


def test_retained_ball():
    log = [(0, 1, "free_throw", "made 1 of 2 retained", 0), (0, 1, "free_throw", "made 2 of 2 retained", 0), (0, 1, "shot", "made", 3)]
    assert play(*log) == [(0, 5, 2, 0, 1, "made_fg")]


def test_technical_points_wait_for_a_turn_or_go_back():
    log = [(0, 1, "shot", "missed", 0), (1, 9, "free_throw", "made 1 of 1 technical", 0), (1, 9, "rebound", "", 0), (1, 9, "shot", "made", 2)]
    assert play(*log) == [(0, 0, 1, 0, 0, "dreb"), (1, 3, 1, 0, 0, "made_fg")]
    late = [(0, 1, "turnover", "", 0), (1, 9, "shot", "made", 2), (0, 1, "free_throw", "made 1 of 1 technical", 0)]
    assert [p[:2] for p in play(*late)] == [(0, 1), (1, 2)]


def test_forced_change_and_jump_ball():
    log = [(0, 1, "shot", "missed", 0), (1, 9, "shot", "missed", 0), (0, 2, "jump", "", 0), (0, 2, "turnover", "", 0)]
    assert [(p[0], p[-1]) for p in play(*log)] == [(0, "forced"), (1, "jump_ball"), (0, "turnover")]


def test_period_end_and_lineups():
    game = Game(1)
    rows = [(0, 1, "sub", "in", 0), (0, 2, "sub", "in", 0), (0, 1, "sub", "out", 0), (1, 9, "sub", "in", 0), (0, 2, "shot", "missed", 0), (None, None, "period", "end", 0)]
    for seq, row in enumerate(rows):
        game.take(seq, 1, *row)
    (only,) = game.done
    assert only[11:14] == ("period_end", [2], [9])


def test_trip_is_credited_to_the_players_at_the_foul_or_the_made_shot():
    game = Game(1)
    rows = [(0, 1, "sub", "in", 0), (1, 9, "foul", "shooting", 0), (0, 1, "free_throw", "made 1 of 2", 0), (0, 1, "sub", "out", 0), (0, 2, "sub", "in", 0), (0, 2, "free_throw", "made 2 of 2", 0)]
    for seq, row in enumerate(rows):
        game.take(seq, 1, *row)
    assert game.done[-1][11:14] == ("made_ft", [1], [9])
    game = Game(1)
    rows = [(1, 8, "jump", "", 0), (0, 1, "shot", "made", 2), (1, 9, "foul", "shooting", 0), (1, 8, "sub", "out", 0), (0, 1, "free_throw", "made 1 of 1", 0)]
    for seq, row in enumerate(rows):
        game.take(seq, 1, *row)
    assert game.done[-1][11:14] == ("made_ft", [1], [8])


def test_last_continuation():
    def last(*rows):
        game = Game(1)
        for seq, row in enumerate(rows):
            game.take(seq, 1, *row)
        return [(p[8], p[10], p[11]) for p in game.finish()]  # rebounds, dead, reason

    miss = (0, 1, "shot", "missed", 0)
    assert last(miss, (0, 2, "rebound", "", 0), (0, 2, "turnover", "", 0)) == [(1, 1, "turnover")]
    assert last(miss, (0, 2, "rebound", "", 0), (None, None, "period", "end", 0)) == [(1, 1, "period_end")]
    assert last(miss, (0, None, "rebound", "", 0), (None, None, "period", "end", 0)) == [(0, 0, "period_end")]
    assert last(miss, (0, 2, "rebound", "", 0), (0, 2, "shot", "made", 2)) == [(1, 0, "made_fg")]


def test_starters_from_the_box(spark):
    from stintforge.operators import gamelog

    plays = spark.createDataFrame(
        [(1, 0, 1, 0, 1, "shot", "made", 2), (1, 1, 1, 0, 3, "sub", "in", 0), (1, 2, 1, 1, 8, "shot", "made", 2), (1, 3, 1, 1, 9, "turnover", "", 0)],
        "game long, seq long, period int, team long, player long, action string, detail string, value long",
    )
    box = spark.createDataFrame([(1, 1, 0, [1, 2, 3]), (1, 1, 1, [8, 9]), (1, 1, 2, [4])], "game long, period int, team long, played array<bigint>")
    got = {x["team"]: (x["starters"], x["rule"]) for x in gamelog.starters_with_box(plays, box, 2).collect()}
    assert got == {0: ([1, 2], "box"), 1: ([8, 9], "plays"), 2: (None, None)}


def test_lineups_are_unknown_until_five_are_known(spark):
    acts = [(1, 1, 1, 10, p, "sub", "in", 0) for p in (1, 2, 3, 4)] + [(1, 2, 1, 20, p, "sub", "in", 0) for p in (5, 6, 7, 8, 9)]
    acts += [(1, 3, 1, 10, 1, "shot", "made", 2), (1, 4, 1, 20, 5, "shot", "made", 3), (1, 5, 1, 10, 11, "shot", "made", 2), (1, 6, 1, 20, 6, "sub", "out", 0), (1, 7, 1, 20, 5, "turnover", "", 0), (1, 8, 1, None, None, "period", "end", 0)]
    plays = spark.createDataFrame(acts, "game long, seq long, period int, team long, player long, action string, detail string, value long")
    got = gamelog.possessions(plays, five=5).orderBy("number").collect()
    ten, twenty = [1, 2, 3, 4, 11], [5, 6, 7, 8, 9]
    assert [(r.team, r.offence, r.defence) for r in got] == [(10, None, twenty), (20, twenty, None), (10, ten, None), (20, None, ten)]
    assert [(r.twos, r.two_makes, r.threes, r.three_makes) for r in got] == [(1, 1, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0), (0, 0, 0, 0)]
    assert all(r.offence is not None for r in gamelog.possessions(plays).collect())
