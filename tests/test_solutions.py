"""Solutions behind the queries that only report residuals or counts: every system they solve, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.functions import text as X
from stintforge.operators import gamelog
from stintforge.operators import linear as L
from stintforge.plans import linear, registry
from stintforge.sources.tables import Tables

ROOT = "/root/testdata/sf0.001"


def systems(equations, key):
    """Dense systems by key from (key, i, j, g)."""
    out = {}
    for value, rows in equations.toPandas().groupby(key):
        names = sorted(rows["i"].unique())
        at = {int(c): k for k, c in enumerate(names)}
        matrix, target = np.zeros((len(names), len(names))), np.zeros(len(names))
        for i, j, g in zip(rows["i"], rows["j"], rows["g"], strict=True):
            if np.isnan(j):
                target[at[int(i)]] += g
            else:
                matrix[at[int(i)], at[int(j)]] += g
                if i != j:
                    matrix[at[int(j)], at[int(i)]] += g
        out[value] = (names, matrix, target)
    return out


def agrees(fit, equations, key, penalty, free):
    got = {(r[key], r["i"]): r["beta"] for r in fit.collect()}
    n = 0
    for value, (names, matrix, target) in systems(equations, key).items():
        full = matrix + np.diag([0.0 if c in free else penalty for c in names])
        want = np.linalg.lstsq(full, target, rcond=None)[0]
        assert np.abs(full @ np.array([got[(value, c)] for c in names]) - target).max() <= 1e-6 * max(np.abs(target).max(), 1e-300)
        if np.linalg.cond(full) < 1e10:
            assert [got[(value, c)] for c in names] == pytest.approx(want, rel=1e-5, abs=1e-6 * np.abs(want).max())
        n += len(names)
    assert n == len(got)


@pytest.mark.parametrize("name", ["lam02_ridge", "lam02_ridge_residual", "lam09", "lam10_rated_coefficients", "lam14", "lam15", "lam19_prior_columns", "lam19_prior_held", "lam56", "lam65", "chk07"])
def test_every_ridge_of_a_query_equals_numpy(spark, monkeypatch, name):
    calls, plain = [], L.ridge

    def recorded(equations, key, penalty, free=(0,), sd=False):
        fit = plain(equations, key, penalty, free, sd)
        calls.append((fit, equations, key, penalty, free))
        return fit

    monkeypatch.setattr(L, "ridge", recorded)
    full = next(q for q in registry.queries() if q.startswith(name))
    registry.queries()[full](spark, ROOT)
    assert calls
    for call in calls:
        agrees(*call)


def test_leave_out_equals_numpy(spark):
    sums = linear.equations(Tables(spark, ROOT)).cache()
    assert L.leave_out(sums, "season").count()
    agrees(L.ridge_leaving(sums, "season", 5000.0), L.leave_out(sums, "season"), "season", 5000.0, (0,))


def test_one_inverse_gives_every_leave_out(spark):
    sums = linear.equations(Tables(spark, ROOT)).cache()
    agrees(L.ridge_leaving_inverse(sums, "season", 5000.0), L.leave_out(sums, "season"), "season", 5000.0, (0,))


def test_absorbed_levels_leave_the_same_slopes(spark):
    """Players' coefficients with a free level a season equal those of the absorbed equations."""
    t = Tables(spark, ROOT)
    games = t.lineups.select("season", "lineup", "poss", "pts").collect()
    players, seasons = sorted({p for g in games for p in g.lineup}), sorted({g.season for g in games})
    x = np.array([[*[float(g.season == y) for y in seasons], *[float(p in g.lineup) for p in players]] for g in games])
    w, y = np.array([float(g.poss) for g in games]), np.array([g.pts / g.poss for g in games])
    want = np.linalg.solve((x * w[:, None]).T @ x + np.diag([0.0] * len(seasons) + [500.0] * len(players)), x.T @ (w * y))[len(seasons) :]
    got = L.ridge(L.absorbed(linear.equations(t), "season").withColumn("k", F.lit(1)), "k", 500.0, ()).orderBy("i").collect()
    assert [r.beta for r in got] == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_leave_fold_out_query_equals_numpy(spark):
    """Ratings of lam47 from the raw games of the other folds."""
    t = Tables(spark, ROOT)
    games = t.lineups.select("game", "lineup", "poss", "pts").collect()
    got = {(r.fold, r.player): r.rating for r in registry.queries()["lam47_leave_fold_out"](spark, ROOT).collect()}
    players = sorted({p for g in games for p in g.lineup})
    fold = lambda g: g * 2654435761 % 4294967296 % 5
    for k in {f for f, _ in got}:
        rest = [g for g in games if fold(g.game) != k]
        x = np.array([[1.0, *[float(p in g.lineup) for p in players]] for g in rest])
        w, y = np.array([float(g.poss) for g in rest]), np.array([g.pts / g.poss for g in rest])
        beta = np.linalg.solve((x * w[:, None]).T @ x + np.diag([0.0] + [5000.0] * len(players)), x.T @ (w * y))
        for p, b in zip(players, beta[1:], strict=True):
            assert got[(k, p)] == pytest.approx(b, rel=1e-4, abs=2e-3)


def test_names_fold_every_accent(spark):
    names = {"Kristaps Porziņģis": "kristaps porzingis", "Dāvis Bertāns": "davis bertans", "Nikola Jokić Jr.": "nikola jokic", "Đorđe Łukasz": "dorde lukasz", "Nguyễn Thị": "nguyen thi", "émilie": "emilie", "Gary Trent II": "gary trent"}
    rows = spark.createDataFrame(list(names.items()), "name string, want string").select("want", S.name_key(F.col("name")).alias("key"), S.letters_only(F.col("name")).alias("letters")).collect()
    assert all(r.key == r.want for r in rows)
    assert {r.letters for r in rows} >= {"kristapsporzingis", "nguyenthi", "emilie"}


def test_fuzzy_bound_loses_nothing(spark):
    from difflib import SequenceMatcher

    asked, roster = ["jon smith", "jonas", "anna lee", "bo", "a", ""], ["john smith", "jonathan smithson", "jonas", "ana lee", "bob", "annabel", "a"]
    frame = lambda names, c: spark.createDataFrame([(x,) for x in names], f"{c} string")
    got = {r.asked: r.name for r in X.fuzzy(frame([*asked, "jonas"], "asked"), frame(roster, "name"), 0.7).collect()}
    want = {}
    for x in asked:
        scored = [(-round(SequenceMatcher(None, x, n).ratio(), 6), n) for n in roster if n[:1] == x[:1] and round(SequenceMatcher(None, x, n).ratio(), 6) >= 0.7]
        if scored:
            want[x] = min(scored)[1]
    assert got == want


def test_throws_without_a_count_and_plays_without_a_team():
    game = gamelog.Game(1)
    plays = [(1, 1, 10, 1, "shot", "missed", 0), (2, 1, 20, 5, "foul", "shooting", 0), (3, 1, 10, 1, "free_throw", "made", 0), (4, 1, None, None, "shot", "made", 2), (5, 1, None, None, "turnover", "", 0), (6, 1, 20, 5, "free_throw", "missed 2 of 2", 0), (7, 1, None, None, "jump", "", 0), (8, 1, None, None, "period", "end", 0)]
    for play in plays:
        game.take(*play)
    done = game.finish()
    assert [(p[3], p[6], p[11]) for p in done] == [(10, 1, "made_ft"), (20, 0, "period_end")]
