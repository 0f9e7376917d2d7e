"""The whole build: spreads come from the inverse, and multipliers from games that were held back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintforge.operators import sequences as Q
from stintforge.plans import build, registry
from stintforge.sources.tables import Tables

ROOT = "/root/testdata/sf0.001"


def test_spreads_equal_numpy(spark):
    t = Tables(spark, ROOT)
    games = t.lineups.collect()
    found = registry.queries()["cmd05_build"](spark, ROOT).collect()
    for season in {x.season for x in found}:
        own = [g for g in games if g.season == season]
        names = sorted({p for g in own for p in g.lineup})
        a = np.zeros((len(own), len(names) + 1))
        for k, g in enumerate(own):
            a[k, 0] = 1.0
            a[k, [names.index(p) + 1 for p in g.lineup]] = 1.0 / len(g.lineup)
        full = a.T @ (a * np.array([[float(g.poss)] for g in own])) + np.diag([0.0] + [build.PENALTY] * len(names))
        want = dict(zip(names, np.sqrt(np.diag(np.linalg.inv(full)))[1:], strict=True))
        mine = [x for x in found if x.season == season and x.player in want]
        assert mine and not any(math.isnan(x.sd) for x in mine)
        assert [x.sd for x in mine] == pytest.approx([want[x.player] for x in mine], abs=6e-7)


def test_multipliers_are_least_squares_of_held_back_games(spark):
    t = Tables(spark, "/root/testdata/sf0.01")  # teams of several players
    fold = Q.arithmetic_fold(F.col("game"), build.FOLDS)
    lineups, fact = (x.where("game < 900").withColumn("fold", fold) for x in (t.lineups, t.fact))
    seen = build.parts(build.totals(fact.where("fold <> 0")), lineups.where("fold <> 0"))
    own = fact.where("fold = 0").groupBy("season", "game", "team", "player").agg(F.sum("poss").alias("poss"), F.sum("pts").alias("pts"))
    held = lineups.where("fold = 0")
    sums = [x.asDict() for x in build.held_sums(seen, held, own).collect()]
    known, rows = {(x.season, x.player): x for x in build.layers(seen).collect()}, own.collect()
    all_games = held.collect()
    for season, fitted in build.multipliers(sums, sorted({x["season"] for x in sums})).items():
        games = [g for g in all_games if g.season != season]
        levels = sorted({g.season for g in games})
        at = lambda g, c: np.mean([known[g.season, p][c] if (g.season, p) in known else 0.0 for p in g.lineup])
        x = np.array([[*[float(g.season == s) for s in levels], at(g, "prior"), at(g, "deviation")] for g in games])
        w = np.sqrt([float(g.poss) for g in games])
        want = np.linalg.lstsq(x * w[:, None], w * np.array([float(g.pts / g.poss) for g in games]), rcond=None)[0][-2:]
        assert fitted[:2] == pytest.approx(want, rel=1e-5, abs=1e-7)
        lines = [y for y in rows if y.season != season]
        groups = {g: k for k, g in enumerate(sorted({y.game for y in lines}))}
        x = np.zeros((len(lines), len(groups) + 2))
        target = np.zeros(len(lines))
        for k, y in enumerate(lines):
            z = known.get((y.season, y.player))
            x[k, groups[y.game]] = 1.0
            x[k, -2:] = (z.own_p, z.own_u) if z else (0.0, 0.0)
            target[k] = float(y.pts / y.poss) - (z.mean_p + z.mean_u if z else 0.0)
        w = np.sqrt([float(y.poss) for y in lines])
        want = np.linalg.lstsq(x * w[:, None], w * target, rcond=None)[0][-2:]
        assert fitted[2:] == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_build_is_shrunk_by_fitted_multipliers(spark):
    t = Tables(spark, ROOT)
    fixed = {(x.season, x.player): x.rating for x in build.ratings(t.fact, t.lineups).collect()}
    found = {(x.season, x.player): x.rating for x in build.built(t, sd=False).collect()}
    assert found.keys() == fixed.keys()
    assert any(abs(found[k] - fixed[k]) > 1e-3 for k in found)


def test_one_season_alone_is_not_shrunk():
    assert build.multipliers([{"season": 1996, "layer": k, "pp": 1.0, "pu": 0.0, "uu": 1.0, "py": 0.5, "uy": 0.5} for k in (0, 1)], [1996]) == {1996: (1.0, 1.0, 1.0, 1.0)}
