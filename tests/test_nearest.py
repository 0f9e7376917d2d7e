"""Ranks by a matrix product equal those by single distances: duplicates, far origins, small gaps."""

import numpy as np
import pytest

from stintforge.operators import nearest as N


@pytest.mark.parametrize("at", [0.0, 1000.0])
def test_rank_equals_single_distances(spark, monkeypatch, at):
    monkeypatch.setattr(N, "BLOCK", 70)
    monkeypatch.setattr(N, "WIDE", 9)
    rng = np.random.default_rng(1)
    x = (at + rng.normal(size=(300, 8)) * np.where(np.arange(300) % 3, 1.0, 1e-5)[:, None]).astype(np.float32)
    x[100:120] = x[:20]
    label = np.arange(300) * 7 % 5
    rows = spark.createDataFrame([(k, int(label[k]), x[k].tolist()) for k in range(300)], "vec_id long, label int, vector array<float>")
    got = {r.vec_id: r.place for r in N.own_rank(rows.where("vec_id % 4 = 0"), rows).collect()}
    gap = np.sqrt(((x[:, None].astype(float) - x.astype(float)) ** 2).sum(-1)).round(5)
    for k in range(0, 300, 4):
        own = gap[k][(label == label[k]) & (np.arange(300) != k)].min()
        assert got[k] == 1 + (gap[k][label != label[k]] < own).sum()


def test_squares_are_no_pair_of_arrays_a_component():
    """A slice of 512 by 8,192 rows takes a product, not an array of every difference (2 GB before)."""
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(512, 64)), rng.normal(size=(8192, 64))
    d2, off = N.squares(left, right)
    want = np.stack([((x - right) ** 2).sum(1) for x in left])
    assert (np.abs(d2 - want) <= off[:, None]).all() and off.max() < 1e-9


def test_numbers_that_are_not_finite_leave_the_others(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [3.0, 4.0]), (2, 1, [1.0, 0.0]), (3, 0, [float("nan"), 0.0]), (4, 1, [float("inf"), 0.0])], "vec_id long, label int, vector array<float>")
    got = {r.vec_id: r.place for r in N.own_rank(rows.where("vec_id = 0"), rows).collect()}
    assert got == {0: 2}
