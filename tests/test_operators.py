"""Operators on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.operators import linear, machine, moments, relations, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_clock_and_labels(spark):
    assert one(spark, S.clock_seconds(F.lit("PT06M17.50S"))) == 377.5
    assert one(spark, S.clock_seconds(F.lit("6:17"))) is None
    assert one(spark, S.season_label(F.lit(2000))) == "1999-00"
    assert one(spark, S.season_of_game(F.lit("0029600001"))) == 1997
    assert one(spark, S.minutes(F.lit("24:06"))) == pytest.approx(24.1)
    assert one(spark, S.minutes(F.lit(""))) == 0
    assert one(spark, S.name_key(F.lit("Luka Dončić  Jr."))) == "luka doncic"


def test_numbers(spark):
    assert one(spark, S.shrink(F.lit(0.0), F.lit(None).cast("double"), 0.0, F.lit(0.4))) == 0.4
    assert one(spark, S.shrink(F.lit(30.0), F.lit(0.5), 10.0, F.lit(0.1))) == pytest.approx(0.4)
    assert one(spark, S.interpolate(F.lit(15.0), [(10.0, 1.0), (20.0, 2.0)])) == 1.5
    assert one(spark, S.normal_cdf(F.lit(-1.96))) == pytest.approx(0.0249979, abs=1e-6)
    assert one(spark, S.bin_index(F.lit(5.0), [1.0, 5.0, 9.0])) == 1


def test_islands_treat_null_as_a_state(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "a"])], "k int, i int, s string")
    assert [r.island for r in sequences.islands(rows, ["k"], ["i"], ["s"]).orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_streaks(spark):
    rows = spark.createDataFrame([(1, y, t) for y, t in [(1, "a"), (2, "a"), (4, "a"), (5, "b")]], "k int, y int, t string")
    streak = lambda gaps: [r.streak for r in sequences.streaks(rows, ["k"], "y", "t", gaps).orderBy("y").collect()]
    assert streak(False) == [1, 2, 3, 1] and streak(True) == [1, 2, 1, 1]


def test_swap_pairs(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (1, [1, 2, 4]), (1, [5, 6, 7]), (2, [1, 2, 3])], "g int, lineup array<int>")
    got = relations.swap_pairs(rows, ["g"]).collect()
    assert [(r.a, r.b, r.core) for r in got] == [([1, 2, 3], [1, 2, 4], [1, 2])]


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = (rng.random((80, 6)) < 0.5).astype(float)
    x[:, 0] = 1
    y, w = rng.normal(size=80), rng.random(80) + 0.5
    long = spark.createDataFrame([(1, i, j, float(w[i]), float(y[i])) for i in range(80) for j in range(6) if x[i, j]], "k int, row int, col long, w double, y double").withColumn("v", F.lit(1.0))
    right = long.groupBy("k", F.col("col").alias("i")).agg(F.sum(F.col("w") * F.col("y")).alias("g")).select("k", "i", F.lit(None).cast("long").alias("j"), "g")
    got = linear.ridge(moments.gram(long, ["k"], "row", "col", "v", "w").unionByName(right), "k", 2.0).orderBy("i").collect()
    want = np.linalg.solve((x * w[:, None]).T @ x + np.diag([0] + [2.0] * 5), (x * w[:, None]).T @ y)
    assert [r.beta for r in got] == pytest.approx(list(want))


def test_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([(k, i, i, ["click", "view", "purchase", "signup", "error"][(i * 7 + k) % 5], float(i)) for k in range(4) for i in range(50)], "user_id long, us long, event_id long, event_type string, value double")
    a = machine.possessions(rows, ["user_id"], ["us", "event_id"]).collect()
    b = machine.possessions_folded(rows, "user_id").collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
