"""Name matching that built-in functions cannot express."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all, by longest common blocks, 0 to 1."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def fuzzy(asked: DataFrame, roster: DataFrame, least: float) -> DataFrame:
    """For each ``asked`` the roster ``name`` most like it, if at least ``least``; names are compared within a first letter.

    Different names meet once, and only where their lengths allow so much likeness: the ratio is at most twice the
    shorter length over both.
    """
    left = asked.select("asked").distinct().withColumn("_first", F.substring("asked", 1, 1))
    right = roster.select("name").distinct().withColumn("_first", F.substring("name", 1, 1))
    a, b = F.char_length("asked"), F.char_length("name")
    lengths = 2 * F.least(a, b) >= least * (a + b)
    scored = left.join(right, "_first").where(lengths).withColumn("score", F.round(similarity("asked", "name"), 6))
    return scored.where(F.col("score") >= least).groupBy("asked").agg(F.min_by("name", F.struct(-F.col("score"), "name")).alias("name"), F.max("score").alias("score"))


def season_list(text: str) -> list[int]:
    """``1997-2000,2003`` to the sorted seasons."""
    found: set[int] = set()
    for part in text.split(","):
        first, _, last = part.strip().partition("-")
        found |= set(range(int(first), int(last or first) + 1))
    return sorted(found)


def step_table(text: str, first: int = 0) -> list[tuple[int, float]]:
    """``0.89,2017:0.84`` to (first season, value) steps."""
    steps = [part.strip().partition(":") for part in text.split(",")]
    return sorted((int(a), float(b)) if b else (first, float(a)) for a, _, b in steps)
