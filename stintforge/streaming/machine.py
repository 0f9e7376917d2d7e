"""The possession fold as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stintforge.operators.machine import Fold
from stintforge.streaming.sessions import drained, events_stream


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take a micro-batch's rows of one key in order; the open possession is kept as state."""
    fold = Fold()
    if state.exists:
        fold.number, fold.n, fold.value = state.get
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
    out = [(key[0], *row) for kind, value in zip(rows["event_type"], rows["value"], strict=True) if (row := fold.take(kind, 0.0 if pd.isna(value) else value))]
    state.update((fold.number, fold.n, fold.value))
    yield pd.DataFrame(out, columns=["user_id", "poss", "n", "value", "ending"])


def closed_possessions(spark: SparkSession, path: str) -> DataFrame:
    """Drain the event stream; possessions appear when they close."""
    rows = events_stream(spark, path).select("user_id", F.unix_micros("ts").alias("us"), "event_id", "event_type", "value")
    found = rows.groupBy("user_id").applyInPandasWithState(advance, "user_id long, poss long, n long, value double, ending string", "number long, n long, value double", "append", GroupStateTimeout.NoTimeout)
    return drained(found, "append")
