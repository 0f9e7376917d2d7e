"""Exact nearest rows: a stated set of asked rows against all rows, in packed blocks.

Asked rows and rows are packed into blocks of bounded size; every pair of blocks is compared in one task, and hands on
at most k rows an asked row, or one number.  So neither side is broadcast, and what is shuffled afterwards follows the
asked rows and the number of blocks, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintforge.sources.shipping import ship

#: Asked rows of a slice that are compared at once.
SLICE = 16
Step = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def packed(rows: DataFrame, side: str, size: int) -> DataFrame:
    """Blocks of about ``size`` rows: an array a column, and the vectors (``vector``) end to end."""
    blocks = max(1, -(-rows.count() // size))
    plain = [c for c in rows.columns if c != "vector"]
    all_ = F.collect_list(F.struct(*plain, "vector"))
    grouped = rows.groupBy(F.pmod(F.xxhash64(*plain), F.lit(blocks)).alias("_block")).agg(all_.alias("x"))
    return grouped.select(*[F.col("x")[c].alias(f"{side}_{c}") for c in plain], F.flatten(F.col("x")["vector"]).alias(f"{side}_vector"))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rounded to five places, along the last axis."""
    return np.sqrt(((left - right) ** 2).sum(-1)).round(5)


def apart(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """``distances`` of chosen pairs, some at a time."""
    return np.concatenate([np.zeros(0), *[distances(left[i[k : k + most]], right[j[k : k + most]]) for k in range(0, len(i), most)]])


def squares(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and by row of ``left`` what they may be off by; where numbers are not finite, nothing is known."""
    n, m = (left**2).sum(1), (right**2).sum(1)
    size = n + m.max(initial=0.0)
    if not np.isfinite(size).all():
        return np.zeros((len(left), len(right))), np.full(len(left), np.inf)
    return n[:, None] + m - 2 * left @ right.T, 8 * (left.shape[1] + 4) * np.finfo(float).eps * size


def compare(asked: DataFrame, rows: DataFrame, step: Step, schema: str, asked_size: int = 512, row_size: int = 4096, slice_: int = SLICE, how: Callable = lambda left, right: distances(left[:, None], right)) -> DataFrame:
    """Run ``step`` (asked columns, row columns, ``how`` of their vectors: rounded distances) on every slice of asked rows and block."""
    ship(asked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = ({c[2:]: batch[c][k].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c[:2] == x} for x in ("a_", "b_"))
                n, m = (len(next(v for c, v in x.items() if c != "vector")) for x in (a, b))
                left, right = a.pop("vector").astype(float).reshape(n, -1), b.pop("vector").astype(float).reshape(m, -1)
                for at in range(0, n, slice_):
                    own = {c: v[at : at + slice_] for c, v in a.items()}
                    out = step(own, b, how(left[at : at + slice_], right))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))

    spread = asked.sparkSession.sparkContext.defaultParallelism
    pairs = packed(asked, "a", asked_size).crossJoin(packed(rows, "b", row_size))
    return pairs.repartition(spread).mapInArrow(run, schema)


def nearest_others(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, near, d): of each pair of blocks the k nearest rows with another label; ties by id.

    Both tables have vec_id, label and vector.
    """

    def step(a: dict[str, np.ndarray], b: dict[str, np.ndarray], gap: np.ndarray) -> dict[str, np.ndarray]:
        gap = np.where(a["label"][:, None] == b["label"][None, :], np.inf, gap)
        order = np.lexsort((np.broadcast_to(b["vec_id"], gap.shape), gap), axis=1)[:, :k]
        d = np.take_along_axis(gap, order, 1)
        kept = np.isfinite(d)
        return {"vec_id": np.broadcast_to(a["vec_id"][:, None], d.shape)[kept], "near": b["vec_id"][order][kept], "d": d[kept]}

    return compare(asked, rows, step, "vec_id long, near long, d double")


#: Rows of a block, and asked rows that are compared at once, where squared distances come from a matrix product.
BLOCK, WIDE = 8192, 128


def own_rank(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(vec_id, place): the rank of each asked row's nearest other row of its label among all rows of other labels.

    A matrix product tells nearly all pairs apart; those that it leaves open are measured one by one.
    """
    every = lambda left, right: (left, right, *squares(left, right))

    def own(a: dict[str, np.ndarray], b: dict[str, np.ndarray], found: tuple) -> dict[str, np.ndarray]:
        left, right, d2, off = found
        mine = (a["label"][:, None] == b["label"]) & (a["vec_id"][:, None] != b["vec_id"])
        d2 = np.where(mine, d2, np.inf)
        i, j = np.nonzero((d2 <= (d2.min(1) + 2 * off)[:, None]) & mine)
        d = np.full(len(left), np.inf)
        np.fmin.at(d, i, apart(left, right, i, j))
        return {"vec_id": a["vec_id"], "d": d}

    def nearer(a: dict[str, np.ndarray], b: dict[str, np.ndarray], found: tuple) -> dict[str, np.ndarray]:
        left, right, d2, off = found
        edge, other = np.maximum(a["own"] - 5e-6, 0.0), a["label"][:, None] != b["label"]
        least, most = np.maximum(edge - 1e-9, 0.0) ** 2 * (1 - 1e-12) - off, (edge + 1e-9) ** 2 * (1 + 1e-12) + off
        sure = d2 < least[:, None]
        i, j = np.nonzero((d2 <= most[:, None]) & ~sure & other)
        n = (sure & other).sum(1) + np.bincount(i[apart(left, right, i, j) < a["own"][i]], minlength=len(left))
        return {"vec_id": a["vec_id"], "n": n}

    sizes = {"asked_size": BLOCK, "row_size": BLOCK, "slice_": WIDE, "how": every}
    best = compare(asked, rows, own, "vec_id long, d double", **sizes).groupBy("vec_id").agg(F.min("d").alias("own")).where("own < double('infinity')")
    counted = compare(asked.join(best, "vec_id"), rows, nearer, "vec_id long, n long", **sizes)
    return counted.groupBy("vec_id").agg((F.sum("n") + 1).alias("place"))
