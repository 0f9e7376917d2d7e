"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are encoded, ended with one id, and cut only if longer than a sequence (the first piece takes the
remainder).  Pieces are numbered and dealt into partitions of some thousands by a hash of the number; each is packed best-fit decreasing.  Dual
feasible functions give a lower bound of the partition's bins: one that meets it is certified optimal.  A partition
with a gap gives up the documents of its unfilled bins, and a certified one those of bins that are an eighth empty or
more; the given up documents are dealt anew, exchanged between partitions, and best-fit decreasing runs again over
them.  After the last round all bins are closed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import cut, map_arrow, ship

CAPACITY = 1024
END_ID = 2


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is encoded as empty."""
    place = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        own = encoder(place)
        for i, text in enumerate(batch.column("text").to_pylist()):
            whole = own.packed(text) + end
            n = len(whole) // 4
            lo, first = 0, n % capacity or capacity
            for k in range(-(-n // capacity)):
                hi = first + k * capacity
                row.append(i), piece.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(whole[4 * lo : 4 * hi]))
                lo = hi
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_arrow(texts, step, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Best-fit of lengths in the given order: the bin and offset of each, and the number of bins."""
    bins: list[int] = []
    offsets: list[int] = []
    spare: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, used = 0, 0  # bit r: there is a bin with room r
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            place = spare[room].pop()
            if not spare[room]:
                rooms ^= 1 << room
        else:
            room, place, used = capacity, used, used + 1
        bins.append(place)
        offsets.append(capacity - room)
        if room > n:
            spare[room - n].append(place)
            rooms |= 1 << (room - n)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual feasible functions.

    For a threshold t up to half a bin, items over capacity - t count as whole bins, items under t as nothing.  The
    step functions u_k send an item to multiples of 1/k: x(k + 1) if that is whole, else its floor over k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(0, capacity // 2 + 1)
    big = n[-1] - n[capacity - t + 1]
    middle = s[capacity - t + 1] - s[t]
    best = int(np.max(big + -(-middle // capacity)))
    for k in range(1, 41):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * capacity * (k + 1))  # times k (k+1) capacity
        best = max(best, -(-int((count * value).sum()) // (k * (k + 1) * capacity)))
    return best


def _settler(plain: list[str], capacity: int, turn: int, last: bool):
    def settle(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.select(plain).sort_by([("length", "descending"), *[(f, "ascending") for f in plain if f != "length"]])
        lengths = group["length"].to_numpy()
        where, offsets, used = best_fit(lengths.tolist(), capacity)
        bound = lower_bound(lengths, capacity)
        room = capacity - np.bincount(where, lengths, used)[where]
        opened = np.zeros(len(lengths), bool) if last else (room > 0) if used > bound else (room >= capacity // 8)
        number = (turn << 56) + (int(key[0].as_py()) << 20) + np.asarray(where, np.int64)
        k = len(lengths)
        extra = [pa.array(number), pa.array(offsets, pa.int64()), pa.array([turn] * k, pa.int32()), pa.array([used] * k, pa.int64()), pa.array([bound] * k, pa.int64()), pa.array(opened)]
        return pa.Table.from_arrays([*group.columns, *extra], names=[*plain, "sequence_id", "offset", "round", "bins", "bound", "open"])

    return settle


def pack(rows: DataFrame, capacity: int = CAPACITY, per: int = 8192, rounds: int = 3) -> DataFrame:
    """Place the rows (any columns, ``length`` among them): adds sequence_id, offset, round, bins and bound.

    ``bins`` and ``bound`` are those of the partition that closed the row's bin: equal means certified.
    """
    names = [f for f in rows.schema.fields if f.name not in ("sequence_id", "offset", "round", "bins", "bound", "open", "_deal")]
    plain = [f.name for f in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long, round int, bins long, bound long, open boolean"
    ship(rows.sparkSession)
    todo, done = cut(rows.select(*plain)), []
    for turn in range(1, rounds + 1):
        n = todo.count()
        parts = max(1, -(-n // per))
        last = turn == rounds or parts == 1

        # by a number, not by values: equal rows spread over the groups; the numbers of checkpointed rows do not change
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts))
        placed = cut(todo.withColumn("_deal", deal).groupBy("_deal").applyInArrow(_settler(plain, capacity, turn, last), schema))
        done.append(placed.where("not open").drop("open"))
        if last:
            break
        todo = placed.where("open").select(*plain)
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text).

    Null and empty texts are one id long; ids may be null or repeat (each row is a document); an empty table gives an
    empty result.
    """
    return pack(pieces(docs, path, capacity), capacity)
