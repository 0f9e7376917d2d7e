"""Near-duplicates by SimHash, found through pivot distance tables.

Fingerprints (64 bits) that differ in at most three bits are linked.  Equal fingerprints are one node, so copies cost
nothing.  Fingerprints meet in buckets: the 64 bits are cut into ``blocks`` blocks, and two fingerprints within three
bits agree on some ``blocks - 3`` of them entirely, so a bucket for each choice of that many blocks loses no pair.
Inside a bucket no pair is formed from raw fingerprints: each fingerprint's distances to many reference fingerprints
(pivots) are tabulated, pairs whose coordinates differ by more than three anywhere are discarded (triangle
inequality), coordinate after coordinate, and only the survivors' own distance is computed.  A bucket hands on a
spanning forest of its links, never its pairs.

A bucket of more than ``most`` different fingerprints is not gathered, and its pairs do not pass the pivot table.  Its
members meet at common neighbours instead: two fingerprints are within three bits exactly if some value lies within one
bit of the one and two bits of the other, so each emits its 65 and 2,081 such values, which is linear in the bucket.  Components then follow by least labels with pointer jumping, on links only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, cut, join_spread, map_arrow, small

NEAR = 3
SHINGLE = 3
#: Reference fingerprints: hashes of fixed numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(32)], np.uint64)
PAIRS = 1 << 20


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < width:
        return xxhash.xxh64_intdigest(line, 42)
    lasts = ends[width - 1 :].tolist()
    firsts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(firsts)
    for at in range(0, n, 1 << 15):
        some = slice(at, at + (1 << 15))
        hashed = np.array([digest(line[a:b], 42) for a, b in zip(firsts[some], lasts[some], strict=True)], "<u8")
        votes += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long, after any further columns."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__text")
    rows = docs.select(*more, "doc_id", text)
    plain = [f for f in rows.schema.fields if f.name != "__text"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = binary_parts(batch.column("__text"))
        view = memoryview(data) if data is not None else memoryview(b"")
        got = np.array([fingerprint(bytes(view[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], [*[f.name for f in plain], "fp"])

    return map_arrow(rows, step, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in plain], "fp long"]))


def bucket_keys(blocks: int) -> Column:
    """For each choice of blocks - 3 blocks: its number and the bits there."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False) if a in chosen) for chosen in combinations(edges[:-1], blocks - NEAR)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(100 * blocks + i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the pairs (i, j) in place: every label ends as the least position of its set."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def bucket_forest(values: np.ndarray, sizes: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Buckets one after another, ``sizes`` long: for every bucket a forest of its links within ``near`` bits."""
    distance = np.bitwise_count(values[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    label = np.arange(len(values))
    later = np.repeat(np.cumsum(sizes), sizes) - label - 1  # members of the same bucket after each
    upto = np.cumsum(later)
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        n = later[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        for p in range(distance.shape[1]):
            kept = np.abs(distance[i, p] - distance[j, p]) <= near
            i, j = i[kept], j[kept]
        kept = np.bitwise_count(values[i] ^ values[j]) <= near
        merge(label, i[kept], j[kept])
        begin = end
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def neighbours(radius: int) -> Column:
    """All values within so many bits of fp."""
    masks = [0] + [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.transform(F.from_json(F.lit(str(signed)), "array<bigint>"), lambda m: F.col("fp").bitwiseXOR(m)))


def links(nodes: DataFrame, most: int = 1024, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints, a spanning forest a bucket; ``nodes`` has distinct fp."""
    n = nodes.count()
    blocks = blocks or next((k for k in (4, 5, 6) if n < 1 << 64 * (k - NEAR) // k + 3), 7)
    keys = nodes.select("fp", F.explode(bucket_keys(blocks)).alias("key"))
    full = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))
    crowded = full.count() > 0
    if crowded:
        full = small(full)
        rest = keys.join(full, "key", "left_anti")
    else:
        rest = keys
    buckets = rest.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("fps")
        sizes = np.diff(lists.offsets.to_numpy())
        a, b = bucket_forest(lists.flatten().to_numpy().view(np.uint64), sizes)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    found = map_arrow(buckets, step, "a long, b long")
    if crowded:
        dense = cut(keys.join(full, "key", "left_semi").select("fp").distinct())
        one = dense.select("fp", neighbours(1).alias("z")).groupBy("z").agg(F.min("fp").alias("b"))
        two = dense.select(F.col("fp").alias("a"), neighbours(2).alias("z"))
        found = found.unionAll(two.join(one, "z").where("a != b").select("a", "b"))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): equal labels for connected nodes, the least node of each.  Least labels and pointer jumping."""
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        least = join_spread(both, labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        nearer = cut(labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(join_spread(nearer, jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        moved = labels.where("old != label")
        labels = labels.select("node", "label")
        if moved.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, most: int = 1024, blocks: int | None = None) -> DataFrame:
    """Return doc_id, fp and component_id (the smallest doc_id reachable over links) for every row of ``docs``.

    A null or blank text has fingerprint zero and is linked like any other; repeated rows share everything; null ids
    keep their rows and never name a component unless all its ids are null.  An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes.select("fp"), most, blocks))
    named = cut(nodes.join(labels, F.col("fp") == F.col("node")).select("fp", "label", "least"))
    leaders = cut(named.groupBy("label").agg(F.min("least").alias("component")))
    linked = join_spread(named.select("fp", "label"), leaders, "label").select("fp", "component")
    classes = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return join_spread(marked, classes, "fp").select("doc_id", "fp", "component_id")


def leaders(docs: DataFrame, most: int = 1024, blocks: int | None = None) -> DataFrame:
    """Keep one row of each group of near-duplicates, whatever its ids: that of the least id, null ids last.

    Where that id has several texts in the group, the one of the least hash stays; of rows that repeat id and text,
    the least by a hash of all columns.  Rows of other groups stay though they share the id, or have none.  Columns of
    any names are kept.  Texts are shuffled once, by id and text hash.
    """
    marked = cut(fingerprints(docs, F.xxhash64("text").alias("hash")))
    nodes = cut(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")))
    labels = components(links(nodes.select("fp"), most, blocks))
    classes = nodes.join(labels, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("label", "fp").alias("class"))
    chosen = classes.agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash"))
    several = cut(marked.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1"))
    met = F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("c.hash") == F.col("s.hash"))
    chosen = cut(chosen.alias("c").join(several.alias("s"), met, "left").select("c.doc_id", "c.hash", F.col("s.n").isNotNull().alias("again")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))

    def kept(wanted: DataFrame) -> DataFrame:
        return rows.join(small(wanted), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("hash")), "left_semi")

    out = kept(chosen.where("not again"))
    if not several.isEmpty():
        one = kept(chosen.where("again")).groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        out = out.select("_row").unionAll(one.select("_row"))
    return out.select("_row.*")
