"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source has a target number of words.  Inside a source a document's expected copies grow with the number of bits
of its size, up to the cap, scaled so that the source's expected words are its target.  Of these each document first
gets the whole part as certain copies.  The fraction p is its inclusion probability for one more copy: documents are
ranked by Pareto's ranking variable, the random odds u / (1 - u) over their own inclusion odds p / (1 - p), and the
first ones are taken until the source's fixed sample size (in words) is filled.  The document that would overshoot is
left out; unsampled documents whose sizes fit the words still missing close the gap, where that brings the source
nearer (at most three).  u is a hash of id, text and the number among rows that repeat both, so every row has its own
draw, and reruns and lost executors give the same sample.

The cut in the ranking is found by two histograms over the ranking variable (1,024 buckets each, summed before the
shuffle), so a source with a third of all rows is never gathered in one task: only the rows of one bucket in a
million are ordered.  Rows that repeat are counted before the shuffle and numbered in slices of 4,096.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

BUCKETS = 1024
#: Documents that may close a source's gap: the largest that fit, and at last the one that comes closest.
CLOSERS = 3
#: Repeats of one row that are numbered in one task.
SLICE = 4096
#: The plan has a row for each source and bit length; so many (some 80 bytes each) are broadcast.
PLAN_ROWS = 200_000
KEY = ["doc_id", "source", "size", "digest"]


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Add ``target`` to a table (source, source_size): weights go to sources by code point, nulls last, repeating.

    The targets share the sum of all sizes by weight; none exceeds ``cap`` times its source's size, and the excess
    is shared again by weight.  That fixed point is a water level: sources fill in the order of cap over weight.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int"))).withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every)
    return levelled.withColumn("target", F.least(F.col("most").cast("double"), final * F.col("weight"))).select("source", "source_size", "target")


def shares(classes: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """Expected copies by source and weight: (source, weight, source_size, target, whole, part, room).

    ``classes`` has source, weight and the words of its documents; expected copies are weight times a level, at most
    ``cap``, and the level makes a source's expected words its target: classes fill from the largest weight down.
    """
    rows = same_source(classes, goals)
    fill = Window.partitionBy("source").orderBy(F.desc("weight"))
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    full, open_ = F.coalesce(F.sum("words").over(before), F.lit(0)) * cap, F.sum(F.col("weight") * F.col("words")).over(rest)
    level = F.when(open_ > 0, (F.col("target") - full) / open_)
    levelled = rows.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(Window.partitionBy("source"))
    copies = levelled.withColumn("copies", F.least(F.lit(float(cap)), final * F.col("weight")))
    split = copies.withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.col("whole"))
    room = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return split.withColumn("room", room).select("source", "weight", "source_size", "target", "whole", "part", "room")


def digest() -> Column:
    """48 bits of id and text."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return first_bits(F.md5(both.cast("binary")))


def first_bits(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 12), 16, 10).cast("long")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """A row's key and size, after any further columns."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(*more, F.col("doc_id"), F.col("source"), size.alias("size"), digest().alias("digest"))


def numbered(counted: DataFrame) -> DataFrame:
    """One row for each of the ``n`` repeats of a key, with its own uniform number ``u`` in (0, 1) and its weight."""
    most = counted.agg(F.max("n")).first()[0] or 0
    rows = counted.withColumn("slice", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLICE})")))
    if most > SLICE:
        rows = rows.repartition(F.xxhash64("digest", "slice"))
    rows = rows.withColumn("nth", F.explode(F.expr(f"sequence(slice * {SLICE} + 1, least(n, (slice + 1) * {SLICE}))")))
    return drawn(rows).drop("slice")


def drawn(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("nth") == 1, F.col("digest")).otherwise(first_bits(F.md5(F.concat_ws(":", "digest", "nth").cast("binary"))))
    return rows.withColumn("u", (own + 0.5) / float(1 << 48)).withColumn("weight", F.length(F.bin("size")))


def matched(rows: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int = PLAN_ROWS) -> DataFrame:
    """Join on ``keys``, where null equals null; the right table is broadcast after a check of its size."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return rows.join(small(renamed, most), on, how).drop(*[f"_{c}" for c in keys])


def same_source(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    return matched(rows, by_source, ["source"], how)


def ranking(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the plan of source and weight and add Pareto's variable, as v = q / (1 + q), with its two buckets."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    ranked = matched(base, plan, ["source", "weight"]).withColumn("v", F.when(F.col("part") > 0, odds / (1 + odds)))
    upper = ranked.withColumn("b1", F.floor(F.col("v") * BUCKETS))
    return upper.withColumn("b2", F.floor((F.col("v") * BUCKETS - F.col("b1")) * BUCKETS))


def within() -> Column:
    """Before the cut in the ranking; without a straddling bucket every row is."""
    inner = (F.col("b2") < F.col("at2")) | ((F.col("b2") == F.col("at2")) & F.coalesce(F.col("v") <= F.col("v3"), F.lit(False)))
    return F.col("at1").isNull() | (F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("at2").isNull() | inner))


def straddled(rows: DataFrame, bucket: str) -> DataFrame:
    """Per source: the bucket in which the running words pass ``room``, and the words before it."""
    summed = rows.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    order = Window.partitionBy("source").orderBy(bucket)
    run = summed.withColumn("upto", F.sum("words").over(order))
    hit = run.where(F.col("upto") > F.col("room"))
    return hit.groupBy("source").agg(F.min(F.struct(bucket, (F.col("upto") - F.col("words")).alias("words"))).alias("hit")).select("source", F.col(f"hit.{bucket}").alias("at"), F.col("hit.words").alias("ahead"))


def decide(base: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """The plan by source and weight, with the cut in the ranking and the documents that close the source's gap."""
    classes = cut(base.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    goals = cut(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap))
    plan = cut(shares(classes, goals, cap))
    ranked = ranking(base, plan)
    free = ranked.where(F.col("v").isNotNull() & (F.col("size") > 0))
    first = cut(straddled(free, "b1").withColumnRenamed("at", "at1").withColumnRenamed("ahead", "ahead1"))
    inside = same_source(free, first).where(F.col("b1") == F.col("at1")).withColumn("room", F.col("room") - F.col("ahead1"))
    second = cut(straddled(inside, "b2").withColumnRenamed("at", "at2").withColumnRenamed("ahead", "ahead2"))
    last = same_source(inside, second).where(F.col("b2") == F.col("at2")).withColumn("room", F.col("room") - F.col("ahead2"))
    order = Window.partitionBy("source").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    exact = cut(last.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= F.col("room")).groupBy("source").agg(F.max("v").alias("v3")))
    cuts = plan
    for found in (first, second, exact):
        cuts = same_source(cuts, found.drop("ahead1", "ahead2"), "left")
    cuts = cut(cuts)
    sampled = ranking(base, cuts).where(F.col("v").isNotNull() & (F.col("size") > 0)).withColumn("in", within())
    gaps = sampled.groupBy("source").agg((F.first("room") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
    state = cut(gaps.withColumn("picks", F.array().cast("array<struct<v:double,size:bigint>>")))
    rest = sampled.where(~F.col("in")).select("source", "v", "size")
    for turn in range(CLOSERS):
        off = F.col("gap") - F.col("size")
        better = off >= 0 if turn + 1 < CLOSERS else F.abs(off) < F.col("gap")
        open_ = same_source(rest, state).where(better & ~F.array_contains("picks", F.struct("v", "size")))
        pick = open_.groupBy("source").agg(F.min(F.struct(F.abs(off).alias("off"), F.col("v"), F.col("size"))).alias("pick"))
        picked = F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(F.struct("pick.v", "pick.size"))))
        state = cut(same_source(state, pick, "left").select("source", (F.col("gap") - F.coalesce(F.col("pick.size"), F.lit(0))).alias("gap"), picked.alias("picks")))
    none = F.array().cast("array<struct<v:double,size:bigint>>")
    return cut(same_source(cuts, state.drop("gap"), "left").withColumn("picks", F.coalesce("picks", none)))


def copied(base: DataFrame, decided: DataFrame) -> DataFrame:
    """Add ``copies`` to rows that have source, size, weight and u."""
    chosen = F.col("v").isNotNull() & (F.col("size") > 0) & (within() | F.array_contains("picks", F.struct("v", "size")))
    return ranking(base, decided).withColumn("copies", (F.col("whole") + F.when(chosen, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source, source_size, target, copies, taken.

    ``docs`` has doc_id, text and source; other columns are ignored.  A null or blank text has size 0 and is never
    drawn; an empty table gives an empty result; a null source is a source of its own.  Every row is drawn by itself:
    rows that repeat id and text are numbered.
    """
    base = numbered(cut(keyed(docs).groupBy(*KEY).agg(F.count("*").alias("n"))))
    final = copied(base, decide(base, weights, cap))
    return final.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of ``docs``, with all its columns, each as often as ``mix`` takes it.

    Texts are shuffled only for rows that repeat id, source and text: of these one row (the least by a hash of all
    columns) stands for all, as often as all of them are taken.
    """
    counted = cut(keyed(docs).groupBy(*KEY).agg(F.count("*").alias("n")))
    base = numbered(counted)
    decided = decide(base, weights, cap)
    rows = drawn(keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("nth", F.lit(1)))
    several = counted.where("n > 1")
    if several.isEmpty():
        taken = copied(rows, decided).select("_row", "copies")
    else:
        totals = cut(copied(numbered(several), decided).groupBy(*KEY).agg(F.sum("copies").alias("total")))
        alone = copied(matched(rows, totals, KEY, "left_anti"), decided).select("_row", "copies")
        one = matched(rows, totals, KEY).groupBy(*KEY).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"), F.first("total").alias("copies"))
        taken = alone.unionAll(one.select("_row", "copies"))
    return taken.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("_row.*")
