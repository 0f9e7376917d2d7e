"""Document fingerprints by invertible Bloom lookup tables (DataFrame functions only).

A text's paragraphs are its lines, in blocks of at most 16 words; a paragraph is known by a 64-bit digest, the same
rule for every text.  A sketch throws each digest into one cell of each of three subtables; a cell holds how many fell
there, the exclusive or of the digests and that of their check sums.  A published fingerprint is the text's sketch
with three times eight cells.  The sketches of two versions subtract cell by cell: shared paragraphs vanish, and
peeling recovers the others: a cell with one digest left (its check sum fits) gives that digest, which is then taken
out of its other two cells.  The first attempt has the published size.  Where cells remain, the counts left in them
estimate how many digests differ, and the pair is sketched again with cells for so many, at least four times as many
as before, until all are recovered.

Cells are rows.  Digests are written once, bucketed by the document's key; building, subtracting and every peeling
round are aggregations inside a bucket, in generated code and without a shuffle, and a pair's rows are proportional to
its paragraphs in the throw, to its cells in the rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bucketed, cut, small

#: At most so many words of a line are a paragraph.
WORDS = 16
PARAGRAPH = rf"(?:\S++[ \t]*+){{1,{WORDS}}}+"
SUBTABLES = 3
#: Cells of a subtable in a published fingerprint, and in the first attempt.
CELLS = 8
#: Peeling rounds, each over one subtable.
ROUNDS = 9
NO_ID = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def place(digest: Column, table: Column | int, cells: Column | int) -> Column:
    """The digest's cell in a subtable of so many cells."""
    return F.pmod(F.xxhash64(digest, F.lit(table) if isinstance(table, int) else table), F.lit(cells) if isinstance(cells, int) else cells)


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(977)).bitwiseAND(0xFFFFFFFF)


def rendered(digests: Column, cells: int = CELLS) -> Column:
    """A fingerprint: the number of digests, then count, exclusive or and check sum of each cell in hexadecimal."""
    placed = F.transform(digests, lambda d: F.struct(d.alias("d"), check(d).alias("check"), *[place(d, t, cells).alias(f"at{t}") for t in range(SUBTABLES)]))

    def subtable(all_: Column, t: int) -> Column:
        def cell(c: Column) -> Column:
            own = F.filter(all_, lambda x: x[f"at{t}"] == c)
            total = lambda name: F.hex(F.aggregate(own, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y[name])))
            return F.concat_ws(":", F.hex(F.size(own)), total("d"), total("check"))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell), ";")

    # a list of one, so that the placed digests are computed once
    tables = lambda x: F.concat_ws(";", *[subtable(x, t) for t in range(SUBTABLES)])
    return F.concat_ws(";", F.size(digests).cast("string"), F.element_at(F.transform(F.array(placed), tables), 1))


def _peeled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One attempt on (keys, side, left, right, cells): keys, side, stuck cells, recovered digests of either side, and
    an estimate of the digests that are not recovered."""
    keys = [*keys, "side"]
    signed = rows.select(*keys, "cells", F.size("left").alias("_n"), F.posexplode(F.concat("left", "right")).alias("_at", "_d"))
    thrown = signed.select(*keys, "cells", F.when(F.col("_at") < F.col("_n"), 1).otherwise(-1).alias("sign"), "_d", F.explode(F.array(*map(F.lit, range(SUBTABLES)))).alias("_t"))
    cell = F.col("_t") * F.col("cells") + place(F.col("_d"), F.col("_t"), F.col("cells"))
    state = thrown.select(*keys, "cells", cell.cast("long").alias("cell"), F.lit(None).cast("long").alias("found"), F.col("sign").cast("long").alias("n"), F.col("_d").alias("sum"), check(F.col("_d")).alias("check"))
    names = [*keys, "cells", "cell", "found"]

    def settled(rows: DataFrame) -> DataFrame:
        added = rows.groupBy(*names).agg(F.sum("n").alias("n"), F.bit_xor("sum").alias("sum"), F.bit_xor("check").alias("check"))
        return added.where("found is not null or n <> 0 or sum <> 0 or check <> 0")

    state = settled(state)
    for turn in range(ROUNDS):
        t = turn % SUBTABLES
        d = F.col("sum")
        pure = F.col("found").isNull() & (F.abs("n") == 1) & (F.floor(F.col("cell") / F.col("cells")) == t) & (F.col("check") == check(d))

        def row(at: Column, found: Column, n: Column, total: Column, own: Column) -> Column:
            return F.struct(at.cast("long").alias("cell"), found.cast("long").alias("found"), n.alias("n"), total.cast("long").alias("sum"), own.cast("long").alias("check"))

        others = [row(F.lit(u) * F.col("cells") + place(d, u, F.col("cells")), F.lit(None), -F.col("n"), d, F.col("check")) for u in range(SUBTABLES) if u != t]
        taken = F.array(*others, row(F.lit(-1), d, F.col("n"), F.lit(0), F.lit(0)))
        same = F.array(row(F.col("cell"), F.col("found"), F.col("n"), d, F.col("check")))
        moved = state.select(*keys, "cells", F.explode(F.when(pure, taken).otherwise(same)).alias("_x"))
        state = settled(moved.select(*keys, "cells", "_x.cell", "_x.found", "_x.n", "_x.sum", "_x.check"))
    left = F.when(F.col("found").isNull(), F.col("n"))
    # with signs of either side, squared counts add up to the digests left, but for what the difference of the sides adds
    spread = (F.sum(left * left) / SUBTABLES - F.pow(F.sum(left) / SUBTABLES, F.lit(2)) / F.first("cells")) * F.first("cells") / F.greatest(F.first("cells") - 1, F.lit(1))
    return state.groupBy(*keys).agg(
        F.first("cells").alias("cells"),
        F.count(left).alias("stuck"),
        F.count(F.when(F.col("found").isNotNull() & (F.col("n") > 0), 1)).alias("only_left"),
        F.count(F.when(F.col("found").isNotNull() & (F.col("n") < 0), 1)).alias("only_right"),
        F.greatest(F.abs(F.sum(left)) / SUBTABLES, F.coalesce(spread, F.lit(0.0))).alias("rest"),
    )


def buckets(spark: SparkSession, rows: int) -> int:
    """Partitions for so many documents: small ones, as a document has many cells, but no more than can be scheduled."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(rows // 600 + 1, 50_000))


def differences(pairs: DataFrame, keys: list[str], sides: list[tuple[str, str]], first: int = CELLS) -> DataFrame:
    """How many digests are only left and only right: (keys, side, only_left, only_right).

    ``pairs`` has unique ``keys``, by which it is dealt, and arrays of digests; side k compares the k-th two of
    ``sides``.  Sides without a difference have no row.  The first attempt has ``first`` cells a subtable; stuck ones
    are sketched again with as many as their estimate needs, at least four times as many as before.
    """

    def sketched(rows: DataFrame, cells: Callable[[int], Column]) -> DataFrame:
        both = [F.struct(F.lit(k).alias("side"), F.col(a).alias("left"), F.col(b).alias("right"), cells(k).alias("cells")) for k, (a, b) in enumerate(sides)]
        return rows.select(*keys, F.explode(F.array(*both)).alias("_x")).select(*keys, "_x.*").where("cells is not null")

    work = sketched(pairs, lambda k: F.lit(first).cast("long"))
    dealt, done = buckets(pairs.sparkSession, pairs.count()), []
    while True:
        solved = cut(_peeled(work, keys))
        done.append(solved.where("stuck = 0").select(*keys, "side", "only_left", "only_right"))
        stuck = solved.where("stuck > 0")
        wanted = F.pow(F.lit(2.0), F.ceil(F.log2(0.75 * (F.col("rest") + F.col("only_left") + F.col("only_right"))))).cast("long")
        more = F.greatest(4 * F.col("cells"), wanted)
        again = stuck.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == k, more)).alias(f"_cells{k}") for k in range(len(sides))])
        rest = again.count()
        if not rest:
            return reduce(DataFrame.unionAll, done)
        met = pairs.join(again, keys)
        if 2 * (parts := buckets(pairs.sparkSession, rest)) <= dealt:  # few are left: so are the tasks
            met = met.repartition(parts, *keys)
        work = sketched(met, lambda k: F.col(f"_cells{k}"))


def ordered(docs: DataFrame) -> DataFrame:
    """(id, hash, n, repeats, before_id, before_hash, before_n): each distinct document and the one before it.

    The order is descending by id, then by text hash, and is cyclic: before the first stands the last.  Ranges of ids
    are ordered apart; only their ends, one row a partition, meet.
    """
    rows = docs.groupBy("id", "hash", "n").agg(F.count("*").alias("repeats"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, F.desc("id"), F.desc("hash")).withColumn("part", F.spark_partition_id()))
    own = F.struct("id", "hash", "n")
    ends = ranged.groupBy("part").agg(F.min(own).alias("last"))
    line = Window.orderBy("part")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = cut(ends.select("part", F.coalesce(F.lag("last").over(line), F.last("last").over(every)).alias("ahead")))
    inside = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("hash"))
    before = F.coalesce(F.lag(own).over(inside), F.col("ahead"))
    joined = ranged.join(small(ahead), "part").withColumn("before", before)
    return cut(joined.select("id", "hash", "n", "repeats", F.col("before.id").alias("before_id"), F.col("before.hash").alias("before_hash"), F.col("before.n").alias("before_n")))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and likenesses found by peeling.

    The edited text keeps the first half of the code points (the longer one) and goes on with the first floor(n / 2),
    or all, of the next document by descending id; after the last comes the first.  Likeness is the share of common
    among all paragraph digests, 1 where both have none.  A null text is empty; a null id (and one that is no number)
    is ordered after all others; rows that repeat with the same id and text are one document in this order, and all
    keep their row; where one id has several texts, a hash of the text orders them.  An empty table gives an empty
    result.
    """
    kind, key = docs.schema["doc_id"].dataType, ["id", "hash"]
    number = F.expr("try_cast(doc_id as bigint)")
    text = F.coalesce(F.col("text"), F.lit(""))
    other = F.when(number.isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    own = [] if isinstance(kind, IntegralType) else [F.col("doc_id").alias("name")]
    base = docs.select(F.coalesce(number, F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text, other).alias("hash"), *own)
    order = ordered(base.select(*key, F.char_length("text").cast("long").alias("n")))
    parts = buckets(docs.sparkSession, order.count())
    if not order.where("repeats > 1").isEmpty():
        base = base.dropDuplicates(key)
    rows = base.repartition(parts, *key).join(order, key)
    half = F.floor(F.col("n") / 2).cast("int")
    wanted = F.floor(F.col("before_n") / 2).cast("int")
    sent = rows.select(F.col("before_id").alias("id"), F.col("before_hash").alias("hash"), F.substring("text", F.lit(1), wanted).alias("begin"), paragraphs(F.col("text")).alias("next"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - half), F.col("begin"))
    name = F.col("name") if own else F.when(F.col("id") != NO_ID, F.col("id")).cast(kind)
    met = rows.join(sent.repartition(parts, *key), key).select(*key, name.alias("doc_id"), "n", "repeats", "text", edited.alias("edited"), "next")
    done = met.select(*key, "doc_id", "n", "repeats", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("edited"), "next")
    work = bucketed(done, parts, *key)
    apart = differences(work, key, [("own", "edited"), ("own", "next")])
    both = F.col("only_left") + F.col("only_right")
    found = apart.groupBy(*key).agg(*[F.sum(F.when(F.col("side") == s, both)).alias(f"apart{s}") for s in (0, 1)])

    def likeness(side: int, right: str) -> Column:
        total, differ = F.size("own") + F.size(right), F.coalesce(F.col(f"apart{side}"), F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - differ) / (total + differ))

    out = work.join(found, key, "left").select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", rendered(F.col("own")).alias("fingerprint"), rendered(F.col("edited")).alias("edited_fingerprint"),
        likeness(0, "edited").alias("near_edited"), likeness(1, "next").alias("near_next"), "repeats",
    )
    return out.withColumn("_copy", F.explode(F.expr("sequence(1L, repeats)"))).drop("repeats", "_copy")
