"""Line deduplication (operator 10): repeated line runs by a suffix array, in DataFrame functions only.

A text is the sequence of its non-blank lines.  Prefix doubling ranks every
position by its first 1, 2, 4, ... lines: rank ``2k`` orders the pairs (rank
``k`` here, rank ``k`` k lines on).  Positions of equal rank are an interval of
the suffix array whose longest common prefix is at least that many lines.  A
position alone in its interval has no repeat and is dropped at once.  Two
overlapping intervals of one level name the interval of any longer prefix, so the
positions whose common prefix has enough words are found together; overlapping
repeats join to the maximal run that is deleted.

What goes: a line inside a run of lines with at least ``min_words`` words that
occurs earlier, where earlier is by key, text hash and line, and an earlier copy
in the same text must end before the later one begins.  The first copy stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Records with deletions that may be sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def lines_of(rows: DataFrame) -> DataFrame:
    """``key, row, at, line, words, a, b``: the non-blank lines; ``line`` counts all lines, ``at`` these, ``a`` and ``b`` name the line."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")),
    )
    split = rows.select("key", "row", F.posexplode(F.filter(lines, lambda x: x["words"] > 0)).alias("at", "l"))
    return split.select("key", "row", "at", "l.line", "l.words", "l.a", "l.b")


def rank_repeats(items: DataFrame, by: list[str], partitions: int, space: Workspace) -> DataFrame:
    """Distinct values of ``by`` that occur more than once, and ``__rank``, their rank among these.

    Values are range-partitioned and numbered inside each range; the ranges'
    counts (one row a partition) shift the numbers.
    """
    repeated = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    ranged = repeated.repartitionByRange(partitions, *by).withColumn("part", F.spark_partition_id())
    stored = space.store(ranged, "ranks")
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    shift = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    shifted = stored.withColumn("__number", number).join(F.broadcast(shift), "part")
    return shifted.select(*by, (F.col("__number") + F.col("shift")).alias("__rank"))


def recurring_lines(lines: DataFrame, partitions: int, space: Workspace) -> DataFrame:
    """``key, row, at, line, words, rank, stretch``: lines that recur; no gap lies inside a stretch."""
    ranked = lines.join(rank_repeats(lines, ["a", "b"], partitions, space), ["a", "b"]).select("key", "row", "at", "line", "words", F.col("__rank").alias("rank"))
    doc = Window.partitionBy("key", "row").orderBy("at")
    # repeated rows count once
    once = ranked.withColumn("last", F.lag("at").over(doc)).where("last is null or last <> at").drop("last")
    return space.store(once.withColumn("stretch", F.col("at") - F.row_number().over(doc)), "recurring")


def suffix_ranks(recurring: DataFrame, levels: int, partitions: int, space: Workspace) -> DataFrame:
    """Positions whose first 2^k lines recur, for every level k: ``level, key, row, at, rank``."""
    found = recurring.select("key", "row", "at", "rank")
    every = found.withColumn("level", F.lit(0))
    for k in range(1, levels + 1):
        step = 2 ** (k - 1)
        # positions that recur alone are gone, so the one `step` lines on is found by value, not by row
        ahead = Window.partitionBy("key", "row").orderBy("at").rangeBetween(step, step)
        pairs = space.store(found.withColumn("next", F.max("rank").over(ahead)).where("next is not null"), "pairs")
        ranks = rank_repeats(pairs, ["rank", "next"], partitions, space)
        found = space.store(pairs.join(ranks, ["rank", "next"]).select("key", "row", "at", F.col("__rank").alias("rank")), "suffix")
        space.drop(pairs)
        every = every.unionByName(found.withColumn("level", F.lit(k)))
    return every


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``key, row, at, n``: from every line forward, and to every line backward, the shortest run with enough words.

    Runs stay inside a stretch.  Every longer run is a union of these.  Each line has a word, so a run has at
    most ``min_words`` lines.  Running sums at the lines' ends and starts are
    merged into one order, which finds a run's other end without a search.
    """
    doc = Window.partitionBy("key", "row", "stretch")
    upto = F.sum("words").over(doc.orderBy("at")).cast("long")
    summed = lines.select("key", "row", "stretch", "at", "words", upto.alias("upto")).withColumn("before", F.col("upto") - F.col("words"))
    mark = lambda x, asks: summed.select("key", "row", "stretch", "at", x.alias("x"), F.lit(asks).alias("asks"))
    answer = F.when(~F.col("asks"), F.col("at"))
    marks = mark(F.col("upto"), False).unionByName(mark(F.col("before") + min_words, True))
    end = F.min(answer).over(doc.orderBy(F.desc("x"), "asks").rowsBetween(Window.unboundedPreceding, 0))
    forward = marks.withColumn("end", end).where("asks and end is not null").select("key", "row", "at", (F.col("end") - F.col("at") + 1).alias("n"))
    marks = mark(F.col("before"), False).unionByName(mark(F.col("upto") - min_words, True))
    start = F.max(answer).over(doc.orderBy("x", "asks").rowsBetween(Window.unboundedPreceding, 0))
    backward = (
        marks.withColumn("start", start).where("asks and start is not null")
        .select("key", "row", F.col("start").alias("at"), (F.col("at") - F.col("start") + 1).alias("n"))
    )
    return forward.unionByName(backward).distinct()


def later_runs(runs: DataFrame, ranks: DataFrame, space: Workspace) -> DataFrame:
    """The runs that have an earlier copy: ``key, row, at, n``.

    A run of n lines is named by its length and two ranks of the level below n:
    at its start, and 2^level lines before its end.
    """
    level = F.floor(F.log2("n") + 1e-9).cast("int")
    leveled = runs.withColumn("level", level)
    named = leveled.join(ranks.withColumnRenamed("rank", "a"), ["level", "key", "row", "at"])
    tail = ranks.select("level", "key", "row", F.col("at").alias("tail"), F.col("rank").alias("b"))
    named = (
        named.withColumn("tail", F.expr("cast(at + n - shiftleft(1, level) as int)"))
        .join(tail, ["level", "key", "row", "tail"]).select("key", "row", "at", "n", "a", "b")
    )
    named = space.store(named, "runs")
    first = named.groupBy("n", "a", "b").agg(F.min(F.struct("key", "row", "at")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    apart = (F.col("first.row") != F.col("row")) | (F.col("first.key") != F.col("key")) | (F.col("at") >= F.col("first.at") + F.col("n"))
    return named.join(first, ["n", "a", "b"]).where(apart).select("key", "row", "at", "n")


def repeated_lines(rows: DataFrame, min_words: int = 50, partitions: int | None = None) -> DataFrame:
    """Stretches of lines to delete: ``key, row, spans`` (array of first and last line), ``removed`` and ``words``.

    ``rows`` has the columns ``key, row, text`` without nulls; rows of equal key and
    row are one text.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = Workspace(rows.sparkSession, "linedup")
    lines = space.store(lines_of(rows), "lines")
    recurring = recurring_lines(lines, partitions, space)
    space.drop(lines)
    ranks = suffix_ranks(recurring, int(min_words).bit_length() - 1, partitions, space)
    # stored before it is joined: with spark.sql.unionOutputPartitioning (on by default in Spark 4.1) the union passes for partitioned by
    # a column that one half renames, the join then skips a shuffle and loses rows of that half; tables.py turns it off as well
    later = later_runs(space.store(shortest_runs(recurring, min_words), "shortest"), ranks, space)
    ends = later.groupBy("key", "row", "at").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    # a line is covered if some run begins at or before it and ends after it
    gone = recurring.select("key", "row", "at", "line", "words").join(ends, ["key", "row", "at"], "left")
    doc = Window.partitionBy("key", "row").orderBy("at")
    gone = gone.withColumn("reach", F.max("end").over(doc)).where("reach > at")
    island = F.col("at") - F.row_number().over(doc)
    spans = (
        gone.withColumn("island", island).groupBy("key", "row", "island")
        .agg(F.struct(F.min("line").alias("first"), F.max("line").alias("last")).alias("span"), F.count(F.lit(1)).alias("c"), F.sum("words").alias("w"))
    )
    found = spans.groupBy("key", "row").agg(
        F.array_sort(F.collect_list("span")).alias("spans"), F.sum("c").alias("removed"), F.sum("w").cast("long").alias("words")
    )
    return space.finish(found, "spans")


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Delete later copies of repeated line runs.

    All columns pass through, ``text`` without the deleted lines (and the blank
    lines between them); ``removed_lines`` and ``removed_words`` count what went
    and ``removed_spans`` lists its stretches as ``first-last``, lines counted
    from 0.  A null text stays null, a null key sorts first, an empty table
    stays empty.  Repeated rows (equal key and text) count once and get the same
    result each.
    """
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    name = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))) if whole else F.coalesce(F.col(key).cast("string"), F.lit(""))
    tag = docs.withColumn("__key", name)
    tag = tag.withColumn("__row", F.xxhash64(text))
    rows = tag.where(F.col(text).isNotNull()).select(F.col("__key").alias("key"), F.col("__row").alias("row"), F.col(text).alias("text"))
    found = repeated_lines(rows, min_words).toDF("__key", "__row", "__spans", "__removed", "__words")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    inside = lambda i: F.exists("__spans", lambda s: (s["first"] <= i) & (i <= s["last"]))
    rest = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~inside(i)), "\n")
    return (
        tag.join(found, ["__key", "__row"], "left")
        .withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(rest))
        .withColumn("removed_lines", F.coalesce("__removed", F.lit(0)).cast("long"))
        .withColumn("removed_words", F.coalesce("__words", F.lit(0)).cast("long"))
        .withColumn(
            "removed_spans",
            F.coalesce(F.array_join(F.transform("__spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ","), F.lit("")),
        )
        .drop("__key", "__row", "__spans", "__removed", "__words")
    )
