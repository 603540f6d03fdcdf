"""Source divergence audit (operator 13): a quadtree over the matrix of groups and terms.

Within a language every source is a row and every kept term a column of counts.
The matrix is dealt out by tiles of rows and columns; each tile is a tree whose
quadrants know whether they hold any count.  Two tiles over the same columns are
walked down together: where both are all zero, every term of a pair of groups
costs the same, so the quadrant is priced as that cost times its columns; only
where one of them holds counts does the walk go on, down to leaves that are
compared cell by cell.  All arithmetic is on integers.

A group with most of the rows is no large task: counts are summed inside the
tasks that read the texts, and what is shuffled are distinct terms by group.
Null text, language and source are the empty string; other columns are ignored;
repeated rows count each for itself; an empty table gives an empty report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tidy

#: What stands between terms, once lower-cased.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Share 1, in which probabilities are counted.
UNIT = 1_000_000_000
#: Rows of a tile, its most columns, and the rows and columns of a leaf.
TILE_ROWS, TILE_COLUMNS, LEAF_ROWS, LEAF_COLUMNS = 64, 2048, 8, 64
#: Distinct (group, term) pairs that a task sums before it hands them on.
HELD_PAIRS = 400_000


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])

        for batch in batches:
            lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(0)), pattern=GAPS)
            words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
            real = pc.greater(pc.binary_length(words), 0)
            coded, owner = words.filter(real).dictionary_encode(), owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(owner):
                continue
            ids, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            # (document, term) pairs first, then (group, term): a document counts once for its term
            mine, count = np.unique(owner * size + ids, return_counts=True)
            row, term = np.divmod(mine, size)
            parts.append(pa.table({
                "lang": batch.column(1).take(pa.array(row)), "source": batch.column(2).take(pa.array(row)), "term": coded.dictionary.take(pa.array(term)),
                "n": pa.array(count.astype(np.int64)), "docs": pa.array(np.ones(len(row), np.int64)),
            }))
            held += len(row)
            if held > HELD_PAIRS:
                parts = [summed()]
                held = parts[0].num_rows
                if held > HELD_PAIRS // 2:
                    yield from parts[0].combine_chunks().to_batches(100_000)
                    parts, held = [], 0
        if parts:
            yield from summed().combine_chunks().to_batches(100_000)

    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    partial = texts.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """A smoothed share of a count in units of ``UNIT``, at least 1; exact beyond 64 bits.  Null where nothing is kept."""
    top = f"cast({count} + 2 as decimal(20,0)) * cast({UNIT} as decimal(10,0))"
    return F.expr(f"case when {terms} > 0 then 1 + ({top}) div cast({total} + 2 * {terms} as decimal(20,0)) end")


def difference(p: str, q: str) -> Column:
    """What two shares differ by: their squared difference over their sum, rounded down; never above 64 bits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


class Tile:
    """Quadtree over a tile of the matrix: cells, the price of an empty cell by row, and which quadrants hold counts."""

    def __init__(self, cells: np.ndarray, empty: np.ndarray, leaf: tuple[int, int], depth: int):
        self.cells, self.empty, self.leaf, self.depth = cells, empty, leaf, depth
        side, (rows, columns) = 1 << depth, leaf
        held = (cells > 0).reshape(side, rows, side, columns).any(axis=(1, 3))
        self.holds = [held]
        while len(self.holds[0]) > 1:
            below = self.holds[0]
            self.holds.insert(0, below.reshape(len(below) // 2, 2, len(below) // 2, 2).any(axis=(1, 3)))


def walk(a: Tile, b: Tile, width: int, same: bool) -> tuple[np.ndarray, int]:
    """Sums of cell differences of every row of ``a`` with every row of ``b``, and how many quadrants were priced whole.

    Both tiles cover the same ``width`` columns.  With ``same`` only pairs of
    quadrants on or above the diagonal are walked.
    """
    rows, columns = a.leaf
    total = np.zeros((len(a.empty), len(b.empty)), np.int64)
    apart = (a.empty[:, None] - b.empty[None, :]) ** 2 // (a.empty[:, None] + b.empty[None, :])
    priced = 0
    todo = [(0, 0, 0, 0)]
    while todo:
        level, i, j, c = todo.pop()
        left = a.depth - level
        c0, c1 = (c * columns) << left, min(((c + 1) * columns) << left, width)
        if c0 >= c1 or (same and i > j):
            continue
        of_a, of_b = slice((i * rows) << left, ((i + 1) * rows) << left), slice((j * rows) << left, ((j + 1) * rows) << left)
        if not a.holds[level][i, c] and not b.holds[level][j, c]:
            total[of_a, of_b] += apart[of_a, of_b] * (c1 - c0)
            priced += 1
        elif not left:
            p, q = a.cells[of_a, c0:c1], b.cells[of_b, c0:c1]
            p, q = np.where(p > 0, p, a.empty[of_a, None])[:, None, :], np.where(q > 0, q, b.empty[of_b, None])[None, :, :]
            total[of_a, of_b] += ((p - q) ** 2 // (p + q)).sum(axis=2)
        else:
            todo += [(level + 1, 2 * i + x, 2 * j + y, 2 * c + z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    return total, priced


def _tile(number: np.ndarray, column: np.ndarray, p: np.ndarray, first: int, width: int) -> Tile:
    depth = (TILE_ROWS // LEAF_ROWS).bit_length() - 1
    columns = -(-width // (1 << depth))
    cells, empty = np.zeros((TILE_ROWS, columns << depth), np.int64), np.ones(TILE_ROWS, np.int64)
    whole = column < 0
    empty[number[whole] - first] = p[whole]
    cells[number[~whole] - first, column[~whole]] = p[~whole]
    return Tile(cells, empty, (LEAF_ROWS, columns), depth)


def compare_tiles(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one pair of row tiles over one slice of columns: ``lang, a, b, value`` with ``a < b``.

    ``frame`` has ``number, column, p`` of every cell with a count, and for every
    row one entry at column -1: the share of an empty cell.
    """
    lang, _, upper, lower = key
    number, column, p = (frame[c].to_numpy(np.int64) for c in ("number", "column", "p"))
    width, block = int(frame["width"].iloc[0]), number // TILE_ROWS
    a = _tile(number[block == upper], column[block == upper], p[block == upper], upper * TILE_ROWS, width)
    b = a if upper == lower else _tile(number[block == lower], column[block == lower], p[block == lower], lower * TILE_ROWS, width)
    total, _ = walk(a, b, width, upper == lower)
    known = np.unique(number[column < 0])
    x, y = np.meshgrid(known[known // TILE_ROWS == upper], known[known // TILE_ROWS == lower], indexing="ij")
    keep = x < y
    x, y = x[keep], y[keep]
    return pd.DataFrame({"lang": lang, "a": x, "b": y, "value": total[x - upper * TILE_ROWS, y - lower * TILE_ROWS]})


def _tiled(entries: DataFrame) -> DataFrame:
    """Send every entry of a row tile to the tiles it is compared with."""
    block = F.floor(F.col("number") / TILE_ROWS).cast("long")
    last = F.floor((F.col("groups") - 1) / TILE_ROWS).cast("long")
    sent = entries.withColumn("__own", block).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return sent.select("lang", "slice", F.least("__own", "__other").alias("upper"), F.greatest("__own", "__other").alias("lower"), "number", "column", "p", "width")


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10, columns: int = TILE_COLUMNS // 2, spread: int = 32,
) -> DataFrame:
    """How far the sources of a language lie apart, and by which terms each stands out.

    Returns ``lang, source, part, item, value, rank``: in part ``pair`` every other
    source of the language with the sum over all kept terms, in part ``term`` the
    ``top`` terms that a source has more of than its language.  A term is kept
    in a language if ``least_docs`` of its documents hold it.
    """
    space = Workspace(docs.sparkSession, "divergence")
    counts = space.store(term_counts(docs, text, lang, source), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = space.store(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    # columns: slices by hash, frequent terms first, so that empty cells stand together
    sliced = kept.join(langs, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / columns).cast("long")))
    sliced = sliced.withColumn("column", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(F.desc("docs"), "term")) - 1)
    cells = space.store(counts.select("lang", "source", "term", "n").join(sliced, ["lang", "term"]), "cells")
    widths = sliced.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("width"))

    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    whole = Window.partitionBy("lang")
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_total", "terms", "lang_total"])
    groups = groups.withColumn("number", F.row_number().over(whole.orderBy("source")).cast("long") - 1).withColumn("groups", F.count(F.lit(1)).over(whole))
    groups = space.store(groups.withColumn("empty", share("0", "group_total", "terms")), "groups")

    # a group's cells are spread over ``spread`` keys for the join with its one row
    shift = groups.select("lang", "source", "number", "groups", "group_total", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    priced = cells.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(spread)).cast("int")).join(shift, ["lang", "source", "salt"])
    priced = space.store(priced.withColumn("p", share("n", "group_total", "terms")).withColumn("q", share("total", "lang_total", "terms")).drop("salt"), "priced")

    blanks = groups.join(widths, "lang").select("lang", "slice", "number", "groups", F.lit(-1).alias("column"), F.col("empty").alias("p"), "width")
    entries = priced.join(widths, ["lang", "slice"]).select("lang", "slice", "number", "groups", "column", "p", "width").unionByName(blanks)
    partial = _tiled(entries).groupBy("lang", "slice", "upper", "lower").applyInPandas(compare_tiles, "lang string, a long, b long, value long")
    summed = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    nothing = groups.where("terms = 0").select("lang", F.col("number").alias("a"), F.col("groups").alias("g"))
    nothing = nothing.where("g > 1").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    once = summed.unionByName(nothing)
    both = once.unionByName(once.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = both.join(groups.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"]).join(groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = priced.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return space.finish(pairs.unionByName(terms), "divergence")
