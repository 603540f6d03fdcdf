"""Shared pieces of the training-data operators: stored tables, gapless ranks, components, workers' memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.sources.tables import Workspace
from threadline.sources.tables import stored as materialize

__all__ = ["Workspace", "connected_components", "gapless_rank", "materialize", "tidy"]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker's function that gives the memory it freed back to the system when it ends.

    Python workers live on and serve later stages; without this each keeps the
    most that any stage took.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return tidied


def gapless_rank(df: DataFrame, group: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in each group, ordered by ``bucket`` and then ``order``.

    No group is sorted in one task: rows are ranked within (group, bucket) and
    shifted by the rows of the group's earlier buckets.  ``df`` is read twice,
    so pass a stored table.  The table of shifts has a row per group and
    bucket, a number the caller's parameters bound.
    """
    b, n = "__bucket", "__rows"
    d = df.withColumn(b, bucket)
    keys = [*group, b]
    shift = (
        d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        .withColumn("__shift", F.sum(n).over(Window.partitionBy(*group).orderBy(b)) - F.col(n))
        .drop(n)
    )
    ranked = d.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return (
        ranked.join(F.broadcast(shift), keys)
        .withColumn(out, (F.col(out) + F.col("__shift")).cast("long"))
        .drop(b, "__shift")
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Component of every node that an edge touches.

    ``edges`` has the columns ``a`` and ``b`` (any order, repeats allowed).
    Returns ``node, component``, the component's smallest node.  Alternating
    large-star and small-star steps: each is one grouped minimum with map-side
    combining, so a node with very many edges needs no large group, and edges
    are written to the shared folder after each step.
    """
    space = Workspace(edges.sparkSession, "components")
    now = space.store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        large = space.store(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after = space.store(small, "edges")
        space.drop(now, large)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return space.finish(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
