"""The best hits before a watermark, for many watermarks at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.sources.tables import stored

#: Rows of one block of the id axis, and askers that one task answers.
BLOCK_ROWS, ASKERS = 500_000, 10_000
ASK, HIT, CARRIED = 0, 1, 2
#: Hits that a task holds while it leaves out those that no pool can hold.
HELD_HITS = 500_000
FIELDS = ["id", "text_score", "rounded", "side", "ts"]
TYPES = {"id": "long", "text_score": "double", "rounded": "double", "side": "int", "ts": "string", "entity_score": "double", "entity_count": "long", "relevance": "double", "final": "double"}
#: What a pool's turns have besides once entities are known.
SCORED = ["entity_score", "entity_count", "relevance", "final"]
ANSWER = "query_id long, turn_id long, text_score double, side int, ts string"
MEMBER = "set_id string, words_id string, turn_id long, text_score double, side int, ts string"
RANKED = "query_id long, turn_id long, text_score double, side int, ts string, entity_score double, entity_count long, relevance double, rank int"


def places(hits: pa.Table, score: str = "rounded") -> tuple[np.ndarray, np.ndarray]:
    """Place of every hit in the order of a rounded score, main before side transcripts, newest first (unknown times last), then id; and the hit at each place."""
    keys = [(score, "descending"), ("side", "ascending"), ("ts", "descending"), ("id", "ascending")]
    row_at = pc.sort_indices(hits, sort_keys=keys, null_placement="at_end").to_numpy().astype(np.int64)
    out = np.empty(len(row_at), np.int64)
    out[row_at] = np.arange(len(row_at))
    return out, row_at


def _better(best: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    both = np.append(best, more)
    return both if len(both) <= k else np.partition(both, k - 1)[:k]


def _carry(k: int, fields: list[str]):
    """For every block of a set in which something is asked: the best ``k`` of all blocks before it."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        asked = np.unique(table["block"].to_numpy()[kind == ASK])
        hits = table.filter(pa.array(kind == HIT)).sort_by("block")
        (place, row_at), block = places(hits), hits["block"].to_numpy()
        best, done, parts = np.zeros(0, np.int64), 0, [hits.slice(0, 0)]
        for b in asked:
            upto = int(np.searchsorted(block, b))
            best, done = _better(best, place[done:upto], k), upto
            chosen = hits.take(pa.array(row_at[best]))
            parts.append(chosen.set_column(chosen.schema.get_field_index("block"), "block", pa.array(np.full(len(best), b, np.int32))))
        return pa.concat_tables(parts).select(["set_id", "block", *fields])

    return run


def _pools(table: pa.Table, k: int):
    """The hits and askers of a block, both by id, places, and the pool of every asker: one pass, askers between which nothing entered share one array."""
    kind = table["kind"].to_numpy()
    asks = table.filter(pa.array(kind == ASK)).sort_by("id")
    hits = table.filter(pa.array(kind != ASK)).sort_by([("kind", "descending"), ("id", "ascending")])  # carried ones are before all askers
    place, row_at = places(hits)
    known = hits["id"].to_numpy().copy()
    known[hits["kind"].to_numpy() == CARRIED] = np.iinfo(np.int64).min
    best, done, pools = np.zeros(0, np.int64), 0, []
    for upto in np.searchsorted(known, asks["id"].to_numpy()).tolist():
        more = place[done:upto]
        if len(more) and (len(best) < k or more.min() < best.max()):
            best = _better(best, more, k)
        done = max(done, upto)
        pools.append(best)
    return hits, asks, row_at, pools


def _answer(k: int):
    """Every asker's best ``k``."""

    def run(table: pa.Table) -> pa.Table:
        hits, asks, row_at, pools = _pools(table, k)
        chosen = hits.take(pa.array(row_at[np.concatenate([np.zeros(0, np.int64), *pools])]))
        who = np.repeat(asks["query_id"].to_numpy(), [len(p) for p in pools]) if len(asks) else np.zeros(0, np.int64)
        return pa.table([pa.array(who), chosen["id"], chosen["text_score"], chosen["side"], chosen["ts"]], names=["query_id", "turn_id", "text_score", "side", "ts"])

    return run


def _members(k: int):
    """The hits that are in the pool of any asker of a list of words, once for each list."""

    def run(table: pa.Table) -> pa.Table:
        hits, asks, row_at, pools = _pools(table, k)
        names = asks["words_id"].combine_chunks().dictionary_encode()
        seen: dict[int, np.ndarray] = {}
        parts = [np.zeros(0, np.int64)]
        for word, pool in zip(names.indices.to_pylist(), pools):
            if seen.get(word) is not pool:
                seen[word] = pool
                parts.append(pool + word * len(row_at))
                if len(parts) > 2000:
                    parts = [np.unique(np.concatenate(parts))]
        both = np.unique(np.concatenate(parts))
        chosen = hits.take(pa.array(row_at[both % max(1, len(row_at))]))
        return pa.table(
            [pa.array([table["set_id"][0].as_py()] * len(both), pa.string()), names.dictionary.take(pa.array(both // max(1, len(row_at)))), chosen["id"], chosen["text_score"], chosen["side"], chosen["ts"]],
            names=["set_id", "words_id", "turn_id", "text_score", "side", "ts"],
        )

    return run


def _ranks(k: int, n: int):
    """The first ``n`` of every asker's pool by what they score with their entities."""

    def run(table: pa.Table) -> pa.Table:
        hits, asks, row_at, pools = _pools(table, k)
        final, _ = places(hits, "final")
        last, top, tops = None, np.zeros(0, np.int64), []
        for pool in pools:
            if pool is not last:
                rows = row_at[pool]
                last, top = pool, rows[np.argsort(final[rows])[:n]]
            tops.append(top)
        chosen = hits.take(pa.array(np.concatenate([np.zeros(0, np.int64), *tops])))
        who = np.repeat(asks["query_id"].to_numpy(), [len(t) for t in tops]) if len(asks) else np.zeros(0, np.int64)
        rank = np.concatenate([np.zeros(0, np.int64), *[np.arange(1, len(t) + 1) for t in tops]]).astype(np.int32)
        names = ["text_score", "side", "ts", "entity_score", "entity_count", "relevance"]
        return pa.table([pa.array(who), chosen["id"], *[chosen[c] for c in names], pa.array(rank)], names=["query_id", "turn_id", *names, "rank"])

    return run


def _unbeaten(table: pa.Table, k: int) -> pa.Table:
    """Hits without those that at least ``k`` better ones of their set with lower ids precede."""
    scores, back = np.unique(table["text_score"].to_numpy(), return_inverse=True)
    rounded = np.array([round(x, 9) for x in scores.tolist()])[back]
    place, _ = places(pa.table([table["turn_id"], pa.array(rounded), table["side"], table["ts"]], names=["id", "rounded", "side", "ts"]))
    code = table["set_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((table["turn_id"].to_numpy(), code))
    kept = np.ones(len(order), bool)
    ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order))
    for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        best = np.zeros(0, np.int64)
        for a in range(start, end if end - start > k else start, k):
            more = place[order[a : min(a + k, end)]]
            if len(best) == k:
                kept[a : a + len(more)] = more < best.max()
            best = _better(best, more, k)
    return table.take(pa.array(np.sort(order[kept])))


def contenders(k: int, held: int = HELD_HITS):
    """Of a task's hits (``set_id, turn_id, text_score, side, ts``) those that may be among the best ``k`` before some watermark.

    Whoever sees a hit sees every hit with a lower id, so one with ``k`` better
    ones below it is in no pool.  Each task judges by the hits that it holds
    itself, before anything is written or moved; what it cannot tell stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size > held:
                left = _unbeaten(pa.Table.from_batches(parts), k)
                parts, size = left.to_batches(), left.num_rows
                if size > held // 2:
                    yield from parts
                    parts, size = [], 0
        if size:
            yield from _unbeaten(pa.Table.from_batches(parts), k).to_batches()

    return run


def top_before(hits: DataFrame, asks: DataFrame, k: int, block_rows: int = BLOCK_ROWS, askers: int = ASKERS) -> DataFrame:
    """The ``k`` best hits of each asker's set with an id below its watermark.

    ``hits``: ``set_id, turn_id, text_score, side, ts``; ``asks``: ``query_id,
    set_id, before_turn_id``.  Returns ``query_id, turn_id, text_score, side, ts``.

    Askers of one set share one ordered pass over (hits, askers), so the work is
    hits plus answers, never hits times askers.  The id axis is cut into blocks
    of equal size: a set's best ``k`` are carried from block to block, so a set
    that most hits belong to is as many tasks as it has blocks.  Both tables are
    read more than once; pass stored ones.
    """
    return _blocks(hits, asks, k, block_rows, askers).applyInArrow(_answer(k), ANSWER)


def ever_before(hits: DataFrame, asks: DataFrame, k: int, block_rows: int = BLOCK_ROWS, askers: int = ASKERS) -> DataFrame:
    """``set_id, words_id, turn_id, text_score, side, ts``: the hits that :func:`top_before` gives to any asker of a list of words (``words_id`` of ``asks``), once.

    Of hits in no order of their ids few ever enter the best ``k``, so this is
    far less than a pool for each asker, and never more.
    """
    found = _blocks(hits, asks, k, block_rows, askers).applyInArrow(_members(k), MEMBER)
    return found.groupBy("set_id", "words_id", "turn_id").agg(*[F.first(c).alias(c) for c in ("text_score", "side", "ts")])


def ranked_before(members: DataFrame, asks: DataFrame, k: int, n: int, block_rows: int = BLOCK_ROWS, askers: int = ASKERS) -> DataFrame:
    """The ``n`` best by ``relevance`` of every asker's ``k`` best by ``text_score`` before its watermark, with ``rank``.

    ``members`` is what :func:`ever_before` found, with ``entity_score,
    entity_count, relevance``: it holds every asker's pool, so the pool of all
    hits is the pool of these.
    """
    unit = F.concat_ws("/", "set_id", "words_id").alias("set_id")
    scored = members.select(unit, "turn_id", "text_score", "side", "ts", "entity_score", "entity_count", "relevance", F.round("relevance", 9).alias("final"))
    return _blocks(scored, asks.select("query_id", unit, "before_turn_id"), k, block_rows, askers, SCORED).applyInArrow(_ranks(k, n), RANKED)


def _blocks(hits: DataFrame, asks: DataFrame, k: int, block_rows: int, askers: int, more: list[str] = []):  # noqa: B006
    """Rows of every (set, block, chunk of askers): its hits, the best carried from the blocks before, and its askers."""
    fields = [*FIELDS, *more]
    words = ["words_id"] if "words_id" in asks.columns else []
    axis = hits.select("set_id", F.col("turn_id").alias("id"), "text_score", F.round("text_score", 9).alias("rounded"), F.col("side").cast("int"), "ts", *more, F.lit(HIT).alias("kind"), F.lit(None).cast("long").alias("query_id"))
    axis = axis.unionByName(asks.select("set_id", F.col("before_turn_id").alias("id"), F.lit(ASK).alias("kind"), "query_id", *words), allowMissingColumns=True)
    blocks = max(1, -(-axis.count() // block_rows))
    axis = stored(axis.repartitionByRange(blocks, "id").withColumn("block", F.spark_partition_id()) if blocks > 1 else axis.withColumn("block", F.lit(0)), "axis")
    asked = axis.where(F.col("kind") == ASK)
    groups = asked.groupBy("set_id", "block").agg(F.ceil(F.count(F.lit(1)) / askers).cast("int").alias("chunks"))
    held = axis.where(F.col("kind") == HIT)
    needed = held
    if blocks > 1:
        by_place = Window.partitionBy("set_id", "block").orderBy(F.desc("rounded"), "side", F.col("ts").desc_nulls_last(), "id")
        tops = held.withColumn("r", F.row_number().over(by_place)).where(F.col("r") <= k).drop("r")
        marks = groups.select("set_id", "block", F.lit(ASK).alias("kind"))
        carried = tops.unionByName(marks, allowMissingColumns=True).groupBy("set_id").applyInArrow(_carry(k, fields), ", ".join(["set_id string", "block int", *[f"{c} {TYPES[c]}" for c in fields]]))
        needed = held.unionByName(carried.withColumn("kind", F.lit(CARRIED)), allowMissingColumns=True)
    sent = needed.join(groups, ["set_id", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = asked.join(groups, ["set_id", "block"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    both = sent.unionByName(own).select("set_id", "block", "chunk", "kind", "query_id", *words, *fields)
    return both.groupBy("set_id", "block", "chunk")
