"""Decisions of a session in the order its prompts arrive: what is given, what is refused and why.

What a session was given, what its digest quoted and whether a compaction is
still owed live in one small state, which the batch form carries over the sorted
prompts of a session and the stream form keeps between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.operators.recommend import THRESHOLDS, eligible, quotable

REASONS = ("already given", "visible", "carried by digest")
DECISIONS = "session_id string, query_id long, turn_id long, place int, reason string, compacted boolean"


@dataclass
class SessionState:
    """``given`` and ``briefed`` turns, compactions seen by a prompt, and whether one is owed."""

    given: set[int] = field(default_factory=set)
    briefed: set[int] = field(default_factory=set)
    seen: int = 0


def judge(state: SessionState, compactions: int, hits: Iterable[tuple[int, int, bool, bool]], window: int, wide: int, most: int) -> tuple[list[tuple[int, int | None, str | None]], bool]:
    """Decide one prompt and remember it: ``(turn_id, place, reason)`` of every turn that was looked at.

    ``hits`` are the eligible ones by rank: ``turn_id, rank, own session, fell
    out of the context``.  The first prompt after a compaction looks at a wider
    window, but only at turns that the compaction dropped.  The first reason
    that holds is the one; nothing is looked at once ``most`` turns are given.
    """
    owed = compactions > state.seen
    state.seen = max(state.seen, compactions)
    out: list[tuple[int, int | None, str | None]] = []
    place = 0
    for turn, rank, own, fell_out in hits:
        if place == most:
            break
        if rank > (wide if owed else window) or (owed and not fell_out):
            continue
        if turn in state.given:
            out.append((turn, None, REASONS[0]))
        elif own and not (owed and fell_out):
            out.append((turn, None, REASONS[1]))
        elif turn in state.briefed:
            out.append((turn, None, REASONS[2]))
        else:
            place += 1
            out.append((turn, place, None))
            state.given.add(turn)
    return out, owed


def offers(hits: DataFrame, prompts: DataFrame) -> DataFrame:
    """What each prompt may choose from, for :func:`decide`: a row per eligible hit, and one of rank 0 for the prompt itself.

    ``hits``: ranked candidates up to the wide window.  ``prompts``: ``query_id,
    session_id, session_key, arrival`` and what :func:`latest_boundary` adds.
    A turn of the prompt's own session fell out of the context if it is older
    than the latest compaction and not among the turns that this preserved; a
    compaction that preserves nothing dropped nothing.
    """
    columns = ["session_id", "arrival", "query_id", "compactions", "rank", "turn_id", "own", "fell_out"]
    ok = hits.where(eligible() & quotable()).select("query_id", "turn_id", "rank", "session_key")
    found = ok.join(prompts.withColumnRenamed("session_key", "__own"), "query_id").withColumn("own", F.coalesce(F.col("session_key") == F.col("__own"), F.lit(False)))
    fell = F.col("own") & (F.col("turn_id") < F.col("boundary_turn")) & (F.size("preserved") > 0) & ~F.array_contains("preserved", F.col("turn_id"))
    marks = prompts.withColumn("rank", F.lit(0)).withColumn("turn_id", F.lit(None).cast("long")).withColumn("own", F.lit(False)).withColumn("fell_out", F.lit(False))
    return found.withColumn("fell_out", F.coalesce(fell, F.lit(False))).select(*columns).unionByName(marks.select(*columns))


def decide(offered: DataFrame, briefed: DataFrame, window: int = THRESHOLDS["window"], wide: int = THRESHOLDS["compacted_window"], most: int = THRESHOLDS["max_turns"]) -> DataFrame:
    """``session_id, query_id, turn_id, place, reason, compacted``: turns given (``place``) and refused (``reason``), prompt after prompt.

    ``briefed``: ``session_id, turn_id`` that the digest quoted at the start.  A
    session's prompts are one sorted run of a task's rows, read batch by batch,
    so a session of any length takes the memory of its state only.
    """
    first = briefed.select("session_id", F.lit(-1).cast("long").alias("arrival"), F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("compactions"), F.lit(-1).alias("rank"), "turn_id", F.lit(False).alias("own"), F.lit(False).alias("fell_out"))
    fields = first.columns
    both = offered.select(*fields).unionByName(first)
    order = ["session_id", "arrival", "query_id", "rank", "turn_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, session, prompt, hits, compactions = SessionState(), None, None, [], 0

        def close() -> list[tuple]:
            if prompt is None:
                return []
            made, owed = judge(state, compactions, hits, window, wide, most)
            return [(session, prompt, t, p, r, owed) for t, p, r in made]

        names = ["session_id", "query_id", "turn_id", "place", "reason", "compacted"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            c = {n: batch.column(n).to_pylist() for n in fields}
            for sid, query, count, rank, turn, own, fell in zip(c["session_id"], c["query_id"], c["compactions"], c["rank"], c["turn_id"], c["own"], c["fell_out"]):
                if sid != session:
                    out += close()
                    state, session, prompt, hits = SessionState(), sid, None, []
                if rank == -1:
                    state.briefed.add(turn)
                elif rank == 0:
                    out += close()
                    prompt, compactions, hits = query, count, []
                else:
                    hits.append((turn, rank, own, fell))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)
        out = close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)

    return both.repartition("session_id").sortWithinPartitions(*order).mapInArrow(run, DECISIONS)


def latest_boundary(prompts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Add to prompts (``query_id, session_key``) how many compactions precede each and the latest: ``compactions, boundary_turn, preserved``.

    ``boundaries``: ``session_key, boundary_turn, preserved``, the ids of the
    boundary's turn and of the turns it kept.  One sorted pass over each session.
    """
    both = prompts.withColumn("__at", F.col("query_id")).withColumn("__b", F.lit(0)).unionByName(boundaries.select("session_key", F.col("boundary_turn").alias("__at"), "boundary_turn", "preserved", F.lit(1).alias("__b")), allowMissingColumns=True)
    before = Window.partitionBy("session_key").orderBy("__at", "__b").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("compactions", F.sum("__b").over(before).cast("int"))
    for name in ("boundary_turn", "preserved"):
        found = found.withColumn(name, F.last(name, ignorenulls=True).over(before))
    return found.where("__b = 0").drop("__b", "__at")


def boundary_turns(compactions: DataFrame, turns: DataFrame) -> DataFrame:
    """``session_key, boundary_turn, preserved`` from compactions (``session_key, stream_offset, preserved`` with uuids) and ``turns`` with ids."""
    at = turns.select("session_key", "stream_offset", F.col("turn_id").alias("boundary_turn"))
    known = compactions.select("session_key", "stream_offset", "preserved").join(at, ["session_key", "stream_offset"])
    named = known.select("session_key", "boundary_turn", F.explode("preserved").alias("uuid")).join(turns.select("session_key", "uuid", "turn_id"), ["session_key", "uuid"])
    kept = named.groupBy("session_key", "boundary_turn").agg(F.collect_set("turn_id").alias("preserved"))  # what one compaction record lists
    none = F.array().cast("array<bigint>")
    return known.select("session_key", "boundary_turn").join(kept, ["session_key", "boundary_turn"], "left").withColumn("preserved", F.coalesce("preserved", none))
