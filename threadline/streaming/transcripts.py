"""Transcript operators on streams; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadline.functions.values import variant
from threadline.operators import decide, recommend, records, sessions

RECORDS = "session_key string, line_no long, stream_offset long, byte_len long, line string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MOST_SUPPRESSED = 100


class TailIngest(StatefulProcessor):
    """Turns byte chunks (``session_key, offset, data``) of growing files into records.

    State of a session: the unfinished last line, the next offset and the next
    line number, and chunks that came too early.  A chunk that was seen already,
    or the part of it that was, is skipped, so a repeated delivery changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "carry binary, next_offset long, next_line long")
        self.early = handle.getMapState("early", "offset long", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        carry, at, line_no = self.state.get() if self.state.exists() else (b"", 0, 0)
        carry = bytes(carry)
        waiting = {int(k[0]): bytes(v[0]) for k, v in self.early.iterator()} if self.early.exists() else {}
        for part in rows:
            for offset, data in zip(part["offset"], part["data"]):
                offset, data = int(offset), bytes(data)
                if len(data) > len(waiting.get(offset, b"")):
                    waiting[offset] = data
        held = dict(waiting)
        out = []
        while True:
            ready = [o for o in waiting if o <= at]
            if not ready:
                break
            for o in sorted(ready):
                fresh = waiting.pop(o)[at - o :]
                carry, at = carry + fresh, at + len(fresh)
        *lines, carry = carry.split(b"\n")
        start = at - len(carry) - sum(len(x) + 1 for x in lines)
        for raw in lines:
            if raw.strip():
                out.append((key[0], line_no, start, len(raw), raw.decode(errors="replace")))
            line_no += 1
            start += len(raw) + 1
        self.state.update((carry, at, line_no))
        for o in held:
            if o not in waiting and self.early.containsKey((o,)):
                self.early.removeKey((o,))
        for o, data in waiting.items():
            self.early.updateValue((o,), (data,))
        yield pd.DataFrame(out, columns=["session_key", "line_no", "stream_offset", "byte_len", "line"])

    def close(self) -> None:
        pass


def tail_ingest(chunks: DataFrame) -> DataFrame:
    """Records of a stream of chunks, in append mode; needs the RocksDB state store."""
    return chunks.groupBy("session_key").transformWithStateInPandas(TailIngest(), RECORDS, "Append", "None")


class SessionClose(StatefulProcessor):
    """Closes a session once its event-time timer passes ``idle_ms`` after its last turn; late turns do not reopen it."""

    def __init__(self, idle_ms: int = 6 * 3600 * 1000):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "last_ms long, turns long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, turns, closed = self.state.get() if self.state.exists() else (0, 0, False)
        for part in rows:
            turns += len(part)
            if len(part):
                last = max(last, int(part["at"].max().timestamp() * 1000))
        if not closed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.idle_ms)
        self.state.update((last, turns, closed))
        yield pd.DataFrame([], columns=["session_key", "turns"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, turns, closed = self.state.get()
        if closed:
            yield pd.DataFrame([], columns=["session_key", "turns"])
        else:
            self.state.update((last, turns, True))
            yield pd.DataFrame([(key[0], turns)], columns=["session_key", "turns"])

    def close(self) -> None:
        pass


def close_sessions(turns: DataFrame, lateness: str = "1 hour", idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """``session_key, turns`` of sessions as they close; ``turns`` has ``session_key`` and the timestamp ``at``."""
    marked = turns.withWatermark("at", lateness)
    return marked.groupBy("session_key").transformWithStateInPandas(SessionClose(idle_ms), "session_key string, turns long", "Append", "EventTime")


class Suppression(StatefulProcessor):
    """What each session was given: a turn is given once, and the last hundred refusals are kept.

    Input: ``session_key, prompt_no, turn_id``; output adds ``reason`` (null if given).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "turn_id long", "prompt_no long")
        self.refused = handle.getListState("refused", "turn_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        refused = [r[0] for r in self.refused.get()] if self.refused.exists() else []
        frames = [p for p in rows if len(p)]
        out = []
        for prompt, turn in sorted((int(p), int(t)) for f in frames for p, t in zip(f["prompt_no"], f["turn_id"])):
            if self.given.containsKey((turn,)):
                refused.append(turn)
                out.append((key[0], prompt, turn, "already given"))
            else:
                self.given.updateValue((turn,), (prompt,))
                out.append((key[0], prompt, turn, None))
        if refused:
            self.refused.put([(t,) for t in refused[-MOST_SUPPRESSED:]])
        yield pd.DataFrame(out, columns=["session_key", "prompt_no", "turn_id", "reason"])

    def close(self) -> None:
        pass


def suppress(offers: DataFrame) -> DataFrame:
    """Offers of turns to prompts, each judged by what its session was given before."""
    return offers.groupBy("session_key").transformWithStateInPandas(Suppression(), "session_key string, prompt_no long, turn_id long, reason string", "Append", "None")


class TurnOrdinals(StatefulProcessor):
    """Numbers the turns among a session's records; state is the next number and the last offset seen.

    Records come in the order of their offsets over batches, as :func:`tail_ingest`
    gives them, and in any order within one; one that was seen is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("turns", "next_seq long, last_offset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        seq, last = self.state.get() if self.state.exists() else (0, -1)
        frames = [p for p in rows if len(p)]
        if frames:
            new = pd.concat(frames).drop_duplicates("stream_offset").sort_values("stream_offset")
            new = new[new["stream_offset"] > last].copy()
            if len(new):
                turn = new.pop("is_turn").astype(bool)
                new["turn_seq"] = (seq + turn.cumsum() - 1).where(turn).astype("Int64")
                self.state.update((seq + int(turn.sum()), int(new["stream_offset"].iloc[-1])))
                yield new[["session_key", "line_no", "stream_offset", "byte_len", "line", "turn_seq"]]
                return
        yield pd.DataFrame([], columns=["session_key", "line_no", "stream_offset", "byte_len", "line", "turn_seq"])

    def close(self) -> None:
        pass


def number_turns(stream: DataFrame) -> DataFrame:
    """Records of a stream with ``turn_seq``, null for records that are no turn."""
    marked = stream.withColumn("v", variant("line")).withColumn("is_turn", F.coalesce(records.is_turn("v"), F.lit(False))).drop("v")
    return marked.groupBy("session_key").transformWithStateInPandas(TurnOrdinals(), RECORDS + ", turn_seq long", "Append", "None")


class Decisions(StatefulProcessor):
    """The decisions of :func:`threadline.operators.decide.decide` as prompts arrive.

    State of a session: turns given, turns its digest quoted, and the compactions
    that a prompt has accounted for; with a lifetime the first two are forgotten.
    A prompt's offers come in one micro-batch, prompts in order of arrival.
    """

    def __init__(self, window: int, wide: int, most: int, lifetime_ms: int | None = None):
        self.limits, self.lifetime = (window, wide, most), lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "turn_id long", "query_id long", self.lifetime)
        self.briefed = handle.getMapState("briefed", "turn_id long", "rank int", self.lifetime)
        self.seen = handle.getValueState("seen", "compactions long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        ids = lambda state: {int(k[0]) for k in state.keys()} if state.exists() else set()
        state = decide.SessionState(ids(self.given), ids(self.briefed), int(self.seen.get()[0]) if self.seen.exists() else 0)
        frames = [p for p in rows if len(p)]
        out: list[tuple] = []
        if frames:
            new = pd.concat(frames).sort_values(["arrival", "query_id", "rank", "turn_id"], na_position="first")
            for turn in new.loc[new["rank"] == -1, "turn_id"]:
                state.briefed.add(int(turn))
                self.briefed.updateValue((int(turn),), (-1,))
            for (_, query), part in new[new["rank"] >= 0].groupby(["arrival", "query_id"], sort=True):
                hits = [(int(t), int(r), bool(o), bool(f)) for t, r, o, f in zip(part["turn_id"].fillna(0), part["rank"], part["own"], part["fell_out"]) if r > 0]
                made, owed = decide.judge(state, int(part["compactions"].max()), hits, *self.limits)
                for turn, place, reason in made:
                    out.append((key[0], int(query), turn, place, reason, owed))
                    if place:
                        self.given.updateValue((turn,), (int(query),))
            self.seen.update((state.seen,))
        made = pd.DataFrame(out, columns=["session_id", "query_id", "turn_id", "place", "reason", "compacted"])
        made["place"] = made["place"].astype("Int32")
        yield made

    def close(self) -> None:
        pass


def decide_stream(offered: DataFrame, lifetime_ms: int | None = None) -> DataFrame:
    """Decisions on a stream of offers, with rows of rank -1 for what a digest quoted (see :func:`threadline.operators.decide.decide`)."""
    limits = [recommend.THRESHOLDS[n] for n in ("window", "compacted_window", "max_turns")]
    mode = "ProcessingTime" if lifetime_ms else "None"
    return offered.groupBy("session_id").transformWithStateInPandas(Decisions(*limits, lifetime_ms), decide.DECISIONS, "Append", mode)


class KeyedTable:
    """Rows by key that batches replace, in buckets of the key; every ``every``-th batch is a compaction.

    A batch's rows go to a folder of its generation and number, so writing it
    again overwrites it.  A compaction writes the newest row of every key to the
    first folder of a new generation, so a reader opens one generation: a whole
    table and at most ``every`` batches since.  ``order`` names what decides
    between two rows of a key, else the later batch does.
    """

    def __init__(self, path: str, schema: str, keys: list[str], order: list[str] | None = None, buckets: int = 16, every: int = 10):
        self.path, self.schema, self.keys, self.order, self.buckets, self.every = path, schema, keys, order or ["batch"], buckets, every

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of one batch; batches count from 0 without a gap."""
        generation = batch // self.every * self.every
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        if generation == batch and batch:
            rows = self._newest(self._rows(rows.sparkSession, generation - self.every, batch).unionByName(rows))
        kept = self._newest(rows).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        kept.withColumnRenamed("batch", "written").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/generation={generation}/batch={batch}")

    def current(self, spark, batch: int) -> DataFrame:
        """The table after a batch."""
        return self._newest(self._rows(spark, batch // self.every * self.every, batch + 1)).drop("batch")

    def _rows(self, spark, generation: int, before: int) -> DataFrame:
        folders = [f"{self.path}/generation={generation}/batch={b}" for b in range(generation, before)]
        found = spark.read.schema(f"{self.schema}, written long, bucket int").option("basePath", f"{self.path}/generation={generation}").parquet(*folders)
        return found.drop("bucket", "batch").withColumnRenamed("written", "batch")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        first = [*self.order, *[c for c in rest if c not in self.order]]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*first)).alias("r"))
        return best.select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def derived_tables(path: str, every: int = 10) -> dict[str, KeyedTable]:
    """The tables that :func:`derive_batch` keeps: turns, entities, boundaries and titles."""
    turns = "session_key string, turn_seq long, uuid string, parent_uuid string, record_type string, tool_name string, ts string, is_typed boolean, stream_offset long"
    return {
        "turns": KeyedTable(f"{path}/turns", turns, ["session_key", "turn_seq"], every=every),
        "entities": KeyedTable(f"{path}/entities", "session_key string, turn_seq long, kind string, value string", ["session_key", "turn_seq", "kind", "value"], every=every),
        "boundaries": KeyedTable(f"{path}/boundaries", "session_key string, stream_offset long, metadata string, preserved array<string>", ["session_key", "stream_offset"], every=every),
        "titles": KeyedTable(f"{path}/titles", "session_key string, title string, is_custom boolean, stream_offset long", ["session_key"], ["is_custom", "stream_offset"], every=every),
    }


def derive_batch(path: str, every: int = 10) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer over :func:`number_turns` that keeps the four derived tables."""
    tables = derived_tables(path, every)

    def write(batch: DataFrame, number: int) -> None:
        turns = records.turn_fields(batch.where("turn_seq is not null"), "turn_seq")
        made = {"turns": turns, "entities": records.extract_entities(turns), "boundaries": records.boundaries(batch), "titles": records.titles_at(batch)}
        for name, table in tables.items():
            columns = [c.split()[0] for c in table.schema.split(", ")]
            table.write(made[name].select(*columns), number)

    return write


def upsert(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: a batch's rows replace stored rows of the same keys.

    Every batch goes to a folder of its own number, so writing it again after a
    failure overwrites it; :func:`current` keeps the newest row of a key.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    return write


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key among those :func:`upsert` wrote."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "batch"])


def label_on_close(path: str, decisions: DataFrame, turns: DataFrame, entities: DataFrame, injected: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer over sessions as they close (``session_id``): labels each of their decisions once.

    Turns given are hits or false positives (below ``path``); a decision (with
    ``spellings``) may be a miss, and a wasted budget (below ``path``-decisions,
    where a row without a label says that a decision is settled).  Every batch
    goes to a folder of its own number; decisions that folders of earlier batches
    hold are left out, so a repeated batch, or a second file of the same session
    that closes later, changes nothing.
    """
    settled_path = f"{path}-decisions"
    schema = "decision_id long, label string, detail string"

    def write(closed: DataFrame, batch: int) -> None:
        due = decisions.join(closed.select("session_id").distinct(), "session_id", "left_semi").where("ts is not null")
        if batch:
            known = closed.sparkSession.read.schema(schema + ", batch long").option("basePath", settled_path).parquet(settled_path)
            due = due.join(known.where(F.col("batch") < batch).select("decision_id").distinct(), "decision_id", "left_anti")
        given = injected.join(due.select("decision_id"), "decision_id", "left_semi")
        made = recommend.label_turns(given, due.select("decision_id", "session_id", "ts"), turns, entities).select("decision_id", "turn_id", "label")
        made.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")
        none = F.lit(None).cast("string")
        own = recommend.label_waste(made).withColumn("detail", none)
        if "spellings" in decisions.columns:
            own = own.unionByName(recommend.label_miss(due, given, turns, entities))
        settled = due.select("decision_id").distinct().withColumn("label", none).withColumn("detail", none)
        own.select("decision_id", "label", "detail").unionByName(settled).write.mode("overwrite").parquet(f"{settled_path}/batch={batch:09d}")

    return write


def summary_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch changes in the summaries: session rows that it touched, as they were taken back and as they are added.

    A session whose folder becomes known moves from the null project to its own;
    only touched sessions are read, however many a project has.
    """
    part = lambda df, sign: df.select("project", "pre_worktree", F.lit(sign).cast("long").alias("sessions"), (sign * F.coalesce("turn_count", F.lit(0))).cast("long").alias("turns"))
    return part(before, -1).unionByName(part(after, 1)).groupBy("project", "pre_worktree").agg(F.sum("sessions").alias("sessions"), F.sum("turns").alias("turns"))


def apply_deltas(summaries: DataFrame, deltas: DataFrame) -> DataFrame:
    """Project summaries after a batch; a project left without a session goes."""
    both = summaries.select("project", "pre_worktree", "sessions", "turns").unionByName(deltas)
    return both.groupBy("project", "pre_worktree").agg(F.sum("sessions").alias("sessions"), F.sum("turns").alias("turns")).where("sessions > 0")


def running_summaries(meta: DataFrame, touched: DataFrame, stored: DataFrame) -> DataFrame:
    """Project summaries after a batch: those of touched projects are counted anew, the others are kept."""
    again = sessions.project_summary(meta.join(touched.select("project").distinct(), "project", "left_semi"))
    return again.unionByName(stored.join(touched.select("project").distinct(), "project", "left_anti"))


def pass_metrics(progress) -> dict[str, float]:
    """Counters of one micro-batch from Spark's progress report."""
    return {"batch": progress.batchId, "input_rows": progress.numInputRows, "rows_per_second": progress.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in progress.stateOperators)}
