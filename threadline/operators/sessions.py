"""Session and project summaries, observations, closing, lineage, listings, reports, retention, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.values import clip_bytes
from threadline.operators.records import WRITING_TOOLS, commands, commit_subjects
from threadline.sources.tables import stored

# Limits of summaries and lists.
NEWEST_PROMPTS, MOST_LISTED, LISTED_BYTES, PROMPT_BYTES, PER_ACTION = 12, 64, 512, 256 * 1024, 100
IDLE, ELISION = "6 hours", " [...]"


def project_summary(meta: DataFrame) -> DataFrame:
    """Sessions and turns per project and worktree; a null key is a group of its own."""
    return meta.groupBy("project", "pre_worktree").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("turn_count", F.lit(0))).cast("long").alias("turns"))


def newest_prompts(turns: DataFrame, n: int = NEWEST_PROMPTS) -> DataFrame:
    """The newest typed prompts of each session: ``session_key, turn_seq, newest``."""
    w = Window.partitionBy("session_key").orderBy(F.desc("turn_seq"))
    return turns.where("is_typed").withColumn("newest", F.row_number().over(w)).where(F.col("newest") <= n)


def within_budget(rows: DataFrame, key: str, order: Column, size: str, budget: int = PROMPT_BYTES) -> DataFrame:
    """The first rows of each group while their running size stays in the budget; the first row always."""
    w = Window.partitionBy(key).orderBy(order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).withColumn("__r", F.row_number().over(w)).where((F.col("running") <= budget) | (F.col("__r") == 1)).drop("__r")


def session_summary(meta: DataFrame, turns: DataFrame, entities: DataFrame) -> DataFrame:
    """Main sessions: whether a person typed, turns, newest prompts and reply, edited files newest first."""
    counted = turns.groupBy("session_key").agg(
        F.coalesce(F.max("is_typed"), F.lit(False)).alias("has_typed"), F.count(F.lit(1)).alias("turn_count"),
        F.max(F.when(F.col("record_type") == "assistant", F.col("turn_seq"))).alias("newest_reply"),
    )
    prompts = newest_prompts(turns).groupBy("session_key").agg(F.sort_array(F.collect_list("turn_seq"), asc=False).alias("newest_prompts"))
    edits = turns.where(F.col("tool_name").isin(*WRITING_TOOLS)).select("session_key", "turn_seq")
    files = (
        entities.where("kind = 'path'").join(edits, ["session_key", "turn_seq"]).groupBy("session_key", "value").agg(F.max("turn_seq").alias("at"))
        .groupBy("session_key").agg(F.sort_array(F.collect_list(F.struct("at", "value")), asc=False).alias("f"))
        .select("session_key", F.transform("f", lambda x: x["value"]).alias("edited_files"))
    )
    main = meta.where("not is_sidechain").select("session_key", "session_id", "project", "pre_worktree", "last_turn_at")
    return main.join(counted, "session_key", "left").join(prompts, "session_key", "left").join(files, "session_key", "left")


def duration_seconds(start: str, end: str) -> Column:
    """Whole seconds between two ISO texts, truncated toward zero; time may run backwards."""
    millis = lambda c: F.unix_millis(F.try_to_timestamp(F.col(c)))
    return ((millis(end) - millis(start)) / 1000).cast("long")


def _listed(value: Column) -> Column:
    """A value of a list, cut to its limit of bytes; a cut one says so."""
    return F.when(F.octet_length(value) > LISTED_BYTES, F.concat(clip_bytes(value, LISTED_BYTES), F.lit(ELISION))).otherwise(value)


def session_observation(meta: DataFrame, turns: DataFrame, entities: DataFrame, compactions: DataFrame) -> DataFrame:
    """Facts of each session: files read and modified, tools, errors, commands, commits, turns, duration, compactions.

    Lists are distinct and hold at most 64 values, command lines and subjects of
    commits in their order, the others sorted; ``cut`` names those that were longer.
    """
    tool = turns.select("session_key", "turn_seq", "tool_name")
    path = entities.where("kind = 'path'").join(tool, ["session_key", "turn_seq"])
    modifies = F.coalesce(F.col("tool_name").isin(*WRITING_TOOLS), F.lit(False))  # all other turns, those without a tool too, read
    rows = path.select("session_key", F.when(modifies, "modified").otherwise("read").alias("list"), _listed(F.col("value")).alias("value"))
    rows = rows.unionByName(entities.where("kind in ('tool', 'error')").select("session_key", F.concat("kind", F.lit("s")).alias("list"), _listed(F.col("value")).alias("value"))).distinct()
    ran = commands(turns)
    place = F.struct("turn_seq", "pos")
    said = ran.select("session_key", F.lit("commands").alias("list"), _listed(F.col("command")).alias("value"), place.alias("at"))
    said = said.unionByName(commit_subjects(ran).select("session_key", F.lit("commits").alias("list"), _listed(F.col("subject")).alias("value"), place.alias("at")))
    said = said.groupBy("session_key", "list", "value").agg(F.min("at").alias("at"))
    rows = rows.withColumn("at", F.lit(None).cast("struct<turn_seq: bigint, pos: int>")).unionByName(said)
    names = ["read", "modified", "tools", "errors", "commands", "commits"]
    rank = F.row_number().over(Window.partitionBy("session_key", "list").orderBy("at", "value"))
    listed = rows.withColumn("r", rank)
    kept = lambda n: F.collect_list(F.when((F.col("list") == n) & (F.col("r") <= MOST_LISTED), F.struct("r", "value")))
    lists = listed.groupBy("session_key").agg(
        *[F.transform(F.array_sort(kept(n)), lambda x: x["value"]).alias(n) for n in names],
        F.array_sort(F.collect_set(F.when(F.col("r") > MOST_LISTED, F.col("list")))).alias("cut"),
    )
    compacted = compactions.groupBy("session_key").agg(F.count(F.lit(1)).alias("compactions"))
    base = meta.select("session_key", "session_id", "project", "turn_count", duration_seconds("first_turn_at", "last_turn_at").alias("duration_s"))
    empty = F.array().cast("array<string>")
    return (
        base.join(lists, "session_key", "left").join(compacted, "session_key", "left").fillna({"compactions": 0})
        .select("session_key", "session_id", "project", "turn_count", "duration_s", "compactions", *[F.coalesce(n, empty).alias(n) for n in [*names, "cut"]])
    )


def finalize_sessions(meta: DataFrame, now: str, idle: str = IDLE) -> DataFrame:
    """Add ``closed``: no turn for ``idle`` before ``now``; what was closed stays closed, a session without turns is left alone."""
    limit = F.date_format(F.to_timestamp(F.lit(now)) - F.expr(f"interval {idle}"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    was = F.col("closed") if "closed" in meta.columns else F.lit(False)
    return meta.withColumn("closed", was | F.coalesce(F.col("last_turn_at") < limit, F.lit(False)))


def observe_new(meta: DataFrame, observations: DataFrame, limit: int = PER_ACTION) -> DataFrame:
    """Closed sessions without an observation, oldest first, at most ``limit``; ``over`` counts the rest."""
    due = meta.where("closed").join(observations.select("session_key"), "session_key", "left_anti")
    # the oldest are found by a distributed top-k, not by one global window
    first = due.orderBy(F.col("last_turn_at").asc_nulls_last(), "session_key").limit(limit)
    total = due.agg(F.count(F.lit(1)).alias("due"))
    return first.crossJoin(F.broadcast(total)).withColumn("over", F.greatest(F.col("due") - limit, F.lit(0))).drop("due")


def sessions_between(meta: DataFrame, since: str, until: str) -> DataFrame:
    """Sessions that overlap a span; one without times is in none."""
    return meta.where((F.col("last_turn_at") >= since) & (F.col("first_turn_at") <= until))


def list_sessions(meta: DataFrame, sessions: DataFrame, titles: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with number and title, in number order."""
    rows = sessions.join(meta, "session_key", "left").join(titles, "session_key", "left").orderBy("session_no")
    return rows if limit is None else rows.limit(limit)


def list_observations(observations: DataFrame, project: str | None = None) -> DataFrame:
    return observations if project is None else observations.where(F.col("project") == project)


def usage_report(meta: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sessions and bytes by project and by month of the first turn, in one pass over grouping sets."""
    rows = meta.join(sizes, "session_key").withColumn("month", F.substring("first_turn_at", 1, 7))
    return (
        rows.groupingSets([["project"], ["month"]], "project", "month")
        .agg(F.grouping("project").alias("g"), F.count(F.lit(1)).alias("sessions"), F.sum("bytes").alias("bytes"))
        .select(F.when(F.col("g") == 0, "project").otherwise("month").alias("report"), F.when(F.col("g") == 0, F.col("project")).otherwise(F.col("month")).alias("label"), "sessions", "bytes")
    )


def store_counts(meta: DataFrame, turns: DataFrame, watermarks: DataFrame) -> DataFrame:
    """One row: sessions, turns, watermarks and their bytes."""
    return (
        meta.agg(F.count(F.lit(1)).alias("sessions")).crossJoin(turns.agg(F.count(F.lit(1)).alias("turns")))
        .crossJoin(watermarks.agg(F.count(F.lit(1)).alias("watermarks"), F.coalesce(F.sum("byte_offset"), F.lit(0)).alias("watermark_bytes")))
    )  # three single rows


def pending_bytes(sources: DataFrame, watermarks: DataFrame) -> DataFrame:
    """One row: sources with bytes beyond their watermark, and these bytes."""
    left = F.greatest(F.col("length") - F.coalesce("byte_offset", F.lit(0)), F.lit(0))
    rows = sources.join(watermarks, "session_key", "left").withColumn("pending", left)
    return rows.agg(F.count(F.when(F.col("pending") > 0, 1)).alias("sources"), F.coalesce(F.sum("pending"), F.lit(0)).cast("long").alias("bytes"))


def last_run(runs: DataFrame) -> DataFrame:
    """The run with the highest id."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "run_id").alias("r")).where("r is not null").select("r.*")


def repair_watermarks(watermarks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Watermarks of known sessions, lowered to what is stored (``stored`` bytes)."""
    return watermarks.join(sessions.select("session_key", "stored"), "session_key").select("session_key", F.least("byte_offset", "stored").alias("byte_offset"))


def diverged(sources: DataFrame, archive: DataFrame) -> DataFrame:
    """Sources that are shorter than, or differ in, what the archive holds of them."""
    a = archive.select("session_key", F.col("length").alias("stored"), F.col("prefix_hash").alias("stored_hash"))
    both = sources.join(a, "session_key")
    return both.withColumn("reason", F.when(F.col("length") < F.col("stored"), "shorter").when(F.col("prefix_hash") != F.col("stored_hash"), "changed")).where("reason is not null")


def continuation_edges(meta: DataFrame, turns: DataFrame) -> DataFrame:
    """``session_key, parent_key, how``: the session each one continues.

    A foreign session id names it; else the session that holds the parent of the
    first turn.  A session never continues itself, the smallest key wins a tie.
    """
    named = meta.where("continues_id is not null").join(meta.select(F.col("session_id").alias("continues_id"), F.col("session_key").alias("parent_key")), "continues_id").where("session_key <> parent_key")
    named = named.groupBy("session_key").agg(F.min("parent_key").alias("parent_key")).withColumn("how", F.lit("session id"))
    first = turns.where("turn_seq = 0 and parent_uuid is not null").select("session_key", F.col("parent_uuid").alias("uuid"))
    holders = turns.select("uuid", F.col("session_key").alias("parent_key"))
    linked = first.join(named.select("session_key"), "session_key", "left_anti").join(holders, "uuid").where("session_key <> parent_key")
    return named.unionByName(linked.groupBy("session_key").agg(F.min("parent_key").alias("parent_key")).withColumn("how", F.lit("parent turn")))


def sidecar_parents(sessions: DataFrame) -> DataFrame:
    """Side transcripts and the transcript whose folder holds them."""
    key = F.concat(F.regexp_extract("session_key", r"^([^/]+)/.*agent-[^/]*\.jsonl$", 1), F.lit(".jsonl"))
    sides = sessions.select("session_key", key.alias("parent")).where("parent <> '.jsonl'")
    return sides.join(sessions.select(F.col("session_key").alias("parent"), F.lit(True).alias("known")), "parent", "left").select("session_key", F.when(F.col("known"), F.col("parent")).alias("parent_key"))


def thread_roots(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``session_key, root, depth`` by pointer doubling over the continuation forest.

    ``edges`` holds at most one parent a session; a cycle raises.  Every round
    halves what remains, and its table is stored in the shared folder.
    """
    up = edges.select("session_key", F.col("parent_key").alias("root"), F.lit(1).cast("long").alias("depth"))
    for _ in range(rounds):
        hop = up.select(F.col("session_key").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        after = up.join(hop, "root", "left").select("session_key", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        after = stored(after, "threads")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        up = after.drop("moved")
    raise ValueError("the continuations form a cycle")


def retention_select(meta: DataFrame, rules: DataFrame, sources: DataFrame, now: str, per_action: int = PER_ACTION) -> DataFrame:
    """Sessions to evict or delete: ``session_key, action, rank, over``.

    The deepest rule (``prefix, evict_days, delete_days``) above a closed
    session's project applies; 0 or null days never act.  Delete needs the source
    gone; evict needs it not evicted yet.  Oldest first, ``per_action`` each.
    """
    parts = F.split("project", "/")
    up = meta.select("session_key", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    rule = up.join(rules, "prefix").groupBy("session_key").agg(F.max_by(F.struct("evict_days", "delete_days"), F.length("prefix")).alias("rule"))
    gone = meta.select("session_key").join(sources.select("session_key"), "session_key", "left_anti").withColumn("gone", F.lit(True))
    cutoff = lambda days: F.date_format(F.to_timestamp(F.lit(now)) - F.make_interval(days=days), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    due = lambda days: (days > 0) & (F.col("last_turn_at") < cutoff(days))
    rows = meta.where("closed").join(rule, "session_key").join(gone, "session_key", "left")
    action = F.when(due(F.col("rule.delete_days")) & F.col("gone"), "delete").when(due(F.col("rule.evict_days")) & ~F.col("evicted"), "evict")
    chosen = rows.withColumn("action", action).where("action is not null")
    rank = F.row_number().over(Window.partitionBy("action").orderBy("last_turn_at", "session_key"))
    total = chosen.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    ranked = chosen.select("session_key", "action", rank.alias("rank")).where(F.col("rank") <= per_action)
    return ranked.join(total, "action").select("session_key", "action", "rank", F.greatest(F.col("n") - per_action, F.lit(0)).alias("over"))


def retention_apply(tables: dict[str, DataFrame], selection: DataFrame, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """Drop the text of evicted sessions (``records``) and every row of deleted ones; other tables keep evicted sessions' rows.

    ``decisions`` belong to session ids, not files: with ``meta`` (``session_key,
    session_id, is_sidechain``) one goes only if a deleted session has its id and
    no main session with that id remains.
    """
    deleted = selection.where("action = 'delete'").select("session_key")
    touched = selection.select("session_key")
    out = {name: df.join(touched if name == "records" else deleted, "session_key", "left_anti") for name, df in tables.items() if name != "decisions"}
    if "decisions" in tables:
        gone = meta.join(deleted, "session_key", "left_semi").select("session_id")
        left = meta.where("not is_sidechain").join(deleted, "session_key", "left_anti").select("session_id")
        out["decisions"] = tables["decisions"].join(gone.join(left, "session_id", "left_anti").distinct(), "session_id", "left_anti")
    return out


def rebuild(records: DataFrame, derive, evicted: DataFrame) -> DataFrame:
    """Derived rows from the records, and the kept rows of sessions whose records are gone."""
    fresh = derive(records)
    return fresh.unionByName(evicted.join(records.select("session_key").distinct(), "session_key", "left_anti"))


def verify(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored chunks against a manifest, both ``session_key, chunk_no, sha256``: rows that are missing, unexpected or changed."""
    m = manifest.select("session_key", "chunk_no", F.col("sha256").alias("expected"))
    both = chunks.select("session_key", "chunk_no", "sha256").join(m, ["session_key", "chunk_no"], "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("sha256") != F.col("expected"), "changed")
    return both.withColumn("problem", problem).where("problem is not null").select("session_key", "chunk_no", "problem")


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """Holes in the numbering of each session's chunks: ``session_key, after, before``."""
    w = Window.partitionBy("session_key").orderBy("chunk_no")
    last = F.coalesce(F.lag("chunk_no").over(w), F.lit(0))
    return chunks.select("session_key", "chunk_no").distinct().withColumn("after", last).where("chunk_no > after + 1").select("session_key", "after", F.col("chunk_no").alias("before"))


def session_checksums(chunks: DataFrame, fan: int = 1024, levels: int = 6) -> DataFrame:
    """``session_key, checksum``: a digest of each session's chunk digests (``session_key, chunk_no, sha256``) in order.

    A tree: the digests of ``fan`` chunks make one digest, those of ``fan`` such
    digests the next, so no task holds more than ``fan`` digests of a session,
    whatever its length.  ``fan ** levels`` chunks is the most.  Chunks count
    from 1; equal digests at other places give another checksum.  Two levels share
    one shuffle, by runs of ``fan * fan`` chunks.
    """
    rows = chunks.select("session_key", (F.col("chunk_no") - 1).cast("long").alias("n"), F.col("sha256").alias("d"))
    for level in range(levels):
        if level % 2 == 0:
            rows = rows.withColumn("run", F.floor(F.col("n") / (fan * fan)).cast("long")).repartition("session_key", "run")
        rows = rows.groupBy("session_key", "run", F.floor(F.col("n") / fan).cast("long").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("at"), "d"))).alias("l"))
        rows = rows.select("session_key", "run", "n", F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["at"].cast("string"), x["d"])), ",").cast("binary"), 256).alias("d"))
    return rows.select("session_key", F.col("d").alias("checksum"))


def verify_sessions(chunks: DataFrame, recorded: DataFrame, fan: int = 1024, levels: int = 6) -> DataFrame:
    """What is wrong with whole sessions: ``session_key, problem, first, last``.

    ``recorded``: ``session_key, checksum, chunk_count, evicted, diverged``.
    Missing chunks are one row for each run of them (``first`` to ``last``), those
    beyond the count are unexpected; a checksum is taken over the rows as they
    are.  An evicted session must have no rows and is not checked further; one
    whose file is shorter than its archive diverged, evicted or not.
    """
    seen = chunks.select("session_key", F.col("chunk_no").cast("long")).join(recorded.select("session_key", F.col("chunk_count").cast("long").alias("count"), "evicted"), "session_key")
    live = recorded.where("not evicted").select("session_key", F.col("chunk_count").cast("long").alias("count"))
    row = lambda df, problem, first="null", last="null": df.select("session_key", F.lit(problem).alias("problem"), F.expr(f"cast({first} as long)").alias("first"), F.expr(f"cast({last} as long)").alias("last"))
    left = seen.where("evicted").groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))
    extra = seen.where("not evicted and (chunk_no > count or chunk_no < 1)")
    # holes: a mark before the first and after the last chunk, and what lies between neighbours
    inside = seen.where("not evicted and chunk_no between 1 and count").select("session_key", "chunk_no").distinct()
    marked = inside.unionByName(live.select("session_key", F.lit(0).cast("long").alias("chunk_no"))).unionByName(live.select("session_key", (F.col("count") + 1).alias("chunk_no")))
    before = F.lag("chunk_no").over(Window.partitionBy("session_key").orderBy("chunk_no"))
    holes = marked.withColumn("before", before).where("chunk_no > before + 1")
    found = session_checksums(chunks, fan, levels)
    wrong = recorded.where("not evicted").join(found, "session_key", "left").select("session_key", recorded["checksum"].alias("expected"), found["checksum"].alias("actual")).where("not (expected <=> actual)")
    parts = [row(left, "rows of an evicted session", "n"), row(extra, "unexpected", "chunk_no", "chunk_no"), row(holes, "missing", "before + 1", "chunk_no - 1"), row(wrong, "checksum"), row(recorded.where("diverged"), "diverged")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prefix_checksums(chunks: DataFrame, watermarks: DataFrame, size: int, fan: int = 1024, levels: int = 6) -> DataFrame:
    """``session_key, checksum`` of the first ``byte_offset`` bytes (``watermarks``) of sources stored as chunks of ``size`` bytes (``session_key, chunk_no, data``).

    Whole chunks enter by their digest, the one that the watermark cuts by the digest of its part, so a source's
    prefix and its archive compare without either being read as one value.
    """
    own = chunks.join(watermarks.select("session_key", "byte_offset"), "session_key").withColumn("__left", F.col("byte_offset") - (F.col("chunk_no") - 1) * size).where("__left > 0")
    part = F.expr("substring(data, 1, cast(least(__left, length(data)) as int))")
    return session_checksums(own.select("session_key", "chunk_no", F.sha2(part, 256).alias("sha256")), fan, levels)


def diverged_prefixes(sources: DataFrame, archive: DataFrame, watermarks: DataFrame, size: int) -> DataFrame:
    """Sessions whose source no longer begins with what was archived up to the watermark: ``session_key``."""
    now = prefix_checksums(sources, watermarks, size)
    then = prefix_checksums(archive, watermarks, size).withColumnRenamed("checksum", "then")
    return then.join(now, "session_key", "left").where("not (checksum <=> then)").select("session_key")


def dropped_turns(compactions: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns before each session's latest boundary that it does not preserve; none if it preserves nothing."""
    last = compactions.groupBy("session_key").agg(F.max_by(F.struct("stream_offset", "preserved"), "stream_offset").alias("b")).where(F.size("b.preserved") > 0)
    kept = last.select("session_key", F.explode("b.preserved").alias("uuid")).where("uuid is not null")
    before = turns.join(last, "session_key").where(F.col("stream_offset") < F.col("b.stream_offset"))
    return before.join(kept, ["session_key", "uuid"], "left_anti").select("session_key", "turn_seq", "uuid")


def project_digest(summary: DataFrame, titles: DataFrame | None = None, prompts: int = 3, files: int = 8, others: int = 5) -> DataFrame:
    """Where work stopped in each project: its newest typed session's prompts, reply and files, and other sessions."""
    w = Window.partitionBy("project").orderBy(F.col("last_turn_at").desc_nulls_last(), "session_key")
    typed = summary.where("has_typed and project is not null").withColumn("r", F.row_number().over(w))
    lists = typed.where((F.col("r") > 1) & (F.col("r") <= others + 1)).groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "session_key"))), lambda x: x["session_key"]).alias("other_sessions"))
    count = typed.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"))
    newest = typed.where("r = 1").select(
        "project", "session_key", "last_turn_at", F.slice("newest_prompts", 1, prompts).alias("prompts"), "newest_reply",
        F.slice(F.coalesce("edited_files", F.array().cast("array<string>")), 1, files).alias("files"),
        F.greatest(F.size(F.coalesce("edited_files", F.array().cast("array<string>"))) - files, F.lit(0)).alias("more_files"),
    )
    return newest.join(count, "project").join(lists, "project", "left")
