"""Transcript records: from files, from tables, and synthesized from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.functions.values import iso

UUID_NAME = r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\.jsonl$"


def transcript_sources(files: DataFrame, root: str) -> DataFrame:
    """Which listed files are transcripts, and their session keys.

    ``files`` has the columns ``path`` and ``length``.  A transcript is a
    ``<uuid>.jsonl`` right below a project folder of ``root``, or an
    ``agent-*.jsonl`` at any depth.  The key is the path below the project folder.
    """
    below = F.regexp_replace(F.col("path"), "^(file:)?/*" + root.strip("/") + "/", "")
    project, rest = F.regexp_extract(below, "^([^/]+)/", 1), F.regexp_replace(below, "^[^/]+/", "")
    main = rest.rlike("^" + UUID_NAME)
    side = rest.rlike(r"(^|/)agent-[^/]*\.jsonl$")
    return (
        files.select(F.col("path"), F.col("length"), project.alias("folder"), rest.alias("session_key"), side.alias("is_sidechain"))
        .where((F.col("folder") != "") & (main | side))
    )


def exclude_projects(df: DataFrame, prefixes: DataFrame, path: str = "cwd") -> DataFrame:
    """Rows under none of the excluded folders (``prefix`` column), compared by whole components.

    A path is spelled out into its ancestors, so the exclusion is an equality join.
    """
    folders = prefixes.select(F.rtrim(F.col("prefix"), F.lit("/")).alias("prefix")).distinct()
    ancestors = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(F.split(path, "/")), F.lit(2))), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/")
    )
    hit = df.select(F.col(path).alias("__path"), F.explode(ancestors).alias("prefix")).distinct().join(folders, "prefix", "left_semi").select("__path").distinct()
    return df.join(hit, F.col(path) == F.col("__path"), "left_anti")


def folder_name(path: Column) -> Column:
    """A path as the name of its project folder."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def exclude_folders(df: DataFrame, prefixes: DataFrame, folder: str = "folder") -> DataFrame:
    """Rows whose encoded folder neither equals an excluded path's name nor extends it by ``-``."""
    names = prefixes.select(folder_name(F.rtrim(F.col("prefix"), F.lit("/"))).alias("name")).distinct()
    parts = F.split(folder, "-")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    hit = df.select(F.col(folder).alias("__folder"), F.explode(starts).alias("name")).distinct().join(names, "name", "left_semi").select("__folder").distinct()
    return df.join(hit, F.col(folder) == F.col("__folder"), "left_anti")


def lines_to_records(chunks: DataFrame) -> DataFrame:
    """Records of whole files: ``session_key, content`` to ``session_key, line_no, stream_offset, byte_len, line``.

    A partial last line is left out, blank lines make no record, and offsets
    count bytes of the file.
    """
    whole = F.substring_index(F.col("content").cast("string"), "\n", -1)
    complete = F.expr("substring(cast(content as string), 1, length(cast(content as string)) - length(rest))")
    split = (
        chunks.withColumn("rest", whole).withColumn("body", complete)
        .select("session_key", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))
    )
    before = Window.partitionBy("session_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line") + 1
    return (
        split.withColumn("stream_offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
        .withColumn("byte_len", F.octet_length("line").cast("long")).where(F.trim("line") != "")
        .select("session_key", F.col("line_no").cast("long"), "stream_offset", "byte_len", "line")
    )


def scan_transcripts(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Records of all transcript files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    named = transcript_sources(files.select("path", "length"), root).select("path", "session_key")
    return lines_to_records(files.join(named, "path").select("session_key", "content"))


def records_from_table(df: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Records that are already rows of a table."""
    w = Window.partitionBy(key).orderBy(order)
    size = F.octet_length(line) + 1
    return df.select(
        F.col(key).cast("string").alias("session_key"),
        (F.row_number().over(w) - 1).cast("long").alias("line_no"),
        F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("stream_offset"),
        F.octet_length(line).cast("long").alias("byte_len"),
        F.col(line).alias("line"),
    )


def attach_meta(sessions: DataFrame, meta_files: DataFrame) -> DataFrame:
    """Add ``meta``, the text of the ``.meta.json`` beside a side transcript; the first path wins."""
    meta = meta_files.select(F.regexp_replace("session_key", r"\.meta\.json$", ".jsonl").alias("session_key"), "path", F.col("content").cast("string").alias("meta"))
    first = meta.groupBy("session_key").agg(F.min_by("meta", "path").alias("meta"))
    return sessions.join(first, "session_key", "left")


def export_sessions(records: DataFrame, dest: str) -> DataFrame:
    """Write one folder of text per session below ``dest`` and return the manifest."""
    rows = records.select("session_key", "line_no", F.col("line").alias("value"))
    rows.repartition("session_key").sortWithinPartitions("session_key", "line_no").select("session_key", "value").write.partitionBy("session_key").text(f"{dest}/sessions")
    manifest = records.groupBy("session_key").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("byte_len") + 1).alias("bytes"))
    manifest.write.json(f"{dest}/manifest")
    return manifest


def events_as_records(events: DataFrame) -> DataFrame:
    """Transcript records made from an event table, one session a user, in event order.

    ``k`` is the number in ``props``.  A signup is a typed prompt, a view, click or
    purchase a tool call, an error a failed tool result; every tenth record of a
    session is a compaction boundary that preserves the two records before it.
    Times go back an hour where ``k`` is a multiple of 7.
    """
    w = Window.partitionBy("session_key").orderBy("event_id")  # by the key that turns are numbered in, so that lines move once
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumn("session_key", F.col("user_id").cast("string")).select(
        "session_key", "event_id", "user_id", "event_type", k.alias("k"), (F.row_number().over(w) - 1).cast("long").alias("line_no"),
        F.lag("event_id", 1).over(w).alias("prev"), F.lag("event_id", 2).over(w).alias("prev2"),
        (F.col("ts") - F.when(k % 7 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))).alias("at"),
    )
    cwd = F.concat(F.lit("/r"), (F.col("user_id") % 5).cast("string"))
    name = F.concat(F.lit("Name"), F.col("k").cast("string"), F.lit("Manager"))
    file = F.concat(F.lit("src/mod"), F.col("k").cast("string"), F.lit(".rs"))
    uid = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    boundary = F.col("line_no") % 10 == 9
    kind = F.col("event_type")
    use = lambda tool, **given: F.struct(F.lit("tool_use").alias("type"), F.lit(tool).alias("name"), F.struct(*[v.alias(n) for n, v in given.items()]).alias("input"))
    search = (F.col("k") % 10 == 0)
    content = (
        F.when(kind == "signup", F.to_json(F.struct(F.concat(F.lit("Please fix "), file, F.lit(" and "), name).alias("c"))))
        .when(kind == "view", F.to_json(F.struct(F.array(use("Read", file_path=F.concat(cwd, F.lit("/"), file))).alias("c"))))
        .when(kind == "click", F.to_json(F.struct(F.array(use("Edit", old_string=name, new_string=F.concat(name, F.lit("2")))).alias("c"))))
        .when((kind == "purchase") & search, F.to_json(F.struct(F.array(use("mcp__x__recall_search", query=F.concat(name, F.lit(" "), file))).alias("c"))))
        .when(kind == "purchase", F.to_json(F.struct(F.array(use("Bash", command=F.concat(F.lit("cargo test "), cwd, F.lit("/"), file))).alias("c"))))
        .otherwise(
            F.to_json(F.struct(F.array(F.struct(
                F.lit("tool_result").alias("type"), F.lit(True).alias("is_error"),
                F.concat(F.lit("2024-01-01T00:00:00Z fault at 0x"), F.lower(F.hex("k")), F.lit(" in "), file, F.lit(":"), F.col("k").cast("string"), F.lit(":7")).alias("content"),
            )).alias("c")))
        )
    )
    kept = F.when(
        boundary,
        F.struct(F.lit("auto").alias("trigger"), F.struct(F.filter(F.array(uid("prev2"), uid("prev")), lambda x: x.isNotNull()).alias("uuids")).alias("preservedMessages")),
    )
    role = F.when(boundary, "system").when(kind.isin("signup", "error"), "user").otherwise("assistant")
    head = F.to_json(F.struct(
        role.alias("type"), F.when(boundary, "compact_boundary").alias("subtype"), uid("event_id").alias("uuid"), uid("prev").alias("parentUuid"),
        iso(F.col("at")).alias("timestamp"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sessionId"), cwd.alias("cwd"),
        F.concat(F.lit("b"), (F.col("k") % 3).cast("string")).alias("gitBranch"), kept.alias("compactMetadata"),
    ))
    inner = F.expr("substring(content, 6, length(content) - 6)")  # the value of {"c":...}
    line = F.when(boundary, F.col("head")).otherwise(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"message":{"content":'), inner, F.lit("}}")))
    made = e.withColumn("content", content).withColumn("head", head).withColumn("line", line)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return made.select(
        "session_key", "line_no", F.lit(0).cast("long").alias("stream_offset"), F.octet_length("line").cast("long").alias("byte_len"), "line", "event_id"
    ).withColumn("stream_offset", before).drop("event_id")
