"""Derived tables of transcript records: turns, bodies, entities, boundaries, titles."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.functions.values import blocks_at, expanded, flag_in, lexical_path, normalize_error, string_at, string_in, variant

# Fixed values.
TURN_TYPES = ("user", "assistant", "attachment", "system")
ENVELOPES = ("<command-message", "<command-name", "<local-command-caveat", "<task-notification", "<local-command-stdout", "<bash-stdout")
WRITING_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
BODY_BYTES, DEPTH, MOST_ENTITIES = 256 * 1024, 8, 48


def classify_turns(records: DataFrame) -> DataFrame:
    """Records that are turns, numbered in byte order: :func:`turn_fields` and ``turn_seq``."""
    seq = F.row_number().over(Window.partitionBy("session_key").orderBy("stream_offset")) - 1
    return turn_fields(records).withColumn("turn_seq", seq.cast("long"))


def numbered_records(records: DataFrame) -> DataFrame:
    """All records with what is known of them as turns and of their sessions (:func:`record_fields`), turns numbered in byte order; ``turn_seq`` is null for other records."""
    before = Window.partitionBy("session_key").orderBy("stream_offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = (F.col("uuid").isNotNull() & F.col("ts").isNotNull() & F.col("record_type").isin(*TURN_TYPES))
    return record_fields(records).withColumn("turn_seq", F.when(turn, F.count(F.when(turn, 1)).over(before) - 1))


def is_turn(v: str = "v") -> Column:
    """Whether a record (a VARIANT) is a turn."""
    return string_at(v, "$.uuid").isNotNull() & string_at(v, "$.timestamp").isNotNull() & F.coalesce(string_at(v, "$.type").isin(*TURN_TYPES), F.lit(False))


#: Names in a record of what its session is known by.
SESSION_FIELDS = {"sid": "$.sessionId", "other": "$.session_id", "cwd": "$.cwd", "branch": "$.gitBranch"}
TURN_FIELDS = ("uuid", "parent_uuid", "record_type", "tool_name", "ts", "is_typed")


def _turn_struct(v: Column) -> list[Column]:
    blocks = F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array())
    kind = lambda b: F.variant_get(b, "$.type", "string")
    names = F.filter(F.transform(F.filter(blocks, lambda b: kind(b) == "tool_use"), lambda b: F.variant_get(b, "$.name", "string")), lambda n: n.isNotNull())
    text = F.coalesce(
        string_in(v, "$.message.content"),
        F.get(F.transform(F.filter(blocks, lambda b: kind(b) == "text"), lambda b: F.variant_get(b, "$.text", "string")), F.lit(0)),
        F.lit(""),
    )
    machine = (
        F.coalesce(string_in(v, "$.entrypoint"), F.lit("")).startswith("sdk-") | flag_in(v, "$.isMeta")
        | F.array_contains(F.transform(blocks, kind), "tool_result") | F.ltrim(text).rlike("^(" + "|".join(ENVELOPES) + r")[\s/>]")
    )
    return [
        string_in(v, "$.uuid").alias("uuid"), string_in(v, "$.parentUuid").alias("parent_uuid"), string_in(v, "$.type").alias("record_type"), F.get(names, F.lit(0)).alias("tool_name"),
        string_in(v, "$.timestamp").alias("ts"), F.when(string_in(v, "$.type") == "user", ~machine).alias("is_typed"),
    ]


def _parsed(records: DataFrame, *more: str, session: bool) -> DataFrame:
    """Fields of every record.  A line is parsed once: what a generator gives out is not worked out again by filters above it."""
    fields = lambda v: F.struct(*_turn_struct(v), *([string_in(v, path).alias(name) for name, path in SESSION_FIELDS.items()] if session else []))
    return records.select("session_key", *more, "stream_offset", "byte_len", "line", F.inline_outer(F.transform(F.array(variant("line")), fields)))


def record_fields(records: DataFrame, *more: str) -> DataFrame:
    """Every record with the fields of :func:`turn_fields` and those of its session: ``sid, other, cwd, branch``."""
    return _parsed(records, *more, session=True)


def turn_fields(records: DataFrame, *more: str) -> DataFrame:
    """Records that are turns, each judged by itself; ``more`` columns pass through.

    A turn has string ``uuid`` and ``timestamp`` and one of four types.  Returns
    ``session_key, uuid, parent_uuid, record_type, tool_name, ts, is_typed,
    stream_offset, byte_len, line``.  ``is_typed`` is null for all but user
    records: whether a person typed it.
    """
    return _parsed(records, *more, session=False).where(F.col("uuid").isNotNull() & F.col("ts").isNotNull() & F.col("record_type").isin(*TURN_TYPES))


def with_turn_ids(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``turn_id``: the session's number in the high bits, the turn's in the low 24."""
    numbered = turns.join(sessions.select("session_key", "session_no"), "session_key")
    return numbered.withColumn("turn_id", F.shiftleft(F.col("session_no").cast("long"), 24).bitwiseOR(F.col("turn_seq")))


def _leaves(value, depth: int, out: list[str]) -> None:
    """String leaves in key order, no keys and no numbers."""
    if depth >= DEPTH:
        return
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, list):
        for x in value:
            _leaves(x, depth + 1, out)
    elif isinstance(value, dict):
        for key in sorted(value):
            _leaves(value[key], depth + 1, out)


def _texts(content) -> list[str]:
    """The text of a tool result: a string, or the texts of a list's parts; anything else has none."""
    if isinstance(content, str):
        return [content]
    parts = content if isinstance(content, list) else ()
    return [p["text"] for p in parts if isinstance(p, dict) and isinstance(p.get("text"), str)]


def parsed_record(line: str) -> dict:
    """The record of a line; a line that holds none is an empty one."""
    try:
        record = json.loads(line)
    except (TypeError, ValueError, RecursionError):
        return {}
    return record if isinstance(record, dict) else {}


def _whole(text: str) -> str:
    """Lone halves of surrogate pairs become the replacement character."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _body(record: dict) -> str:
    out: list[str] = []
    message = record.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    if isinstance(content, str):
        out.append(content)
    for block in content if isinstance(content, list) else ():
        if not isinstance(block, dict):
            continue
        if block.get("type") == "text" and isinstance(block.get("text"), str):
            out.append(block["text"])
        elif block.get("type") == "tool_use":
            _leaves(block.get("input"), 0, out)
        elif block.get("type") == "tool_result":
            out += _texts(block.get("content"))
    if isinstance(record.get("content"), str):
        out.append(record["content"])
    _leaves(record.get("toolUseResult"), 0, out)
    _leaves(record.get("attachment"), 0, out)
    return _whole("\n".join(out)).encode()[:BODY_BYTES].decode(errors="ignore")


@F.arrow_udf(T.StringType())
def _bodies(lines: pa.Array) -> pa.Array:
    return pa.array([_body(parsed_record(line)) for line in lines.to_pylist()], pa.string())


def turn_bodies(turns: DataFrame, *more: str) -> DataFrame:
    """``session_key, turn_seq, body``: a turn's searchable text and the pieces of its identifiers; ``more`` columns pass through."""
    return turns.select("session_key", "turn_seq", *more, _bodies("line").alias("body")).withColumn("body", expanded(F.col("body")))


_CAMEL = regex.compile(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}_]+")
# the same for ASCII texts, which most are
_ASCII_CAMEL, _ASCII_WORD = re.compile(r"[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), re.compile(r"[A-Za-z0-9_]+")
_ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")


def identifiers(text: str) -> list[str]:
    """Tokens with a case boundary, or with underscores whose parts are all non-empty."""
    word, camel = (_ASCII_WORD, _ASCII_CAMEL) if text.isascii() else (_WORD, _CAMEL)
    return [w for w in word.findall(text) if camel.search(w) or ("_" in w and all(w.split("_")))]


def _unquoted(value: str) -> str:
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def _path(value: str) -> str:
    return re.sub(r"(?::[0-9]+){1,2}$", "", _unquoted(value.strip()))


def _command_words(command: str) -> list[str]:
    """Words of a command that name a file: no flags, assignments, expansions or addresses."""
    words = (w.strip("\"'") for w in re.split(r"[\s;&|<>()]+", command))
    return [w for w in words if re.search(r"[/\\]", w) and not w.startswith("-") and not _ASSIGNMENT.match(w) and not re.search(r"[$`*?{}]|://", w)]


def _program(command: str) -> list[str]:
    """The last part of the first word that is no assignment."""
    for word in map(_unquoted, command.split()):
        if word and not _ASSIGNMENT.match(word):
            return [re.split(r"[/\\]", word)[-1]]
    return []


def _entities(record: dict) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    message = record.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    for block in content if isinstance(content, list) else ():
        if not isinstance(block, dict):
            continue
        if block.get("type") == "tool_use" and isinstance(block.get("name"), str):
            name, given = block["name"], block.get("input") if isinstance(block.get("input"), dict) else {}
            text = {k: v for k, v in given.items() if isinstance(v, str)}
            found.append(("tool", name))
            found += [("path", _path(text[k])) for k in ("file_path", "path", "notebook_path") if k in text]
            if name == "Bash" and "command" in text:
                found += [("command", c) for c in _program(text["command"])]
                found += [("path", _path(w)) for w in _command_words(text["command"])]
            elif name == "Grep" and "pattern" in text:
                found += [("symbol", s) for s in identifiers(text["pattern"])]
            elif name == "Edit":
                found += [("symbol", s) for k in ("old_string", "new_string") if k in text for s in identifiers(text[k])]
            elif name == "recall_search" or name.endswith("_recall_search"):
                found += [("symbol", s) for s in identifiers(text.get("query", ""))]
                found += [("path", _path(w)) for w in _command_words(text.get("query", ""))]
                listed = given.get("paths")
                found += [("path", _path(p)) for p in (listed if isinstance(listed, list) else ()) if isinstance(p, str)]
        elif block.get("type") == "tool_result" and block.get("is_error") is True:
            found.append(("error", "\n".join(_texts(block.get("content")))))
    result = record.get("toolUseResult")
    if isinstance(result, dict):
        file = result.get("file")
        found += [("path", _path(p)) for p in (result.get("filePath"), file.get("filePath") if isinstance(file, dict) else None) if isinstance(p, str)]
        if isinstance(result.get("stderr"), str):
            found.append(("error", result["stderr"]))
    return [(k, _whole(v)) for k, v in found]


_LIST = T.ArrayType(T.StructType().add("kind", "string").add("value", "string"))


def _lists(found: list[list[tuple[str, str]]]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    pairs = [pa.array([e[i] for some in found for e in some], pa.string()) for i in (0, 1)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(pairs, ["kind", "value"]))


@F.arrow_udf(_LIST)
def _found(lines: pa.Array) -> pa.Array:
    return _lists([_entities(parsed_record(line)) for line in lines.to_pylist()])


@F.arrow_udf(T.StructType().add("body", "string").add("found", _LIST))
def _read(lines: pa.Array) -> pa.Array:
    every = [parsed_record(line) for line in lines.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(map(_body, every), pa.string()), _lists([_entities(r) for r in every])], ["body", "found"])


def _kept_entities(found: Column) -> Column:
    shaped = F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), F.when(e["kind"] == "error", normalize_error(e["value"])).otherwise(e["value"]).alias("value")))
    return F.slice(F.array_distinct(F.filter(shaped, lambda e: e["value"] != "")), 1, MOST_ENTITIES)


def with_texts(turns: DataFrame) -> DataFrame:
    """``turns`` with ``body`` and ``entities``, a list, as of :func:`turn_bodies` and :func:`extract_entities`; lines are read once for both."""
    read = turns.withColumn("__read", _read("line"))
    return read.withColumn("body", expanded(F.col("__read.body"))).withColumn("entities", _kept_entities(F.col("__read.found"))).drop("__read")


def extract_entities(turns: DataFrame, *more: str) -> DataFrame:
    """``session_key, turn_seq, kind, value, pos``: at most 48 distinct entities a turn, in the order they occur; ``more`` columns pass through.

    Kinds: path, command, error, symbol, tool.  Errors are reduced to their shape.
    Turns of :func:`with_texts` are not read again.
    """
    listed = F.col("entities") if "entities" in turns.columns else _kept_entities(_found("line"))
    # an inner generator would be given a filter that works the list out once more
    return turns.select("session_key", "turn_seq", *more, F.posexplode_outer(listed).alias("pos", "e")).where("pos is not null").select("session_key", "turn_seq", *more, "e.kind", "e.value", "pos")


def commands(turns: DataFrame) -> DataFrame:
    """``session_key, turn_seq, pos, command``: the command line of every ``Bash`` call, in the order of its blocks."""
    call = lambda b: (F.variant_get(b, "$.type", "string") == "tool_use") & (F.variant_get(b, "$.name", "string") == "Bash")
    text = lambda b: F.when(F.schema_of_variant(F.try_variant_get(b, "$.input.command", "variant")) == "STRING", F.try_variant_get(b, "$.input.command", "string"))
    lines = F.filter(F.transform(F.filter(blocks_at("v"), call), text), lambda c: c.isNotNull())
    return turns.withColumn("v", variant("line")).select("session_key", "turn_seq", F.posexplode(lines).alias("pos", "command"))


def commit_subjects(commands: DataFrame) -> DataFrame:
    """Commands that made a commit, with its ``subject``: ``-m``, ``--message`` or ``--message=``, of a here-document its first line.

    Words end at white space outside of quotes; quotes are dropped and nothing
    is expanded.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    words = F.transform(
        F.expr(r"""regexp_extract_all(command, '(?:[^\\s\'"]++|\'[^\']*+\'?+|"[^"]*+"?+)++', 0)"""),
        lambda w: F.regexp_replace(w, r"""'([^']*+)'?|"([^"]*+)"?""", "$1$2"),
    )
    c = commands.withColumn("__words", words)
    git = F.regexp_extract(F.get("__words", F.lit(0)), r"([^/\\]*)$", 1) == "git"
    c = c.where(git & F.array_contains("__words", "commit"))
    c = c.withColumn("__rest", F.expr("slice(__words, array_position(__words, 'commit') + 1, size(__words))"))
    flag = F.expr("array_position(transform(__rest, w -> w in ('-m', '--message') or startswith(w, '--message=')), true)").cast("int")
    c = c.withColumn("__at", flag).where("__at > 0")
    named = F.get("__rest", F.col("__at") - 1)
    said = F.when(named.startswith("--message="), F.substr(named, F.lit(len("--message=") + 1))).otherwise(F.get("__rest", F.col("__at")))
    body = F.expr("substring(command, instr(command, '<<') + 2)")
    below = F.when(F.instr("command", "<<") > 0, F.when(body.contains("\n"), F.regexp_replace(body, r"^[^\n]*\n", "")))
    first = F.get(F.filter(F.transform(F.split(below, "\n"), trim), lambda x: x != ""), F.lit(0))
    c = c.withColumn("__said", said).where("__said <> ''")
    subject = F.when(F.col("__said").startswith("$("), first).otherwise(trim(F.col("__said")))
    return c.withColumn("subject", subject).where("subject is not null").drop("__words", "__rest", "__at", "__said")


def boundaries(records: DataFrame) -> DataFrame:
    """Compaction boundaries: ``session_key, stream_offset, metadata, preserved``."""
    v = records.where(F.col("line").contains("compact_boundary")).withColumn("v", variant("line"))
    hit = (string_at("v", "$.type") == "system") & (string_at("v", "$.subtype") == "compact_boundary")
    return v.where(hit).select(
        "session_key", "stream_offset", F.get_json_object("line", "$.compactMetadata").alias("metadata"),
        F.expr("coalesce(try_variant_get(v, '$.compactMetadata.preservedMessages.uuids', 'array<string>'), array())").alias("preserved"),
    )


def titles_at(records: DataFrame) -> DataFrame:
    """``session_key, stream_offset, title, is_custom``: every title record that has text."""
    v = records.where(F.col("line").contains("Title")).withColumn("v", variant("line"))
    custom, made = string_at("v", "$.customTitle"), string_at("v", "$.aiTitle")
    return v.select("session_key", "stream_offset", F.coalesce(custom, made).alias("title"), custom.isNotNull().alias("is_custom")).where(F.trim("title") != "")


def session_titles(records: DataFrame) -> DataFrame:
    """``session_key, title, is_custom``: the last title; a generated one never replaces a custom one."""
    return titles_at(records).groupBy("session_key").agg(F.max_by("title", F.struct("is_custom", "stream_offset")).alias("title"), F.max("is_custom").alias("is_custom"))


def session_meta(records: DataFrame, turns: DataFrame | None, roots: DataFrame | None = None) -> DataFrame:
    """One row per session: own id, first folder, last branch, first and last turn in byte order, project, lineage."""
    return finished_meta(partial_meta(records, turns), roots)


#: What a session's row is made of: first or last by byte offset, each with its offset, so that parts merge in any order.
FIRST, LAST = ("sid", "cwd", "other", "first_turn"), ("branch", "last_turn")


def partial_meta(records: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """What one pass over some records knows of each session: for every field the value at the first or last offset, and the number of turns.

    Records of :func:`record_fields` are not parsed again, and those of
    :func:`numbered_records` hold their turns.
    """
    if "sid" not in records.columns:
        fields = lambda v: F.struct(*[string_in(v, path).alias(name) for name, path in SESSION_FIELDS.items()])
        records = records.select("session_key", "stream_offset", F.inline_outer(F.transform(F.array(variant("line")), fields)))
    numbered = turns is None
    turn = F.col("ts") if numbered else F.lit(None).cast("string")
    seen = F.col("turn_seq").isNotNull() if numbered else F.lit(False)
    v = records.select(
        "session_key", "stream_offset", *SESSION_FIELDS, F.when(seen, turn).alias("first_turn"), F.when(seen, turn).alias("last_turn"), seen.cast("int").alias("turn"),
    )
    # an id beside the record's own, or one without an own id, continues that session
    v = v.withColumn("other", F.when(F.col("other") != F.coalesce("sid", F.lit("")), F.col("other")))
    both = v if numbered else v.unionByName(turns.select("session_key", "stream_offset", F.col("ts").alias("first_turn"), F.col("ts").alias("last_turn"), F.lit(1).alias("turn")), allowMissingColumns=True)
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("stream_offset").alias("at"), F.col(c).alias("value")))
    fields = [F.min(at(c)).alias(c) for c in FIRST] + [F.max(at(c)).alias(c) for c in LAST]
    return both.groupBy("session_key").agg(*fields, F.sum("turn").cast("long").alias("turn_count"))


def merge_meta(*parts: DataFrame) -> DataFrame:
    """Partial rows of several passes as one; no record is read again, and parts come in any order."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("session_key").agg(*[F.min(c).alias(c) for c in FIRST], *[F.max(c).alias(c) for c in LAST], F.sum("turn_count").cast("long").alias("turn_count"))


def finished_meta(merged: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Session rows from merged parts; a session without a turn has no count."""
    made = merged.select(
        "session_key", F.col("sid.value").alias("session_id"), F.col("cwd.value").alias("cwd"), F.col("branch.value").alias("git_branch"), F.col("other.value").alias("continues_id"),
        F.col("first_turn.value").alias("first_turn_at"), F.col("last_turn.value").alias("last_turn_at"), F.when(F.col("turn_count") > 0, F.col("turn_count")).alias("turn_count"),
    )
    return project_keys(made.withColumn("is_sidechain", F.col("session_key").rlike(r"(^|/)agent-[^/]*\.jsonl$")), roots)


def project_keys(df: DataFrame, roots: DataFrame | None = None, cwd: str = "cwd") -> DataFrame:
    """Add ``project`` and ``pre_worktree``.

    A folder below ``<repo>/.claude/worktrees/<name>`` belongs to the repository
    and keeps its own place as ``pre_worktree``; else the deepest supplied root
    above the folder is its project, or the folder itself.
    """
    bare = lexical_path(F.col(cwd))
    tree = F.regexp_extract(bare, r"^(.*)/\.claude/worktrees/[^/]+", 1)
    out = df.withColumn("__bare", bare).withColumn("project", F.when(tree != "", tree).otherwise(bare)).withColumn("pre_worktree", F.when(tree != "", F.regexp_extract(bare, r"^(.*/\.claude/worktrees/[^/]+)", 1)))
    if roots is not None:
        parts = F.split("project", "/")
        paths = out.select("project").distinct().where(F.col("project").isNotNull())
        up = paths.select("project", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
        deepest = up.join(roots.select("root").distinct(), "root").groupBy("project").agg(F.max_by("root", F.length("root")).alias("__root"))
        out = out.join(deepest, "project", "left").withColumn("project", F.coalesce("__root", "project")).drop("__root")
    return out.drop("__bare")
