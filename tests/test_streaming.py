"""Streams give what the batch forms give."""

import json
import random
from datetime import datetime

import pytest

from threadline.operators import decide, sessions
from threadline.operators import records as R
from threadline.sources.records import lines_to_records
from threadline.streaming import transcripts as S

pytest.importorskip("google.protobuf", reason="stateful processors in Python need protobuf")


def lines(n):
    return "".join(json.dumps({"type": "user", "uuid": f"u{i}", "n": "x" * i}) + "\n" for i in range(n)).encode()


def run(spark, tmp_path, make, schema, batches, partition=None):
    spark.conf.set(*S.STORE)
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_tail_ingest_equals_batch(spark, tmp_path):
    data = {"a": lines(7) + b'{"partial', "b": lines(3)}
    cuts = [("a", 0, 50), ("b", 0, 20), ("a", 90, 200), ("a", 30, 95), ("a", 0, 50), ("b", 20, 999), ("a", 200, 9999)]
    batches = [[(k, o, bytearray(data[k][o:e]))] for k, o, e in cuts]
    got = run(spark, tmp_path, S.tail_ingest, "session_key string, offset long, data binary", batches)
    want = lines_to_records(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "session_key string, content binary"))
    order = ["session_key", "line_no"]
    assert got.orderBy(*order).collect() == want.select(*got.columns).orderBy(*order).collect()


def test_suppression(spark, tmp_path):
    batches = [[("s", 1, 10), ("s", 1, 11)], [("s", 2, 10), ("t", 1, 10)]]
    got = run(spark, tmp_path, S.suppress, "session_key string, prompt_no long, turn_id long", batches)
    rows = {(r.session_key, r.prompt_no, r.turn_id): r.reason for r in got.collect()}
    assert rows == {("s", 1, 10): None, ("s", 1, 11): None, ("s", 2, 10): "already given", ("t", 1, 10): None}


def test_upsert_is_idempotent(spark, tmp_path):
    write = S.upsert(str(tmp_path), ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(1, "c")], "k int, v string"), 1)
    write(spark.createDataFrame([(1, "c")], "k int, v string"), 1)
    rows = spark.read.parquet(str(tmp_path))
    assert sorted(map(tuple, S.current(rows, ["k"]).select("k", "v").collect())) == [(1, "c"), (2, "b")]


def transcript(rng, key, n):
    out = []
    for i in range(n):
        record = {"type": rng.choice(["user", "assistant", "system", "note"]), "uuid": f"{key}{i}", "timestamp": f"2024-01-01T00:00:{i % 60:02d}.000Z", "cwd": "/w", "sessionId": key}
        if rng.random() < 0.5:
            record["message"] = {"content": [{"type": "tool_use", "name": "Read", "input": {"file_path": f"/w/src/m{rng.randrange(3)}.rs"}}]}
        if rng.random() < 0.1:
            record = {"type": "system", "subtype": "compact_boundary", "uuid": f"{key}b{i}", "timestamp": record["timestamp"], "compactMetadata": {"preservedMessages": {"uuids": [f"{key}{i - 1}"]}}}
        if rng.random() < 0.2:
            record = {"type": "title", rng.choice(["aiTitle", "customTitle"]): f"t{i}"}
        out.append(json.dumps(record))
    return ("\n".join(out) + "\n").encode()


def test_derived_tables_equal_batch(spark, tmp_path):
    """Chunks split anywhere, repeated and out of order, in many batches: four tables as one pass over the whole gives them."""
    rng = random.Random(12)
    data = {k: transcript(rng, k, 30) for k in ("a", "b", "c")}
    cuts = [(k, o, o + rng.randrange(200, 900)) for k in data for o in range(0, len(data[k]), 200)]
    rng.shuffle(cuts)
    batches = [[(k, o, bytearray(data[k][o:e])) for k, o, e in cuts[i::6]] for i in range(6)] + [[(k, 0, bytearray(data[k])) for k in data]]
    recs = run(spark, tmp_path, S.tail_ingest, "session_key string, offset long, data binary", batches)
    spark.conf.set(*S.STORE)
    # the records' own stream: one file a session and batch, in the order written
    parts = sorted((tmp_path / "out").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert parts
    stream = spark.readStream.schema(S.RECORDS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "out"))
    write, last = S.derive_batch(str(tmp_path / "derived"), every=3), []

    def each(batch, number):
        write(batch, number)
        write(batch, number)  # a batch that is written again
        last.append(number)

    q = S.number_turns(stream).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and max(last) >= 3
    tables = S.derived_tables(str(tmp_path / "derived"), every=3)
    whole = lines_to_records(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "session_key string, content binary"))
    turns = R.classify_turns(whole)
    want = {"turns": turns, "entities": R.extract_entities(turns), "boundaries": R.boundaries(whole), "titles": R.session_titles(whole)}
    assert recs.count() == whole.count()
    for name, df in want.items():
        got = tables[name].current(spark, max(last))
        columns = [c for c in got.columns if c in df.columns]
        rows = lambda x: sorted(map(str, x.select(*columns).distinct().collect()))  # noqa: B023, E731
        assert rows(got) == rows(df) and got.count() > 0, name


OFFERS = "session_id string, arrival long, query_id long, compactions int, rank int, turn_id long, own boolean, fell_out boolean"


def test_decisions_equal_batch(spark, tmp_path):
    rng = random.Random(13)
    rows = [(s, -1, 0, 0, -1, t, False, False) for s in ("s", "t") for t in (3, 4)]
    first = list(rows)
    batches = [first]
    for b in range(4):
        part = []
        for s in ("s", "t", "u"):
            for p in range(rng.randrange(1, 4)):
                arrival, done = b * 10 + p, b // 2
                part.append((s, arrival, 100 + arrival, done, 0, None, False, False))
                part += [(s, arrival, 100 + arrival, done, r, t, t % 3 == 0, t % 6 == 0) for r, t in enumerate(rng.sample(range(1, 30), 8), 1)]
        rng.shuffle(part)
        batches.append(part)
        rows += part
    got = run(spark, tmp_path, S.decide_stream, OFFERS, batches)
    frame = spark.createDataFrame(rows, OFFERS)
    told = frame.where("rank = -1").select("session_id", "turn_id")
    want = decide.decide(frame.where("rank >= 0"), told)
    plain = lambda df: sorted(map(tuple, df.select("session_id", "query_id", "turn_id", "place", "reason", "compacted").collect()), key=str)
    assert plain(got) == plain(want) and {r.reason for r in got.collect()} == {None, "already given", "visible", "carried by digest"}


def test_close_by_event_time(spark, tmp_path):
    """A session closes once, six hours after its last turn in event time; late turns do not reopen it."""
    at = lambda day, hour: datetime(2024, 1, day, hour)
    batches = [[("a", at(1, 0)), ("b", at(1, 1))], [("a", at(1, 3))], [("b", at(1, 20))], [("b", at(2, 12)), ("a", at(2, 12))], [("b", at(3, 12))], [("c", at(4, 12))]]
    got = run(spark, tmp_path, S.close_sessions, "session_key string, at timestamp", batches)
    rows = sorted(map(tuple, got.collect()))
    assert [k for k, _ in rows] == sorted({k for k, _ in rows}) and rows[0][0] == "a" and rows[0][1] >= 2


def test_labels_are_given_once(spark, tmp_path):
    path = str(tmp_path / "labels")
    decisions = spark.createDataFrame([(1, "s", "2024-01-01", ["x.rs"]), (2, "t", "2024-01-01", ["y.rs"]), (3, "s", "2024-01-02", [])], "decision_id long, session_id string, ts string, spellings array<string>")
    turns = spark.createDataFrame([(10, "s", "2024-01-03", "Read"), (11, "s", "2024-01-03", "mcp_recall_search"), (12, "t", "2023-01-01", "Read")], "turn_id long, session_id string, ts string, tool_name string")
    entities = spark.createDataFrame([(10, "path", "p"), (20, "path", "p"), (21, "path", "q"), (11, "path", "x.rs")], "turn_id long, kind string, value string")
    injected = spark.createDataFrame([(1, 20), (1, 21), (2, 21)], "decision_id long, turn_id long")
    write = S.label_on_close(path, decisions, turns, entities, injected)
    closed = lambda *ids: spark.createDataFrame([(i,) for i in ids], "session_id string")
    for batch, ids in ((0, ["s"]), (1, ["s", "t"]), (1, ["s", "t"]), (2, ["t", "s"])):
        write(closed(*ids), batch)
    got = spark.read.parquet(path)
    assert sorted((r.decision_id, r.turn_id, r.label) for r in got.collect()) == [(1, 20, "hit"), (1, 21, "false positive"), (2, 21, "false positive")]
    own = spark.read.parquet(path + "-decisions")
    assert sorted((r.decision_id, r.label, r.detail) for r in own.where("label is not null").collect()) == [(1, "miss", "x.rs"), (2, "wasted budget", None)]
    assert sorted(r.decision_id for r in own.where("label is null").collect()) == [1, 2, 3]


def test_summaries_from_deltas(spark):
    meta = lambda rows: spark.createDataFrame(rows, "session_key string, project string, pre_worktree string, turn_count long")
    old = [("a", None, None, None), ("b", "/p", None, 3), ("c", "/q", "/q/w", 2)]
    new = [("a", "/p", None, 5), ("b", "/p", None, 4), ("c", "/r", None, 2), ("d", None, None, 1)]
    now = S.apply_deltas(sessions.project_summary(meta(old)), S.summary_deltas(meta(old), meta(new)))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(now) == plain(sessions.project_summary(meta(new)))
