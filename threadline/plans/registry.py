"""The registered queries of the library and their SQL equivalents.

Transcript records are made from ``events`` (one session a user), search runs
over ``documents`` and ``conversations``, lineage over ``orders``, integrity over
``lineitem`` and folders over ``customer``, ``nation`` and ``region``.  The SQL
starts from the same tables and takes another road: it never builds JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.functions import values
from threadline.operators import decide, recommend, redact, records, search, sessions
from threadline.session import configure
from threadline.sources import records as source_records
from threadline.sources.records import events_as_records
from threadline.sources.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NOW = "2024-01-31T00:00:00.000Z"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- search -------------------------------------------------------------------

WORDS = "list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    bodies = docs.select(F.col("doc_id").alias("turn_id"), F.col("text").alias("body"))
    turns = docs.select(F.col("doc_id").alias("turn_id"), F.lit(None).cast("string").alias("ts"), F.lit(False).alias("is_sidechain"), F.col("source").alias("session_key"))
    return bodies, turns


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the second and third words of every hundredth document."""
    docs = _table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(values.tokens(F.col("text")), 2, 2), " ").alias("text"))


INDEX_SQL = f"""
words AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) GROUP BY ALL),
terms AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
asked AS (SELECT DISTINCT doc_id AS query_id, unnest(w[2:3]) AS t FROM words WHERE doc_id % 100 = 0),
need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY query_id),
scored AS (
  SELECT query_id, tf.doc_id AS turn_id, count(*) AS found,
         sum(greatest(ln((n - df + 0.5) / (df + 0.5)), CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN 0 ELSE 1e-6 END)
             * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))) AS score
  FROM asked JOIN tf USING (t) JOIN terms USING (t) JOIN words ON words.doc_id = tf.doc_id, corpus GROUP BY ALL),
hits AS (
  SELECT query_id, turn_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, turn_id) AS rank
  FROM scored JOIN need USING (query_id) WHERE found = need)
"""


@query(f"WITH {INDEX_SQL} SELECT query_id, turn_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all documents for a table of queries."""
    bodies, turns = _documents(spark, sf_dir)
    hits = search.search(_asked(spark, sf_dir), search.build_index(bodies), turns, k=10)
    return hits.select("query_id", "turn_id", F.round("text_score", 6).alias("score"), "rank")


@query(
    f"""WITH {INDEX_SQL},
pairs AS (SELECT DISTINCT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)),
kept AS (
  SELECT h.* EXCLUDE rank FROM hits h JOIN words q ON q.doc_id = h.query_id
  WHERE len(q.w[2:3]) < 2 OR EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = h.turn_id AND p.a = q.w[2] AND p.b = q.w[3])),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, turn_id) AS rank FROM kept)
SELECT query_id, turn_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 10"""
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written together, as in ``foo-bar``, stand together in what is found."""
    bodies, turns = _documents(spark, sf_dir)
    asked = _asked(spark, sf_dir).withColumn("text", F.translate("text", " ", "-"))
    index = search.build_index(bodies)
    hits = search.search(asked, index, turns, k=10, positions=search.build_positions(bodies))
    return hits.select("query_id", "turn_id", F.round("text_score", 6).alias("score"), "rank")


@query(
    f"WITH {INDEX_SQL} SELECT t AS term, df, n, round(avgdl, 6) AS avgdl FROM terms, corpus"
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies, number and mean length of documents."""
    index = search.build_index(_documents(spark, sf_dir)[0])
    return index.terms.crossJoin(F.broadcast(index.corpus)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(
    f"""WITH {INDEX_SQL},
flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents),
placed AS (
  SELECT query_id, turn_id, flat, least(
      coalesce(min(nullif(instr(lower(strip_accents(flat)), t), 0)), 1) - 80, length(flat) - 239) AS p
  FROM hits JOIN asked USING (query_id) JOIN flat ON doc_id = turn_id WHERE rank <= 3 GROUP BY query_id, turn_id, flat),
win AS (SELECT *, CASE WHEN length(flat) <= 240 THEN 1 ELSE greatest(1, p) END AS s FROM placed)
SELECT query_id, turn_id, (CASE WHEN s > 1 THEN '...' ELSE '' END) || substr(flat, s, 240) || (CASE WHEN s + 239 < length(flat) THEN '...' ELSE '' END) AS excerpt
FROM win"""
)
def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of text around the first query word of the best hits."""
    bodies, turns = _documents(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    hits = search.search(asked, search.build_index(bodies), turns, k=3)
    return search.with_excerpts(hits, bodies, asked).select("query_id", "turn_id", "excerpt")


@query(
    """WITH a AS (SELECT conv_id, max(turn) // 2 AS mid FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id)
SELECT c.conv_id AS session_key, c.turn AS turn_seq, c.role, mid AS middle, lo >= mid - 1 AS at_start, hi <= mid + 1 AS at_end
FROM conversations c JOIN a USING (conv_id) JOIN e USING (conv_id) WHERE c.turn BETWEEN mid - 1 AND mid + 1"""
)
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns around the middle of every conversation."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_key"), F.col("turn").alias("turn_seq"), "role")
    anchors = turns.groupBy("session_key").agg(F.floor(F.max("turn_seq") / 2).cast("long").alias("turn_seq")).withColumn("anchor_id", F.col("session_key"))
    return search.context_windows(anchors, turns, 1, 1).select("session_key", "turn_seq", "role", F.col("at").alias("middle"), "at_start", "at_end")


@query(
    """SELECT i.conv_id AS turn_id, c.role, CASE WHEN c.conv_id IS NULL THEN 'not found' END AS reason
FROM (SELECT DISTINCT conv_id * 2 AS conv_id FROM conversations) i LEFT JOIN conversations c ON c.conv_id = i.conv_id AND c.conv_id % 5 <> 0"""
)
def fetch_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch by id; unknown ids and those of hidden sessions are absent alike."""
    conv = _table(spark, sf_dir, "conversations")
    turns = conv.select(F.col("conv_id").alias("turn_id"), F.col("conv_id").alias("session_key"), "role")
    hidden = turns.where("session_key % 5 = 0").select("session_key").distinct()
    return search.get_turns(conv.select((F.col("conv_id") * 2).alias("turn_id")), turns, hidden).select("turn_id", "role", "reason")


# --- records ------------------------------------------------------------------

EVENTS_SQL = """
ev AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
turn AS (
  SELECT user_id::VARCHAR AS session_key, user_id, event_id, 'u' || event_id AS uuid, 'u' || prev AS parent_uuid, seq AS turn_seq, k, event_type,
         seq % 10 = 9 AS boundary, '/r' || (user_id % 5) AS cwd, 's' || user_id AS session_id, 'b' || (k % 3) AS branch,
         strftime(ts - CASE WHEN k % 7 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts,
         'Name' || k || 'Manager' AS name, 'src/mod' || k || '.rs' AS file
  FROM ev),
typed AS (
  SELECT *, CASE WHEN boundary THEN 'system' WHEN event_type IN ('signup', 'error') THEN 'user' ELSE 'assistant' END AS record_type,
         CASE WHEN boundary OR event_type IN ('signup', 'error') THEN NULL WHEN event_type = 'view' THEN 'Read' WHEN event_type = 'click' THEN 'Edit'
              WHEN k % 10 = 0 THEN 'mcp__x__recall_search' ELSE 'Bash' END AS tool_name,
         CASE WHEN boundary THEN NULL WHEN event_type = 'signup' THEN true WHEN event_type = 'error' THEN false END AS is_typed
  FROM turn),
ent AS (
  SELECT session_key, turn_seq, event_id, 'tool' AS kind, tool_name AS value FROM typed WHERE tool_name IS NOT NULL
  UNION ALL SELECT session_key, turn_seq, event_id, 'path', cwd || '/' || file FROM typed WHERE tool_name IN ('Read', 'Bash')
  UNION ALL SELECT session_key, turn_seq, event_id, 'path', file FROM typed WHERE tool_name = 'mcp__x__recall_search'
  UNION ALL SELECT session_key, turn_seq, event_id, 'command', 'cargo' FROM typed WHERE tool_name = 'Bash'
  UNION ALL SELECT session_key, turn_seq, event_id, 'symbol', name FROM typed WHERE tool_name IN ('Edit', 'mcp__x__recall_search')
  UNION ALL SELECT session_key, turn_seq, event_id, 'symbol', name || '2' FROM typed WHERE tool_name = 'Edit'
  UNION ALL SELECT session_key, turn_seq, event_id, 'error', '<ts> fault at <addr> in ' || file || ':<line>' FROM typed WHERE event_type = 'error' AND NOT boundary),
meta AS (
  SELECT session_key, session_id, cwd AS project, arg_max(branch, turn_seq) AS git_branch, arg_min(ts, turn_seq) AS first_turn_at,
         arg_max(ts, turn_seq) AS last_turn_at, count(*) AS turn_count FROM typed GROUP BY session_key, session_id, cwd)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_records(_table(spark, sf_dir, "events"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.classify_turns(_records(spark, sf_dir))


def _with_ids(df: DataFrame) -> DataFrame:
    """Turn ids: the session's number is the user's."""
    return df.withColumn("turn_id", F.shiftleft(F.col("session_key").cast("long"), 24).bitwiseOR(F.col("turn_seq")))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.session_meta(_records(spark, sf_dir), _turns(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT session_key, turn_seq, uuid, parent_uuid, record_type, tool_name, ts, is_typed FROM typed")
def classify_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to turns."""
    return _turns(spark, sf_dir).select("session_key", "turn_seq", "uuid", "parent_uuid", "record_type", "tool_name", "ts", "is_typed")


@query(f"WITH {EVENTS_SQL} SELECT session_key, turn_seq, kind, value FROM ent")
def turn_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all turns."""
    return records.extract_entities(_turns(spark, sf_dir)).select("session_key", "turn_seq", "kind", "value")


BODIES_SQL = """SELECT session_key, turn_seq, CASE event_type
  WHEN 'signup' THEN 'Please fix ' || file || ' and ' || name || ' name' || k || ' manager'
  WHEN 'view' THEN cwd || '/' || file
  WHEN 'click' THEN name || '2' || chr(10) || name || ' name' || k || ' manager2 manager'
  WHEN 'purchase' THEN CASE WHEN k % 10 = 0 THEN name || ' ' || file || ' name' || k || ' manager' ELSE 'cargo test ' || cwd || '/' || file END
  WHEN 'error' THEN '2024-01-01T00:00:00Z fault at 0x' || lower(printf('%X', k)) || ' in ' || file || ':' || k || ':7 t00 z' END AS body
FROM typed WHERE NOT boundary UNION ALL SELECT session_key, turn_seq, '' FROM typed WHERE boundary"""


@query(f"WITH {EVENTS_SQL} {BODIES_SQL}")
def turn_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable text with the pieces of its identifiers."""
    return records.turn_bodies(_turns(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL} SELECT session_key, turn_seq AS boundary_seq, 'u' || p2 || ',' || 'u' || prev AS preserved FROM typed
JOIN (SELECT event_id, prev, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS p2 FROM ev) USING (event_id) WHERE boundary""")
def compaction_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries and what they preserve."""
    recs = _records(spark, sf_dir)
    found = records.boundaries(recs).join(recs.select("session_key", "stream_offset", "line_no"), ["session_key", "stream_offset"])
    return found.select("session_key", F.col("line_no").alias("boundary_seq"), F.array_join("preserved", ",").alias("preserved"))


@query(
    f"""WITH {EVENTS_SQL}, b AS (SELECT session_key, max(turn_seq) AS last FROM typed WHERE boundary GROUP BY session_key)
SELECT session_key, turn_seq, uuid FROM typed JOIN b USING (session_key) WHERE turn_seq < last - 2"""
)
def dropped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that the latest compaction of each session left out."""
    return sessions.dropped_turns(records.boundaries(_records(spark, sf_dir)), _turns(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT * FROM meta")
def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session."""
    return _meta(spark, sf_dir).select("session_key", "session_id", "project", "git_branch", "first_turn_at", "last_turn_at", "turn_count")


@query(f"WITH {EVENTS_SQL} SELECT * FROM meta")
def merged_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: three passes over different records of every session, merged without reading a record again."""
    recs = _records(spark, sf_dir)
    passes = []
    for part in (1, 0, 2):
        some = recs.where(F.pmod(F.xxhash64("session_key", "stream_offset"), F.lit(3)) == part)
        passes.append(records.partial_meta(some, records.turn_fields(some)))
    return records.finished_meta(records.merge_meta(*passes)).select("session_key", "session_id", "project", "git_branch", "first_turn_at", "last_turn_at", "turn_count")


@query(f"WITH {EVENTS_SQL} SELECT project, NULL::VARCHAR AS pre_worktree, count(*) AS sessions, sum(turn_count)::BIGINT AS turns FROM meta GROUP BY project")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: sessions and turns per project."""
    return sessions.project_summary(_meta(spark, sf_dir))


@query(
    f"""WITH {EVENTS_SQL},
p AS (SELECT session_key, list(turn_seq ORDER BY turn_seq DESC)[1:12] AS l FROM typed WHERE is_typed GROUP BY session_key),
r AS (SELECT session_key, max(turn_seq) AS newest_reply FROM typed WHERE record_type = 'assistant' GROUP BY session_key)
SELECT session_key, project, turn_count, array_to_string(l, ',') AS newest_prompts, newest_reply FROM meta LEFT JOIN p USING (session_key) LEFT JOIN r USING (session_key)"""
)
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest prompts and reply of each session."""
    turns = _turns(spark, sf_dir)
    made = sessions.session_summary(_meta(spark, sf_dir), turns, records.extract_entities(turns))
    return made.select("session_key", "project", "turn_count", F.array_join(F.col("newest_prompts").cast("array<string>"), ",").alias("newest_prompts"), "newest_reply")


@query(
    f"""WITH {EVENTS_SQL},
f AS (
  SELECT session_key, CASE WHEN kind = 'path' THEN 'read' ELSE kind || 's' END AS l, value FROM ent
  WHERE kind IN ('tool', 'error', 'path')),
ran AS (SELECT session_key, cwd || '/' || file AS c, min(turn_seq) AS first FROM typed WHERE tool_name = 'Bash' GROUP BY ALL),
g AS (SELECT session_key, l, list(DISTINCT value ORDER BY value)[1:64] AS v FROM f GROUP BY ALL)
SELECT session_key, project, turn_count,
  ((epoch_ms(strptime(last_turn_at, '%Y-%m-%dT%H:%M:%S.%fZ')) - epoch_ms(strptime(first_turn_at, '%Y-%m-%dT%H:%M:%S.%fZ'))) // 1000)::BIGINT AS duration_s,
  (SELECT count(*) FROM typed t WHERE t.session_key = meta.session_key AND boundary) AS compactions,
  coalesce(array_to_string((SELECT v FROM g WHERE g.session_key = meta.session_key AND l = 'read'), '|'), '') AS files_read,
  '' AS files_modified, '' AS cut, '' AS commits,
  coalesce(array_to_string((SELECT v FROM g WHERE g.session_key = meta.session_key AND l = 'tools'), '|'), '') AS tools,
  coalesce(array_to_string((SELECT v FROM g WHERE g.session_key = meta.session_key AND l = 'errors'), '|'), '') AS errors,
  coalesce(array_to_string((SELECT list('cargo test ' || c ORDER BY first)[1:64] FROM ran WHERE ran.session_key = meta.session_key), '|'), '') AS commands
FROM meta"""
)
def session_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each session."""
    turns = _turns(spark, sf_dir)
    made = sessions.session_observation(_meta(spark, sf_dir), turns, records.extract_entities(turns), records.boundaries(_records(spark, sf_dir)))
    join = lambda c: F.array_join(c, "|")
    return made.select(
        "session_key", "project", "turn_count", "duration_s", "compactions", join("read").alias("files_read"), join("modified").alias("files_modified"), join("cut").alias("cut"), join("tools").alias("tools"),
        join("errors").alias("errors"), join("commands").alias("commands"), join("commits").alias("commits"),
    )


@query(f"WITH {EVENTS_SQL} SELECT session_key, last_turn_at < '2024-01-30T18:00:00.000Z' AS closed FROM meta")
def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: sessions idle for six hours."""
    return sessions.finalize_sessions(_meta(spark, sf_dir), NOW).select("session_key", "closed")


@query(f"WITH {EVENTS_SQL} SELECT session_key FROM meta WHERE last_turn_at >= '2024-01-30T12:00:00.000Z' AND first_turn_at <= '2024-01-02T23:59:59.999Z'")
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions that overlap a span."""
    return sessions.sessions_between(_meta(spark, sf_dir), "2024-01-30T12:00:00.000Z", search.checked_bound("2024-01-02", True)).select("session_key")


@query(
    f"""WITH {EVENTS_SQL}, d AS (SELECT * FROM meta WHERE last_turn_at < '2024-01-30T18:00:00.000Z' AND session_key::INT % 3 <> 0)
SELECT session_key, greatest((SELECT count(*) FROM d) - 20, 0) AS over FROM d ORDER BY last_turn_at, session_key LIMIT 20"""
)
def observations_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions without an observation, the oldest twenty."""
    meta = sessions.finalize_sessions(_meta(spark, sf_dir), NOW)
    done = meta.where("cast(session_key as int) % 3 = 0").select("session_key")
    return sessions.observe_new(meta, done, 20).select("session_key", "over")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, substr(first_turn_at, 1, 7) AS month FROM meta)
SELECT 'project' AS report, project AS label, count(*) AS sessions, sum(turn_count * 100)::BIGINT AS bytes FROM m GROUP BY project
UNION ALL SELECT 'month', month, count(*), sum(turn_count * 100)::BIGINT FROM m GROUP BY month"""
)
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and bytes by project and by month."""
    meta = _meta(spark, sf_dir)
    return sessions.usage_report(meta, meta.select("session_key", (F.col("turn_count") * 100).alias("bytes")))


@query(
    f"""WITH {EVENTS_SQL}, r AS (SELECT *, session_key::INT AS s FROM meta WHERE last_turn_at < '2024-01-30T18:00:00.000Z'),
a AS (SELECT session_key, last_turn_at, CASE WHEN project = '/r1' AND s % 2 = 0 AND last_turn_at < '2024-01-29T00:00:00.000Z' THEN 'delete'
  WHEN last_turn_at < '2024-01-30T00:00:00.000Z' AND s % 7 <> 0 THEN 'evict' END AS action FROM r WHERE project IN ('/r1', '/r2')),
k AS (SELECT session_key, action, row_number() OVER (PARTITION BY action ORDER BY last_turn_at, session_key) AS rank, count(*) OVER (PARTITION BY action) AS n FROM a WHERE action IS NOT NULL)
SELECT session_key, action, rank, greatest(n - 100, 0) AS over FROM k WHERE rank <= 100"""
)
def retention_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deepest rules evict or delete."""
    meta = sessions.finalize_sessions(_meta(spark, sf_dir), NOW).withColumn("evicted", F.col("session_key").cast("int") % 7 == 0)
    rules = meta.where("project in ('/r1', '/r2')").select(F.col("project").alias("prefix")).distinct()
    rules = rules.withColumn("evict_days", F.lit(1)).withColumn("delete_days", F.when(F.col("prefix") == "/r1", 2).otherwise(0))
    live = meta.where("cast(session_key as int) % 2 = 1").select("session_key")
    return sessions.retention_select(meta, rules, live, NOW, 100)


@query(
    f"""WITH {EVENTS_SQL} SELECT (SELECT count(*) FROM meta) AS sessions, (SELECT count(*) FROM typed) AS turns, (SELECT count(*) FROM meta) AS watermarks,
(SELECT sum(turn_count * 10)::BIGINT FROM meta) AS watermark_bytes"""
)
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: one row of totals."""
    meta = _meta(spark, sf_dir)
    return sessions.store_counts(meta, _turns(spark, sf_dir), meta.select("session_key", (F.col("turn_count") * 10).alias("byte_offset")))


# --- the other tables ---------------------------------------------------------


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS root FROM orders)
SELECT 'o' || o_orderkey AS session_key, 'o' || prev AS parent_key, 'o' || root AS root, n - 1 AS depth FROM o WHERE prev IS NOT NULL"""
)
def continuation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order continues the customer's one before; roots by pointer doubling."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    prev = F.lag("o_orderkey").over(w)
    o = _table(spark, sf_dir, "orders").select(name(F.col("o_orderkey")).alias("session_key"), name(prev).alias("parent"))
    turns = o.select("session_key", F.lit(0).alias("turn_seq"), F.concat(F.lit("t"), "session_key").alias("uuid"), F.concat(F.lit("t"), "parent").alias("parent_uuid"))
    meta = o.select("session_key", F.col("session_key").alias("session_id"), F.lit(None).cast("string").alias("continues_id"))
    edges = sessions.continuation_edges(meta, turns)
    return edges.select("session_key", "parent_key").join(sessions.thread_roots(edges), "session_key").select("session_key", "parent_key", "root", "depth")


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS session_key, l_linenumber AS chunk_no FROM lineitem),
g AS (SELECT *, lag(chunk_no, 1, 0) OVER (PARTITION BY session_key ORDER BY chunk_no) AS after FROM c)
SELECT session_key, after, chunk_no AS before FROM g WHERE chunk_no > after + 1"""
)
def chunk_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes in the numbering of stored chunks."""
    return sessions.chunk_gaps(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_key"), F.col("l_linenumber").alias("chunk_no")))


@query(
    """WITH c AS (SELECT l_orderkey AS session_key, l_linenumber AS chunk_no, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT session_key, chunk_no, CASE WHEN p % 11 = 0 THEN 'missing' WHEN p % 13 = 0 THEN 'unexpected' ELSE 'changed' END AS problem
FROM c WHERE p % 11 = 0 OR p % 13 = 0 OR p % 17 = 0"""
)
def verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks against a manifest, some of them lost, added or changed."""
    c = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_key"), F.col("l_linenumber").alias("chunk_no")).agg(F.min("l_partkey").alias("p"))
    digest = F.sha2(F.col("p").cast("string").cast("binary"), 256)
    stored = c.where("p % 11 <> 0").withColumn("sha256", F.when(F.col("p") % 17 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(digest))
    return sessions.verify(stored, c.where("p % 11 = 0 or p % 13 <> 0").withColumn("sha256", digest))


@query(
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
kept AS (SELECT * FROM c WHERE p % 11 <> 0),
s AS (SELECT k, max(n) AS cnt, k % 8 = 0 AS evicted, k % 9 = 0 AS diverged, bool_or(p % 11 = 0 OR p % 17 = 0) AS wrong FROM c GROUP BY k),
holes AS (
  SELECT k, n, lag(n) OVER (PARTITION BY k ORDER BY n) AS before FROM (
    SELECT k, n FROM kept JOIN s USING (k) WHERE NOT evicted UNION ALL SELECT k, 0 FROM s WHERE NOT evicted UNION ALL SELECT k, cnt + 1 FROM s WHERE NOT evicted))
SELECT k AS session_key, 'missing' AS problem, (before + 1)::BIGINT AS first, (n - 1)::BIGINT AS last FROM holes WHERE n > before + 1
UNION ALL SELECT k, 'checksum', NULL, NULL FROM s WHERE NOT evicted AND wrong
UNION ALL SELECT k, 'diverged', NULL, NULL FROM s WHERE diverged
UNION ALL SELECT k, 'rows of an evicted session', count(*), NULL FROM kept JOIN s USING (k) WHERE evicted GROUP BY k"""
)
def verify_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions by a tree of digests: missing runs of chunks, checksums, evicted and diverged ones."""
    c = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_key"), F.col("l_linenumber").alias("chunk_no")).agg(F.min("l_partkey").alias("p"))
    whole = c.withColumn("sha256", F.sha2(F.col("p").cast("string").cast("binary"), 256))
    k = F.col("session_key")
    recorded = sessions.session_checksums(whole, 2, 3).join(c.groupBy("session_key").agg(F.max("chunk_no").alias("chunk_count")), "session_key").withColumn("evicted", k % 8 == 0).withColumn("diverged", k % 9 == 0)
    kept = whole.where("p % 11 <> 0").withColumn("sha256", F.when(F.col("p") % 17 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("sha256")))
    return sessions.verify_sessions(kept, recorded, 2, 3)


@query(
    """WITH p AS (SELECT c_custkey AS path_id, '/' || r_name || '/' || n_name || '/c' || c_custkey AS path, r_name, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT path_id, CASE WHEN n_nationkey % 2 = 0 THEN '/' || r_name || '/' || n_name ELSE '/' || r_name END AS project, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS depth FROM p"""
)
def resolved_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the deepest stored folder above each customer's path."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("path_id"), F.concat_ws("/", F.lit(""), "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("path")
    )
    projects = n.select(F.concat_ws("/", F.lit(""), "r_name").alias("project")).unionByName(n.where("n_nationkey % 2 = 0").select(F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("project")))
    return search.resolve_scope(paths, projects.distinct().withColumn("pre_worktree", F.lit(None).cast("string"))).select("path_id", "project", "depth")


@query(
    """WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS length, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice)::BIGINT - (o_orderkey % 1000) END AS wm FROM orders)
SELECT count(*) FILTER (greatest(length - coalesce(wm, 0), 0) > 0) AS sources, coalesce(sum(greatest(length - coalesce(wm, 0), 0)), 0)::BIGINT AS bytes FROM s"""
)
def pending_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes beyond the watermarks."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_key"), F.floor("o_totalprice").cast("long").alias("length"))
    marks = o.where("session_key % 3 <> 0").select("session_key", (F.col("length") - F.col("session_key") % 1000).alias("byte_offset"))
    return sessions.pending_bytes(o, marks)


@query("SELECT lang, 'assignment' AS rule, sum(len(regexp_extract_all(text, '[A-Za-z0-9_.-]*(?i:token|password|passwd|secret|key|api|bearer|cookie|authorization)[A-Za-z0-9_.-]*[ \\t]*(==|=>|=)[ \\t]*[^\\s]')))::BIGINT AS hits FROM documents GROUP BY lang HAVING hits > 0")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets replaced in all documents, by language and rule."""
    done = redact.redact(_table(spark, sf_dir, "documents").select("lang", "text"), "text")
    return redact.hit_counts(done, "lang")


#: A text for each rule, by the order's number: what it looks like, and what is left.
_RULE_TEXTS = [
    ("pem", "-----BEGIN RSA PRIVATE KEY-----~{0}~-----END RSA PRIVATE KEY----- after", "[redacted: a PEM private key block] after"),
    ("userinfo", "see postgres://u:{0}@host/db", "see postgres://[redacted]@host/db"),
    ("header", "Authorization: Bearer {0} end", "Authorization: [redacted] end"),
    ("json", '{{"api_key": "{0}", "n": 1}}', '{{"api_key": "[redacted]", "n": 1}}'),
    ("assignment", "export MY_TOKEN={0}; ls", "export MY_TOKEN=[redacted] ls"),
    ("flag", "run --password {0} now", "run --password [redacted] now"),
    ("jwt", "a eyJ{0}.x b", "a [redacted: a JWT] b"),
    ("github", "ghp_{0} end", "[redacted: a GitHub token] end"),
    ("sk", "take sk-{0}", "take [redacted: a secret key]"),
    ("", "plain {0} text", "plain {0} text"),
]


def _rule_case(column: int) -> str:
    q = lambda t: "'" + t.replace("'", "''").replace("{{", "{").replace("}}", "}").replace("{0}", "' || d || '").replace("~", "' || chr(10) || '") + "'"
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {q(t[column])}" for i, t in enumerate(_RULE_TEXTS)) + " END"


@query(f"SELECT o_orderkey, {_rule_case(2)} AS text, {_rule_case(0)} AS rules FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS d FROM orders)")
def redaction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the nine rules, and which of them hit."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("d"))
    texts = o.select("o_orderkey", F.expr(_rule_case(1)).alias("text"))
    done = redact.redact(texts, "text")
    hit = F.filter(F.arrays_zip("hits", F.array(*[F.lit(r) for r in redact.RULES]).alias("rule")), lambda x: x["hits"] > 0)
    return done.select("o_orderkey", "text", F.array_join(F.transform(hit, lambda x: x["rule"]), ",").alias("rules"))


# --- sources, streams of bytes and stored tables --------------------------------


@query(
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no, len(l) AS n FROM d),
o AS (SELECT doc_id, line_no, n, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_offset FROM u)
SELECT doc_id::VARCHAR AS session_key, line_no, stream_offset, strlen(line) AS byte_len, line FROM o WHERE line_no < n - 1 AND trim(line) <> ''"""
)
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file; its complete lines and their places in bytes."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    return source_records.lines_to_records(docs.select(F.col("doc_id").cast("string").alias("session_key"), F.col("text").cast("binary").alias("content")))


@query(
    """WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS line_no FROM conversations)
SELECT conv_id::VARCHAR AS session_key, line_no, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_offset,
  strlen(text) AS byte_len, text AS line FROM c"""
)
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are rows of a table already."""
    conv = _table(spark, sf_dir, "conversations").withColumn("place", F.struct("turn", "role", "text"))
    return source_records.records_from_table(conv, "conv_id", "place", "text")


FILES_SQL = """
files AS (
  SELECT o_orderkey AS k, 'p' || (o_custkey % 50) AS folder, '00000000-0000-0000-0000-' || lpad(o_orderkey::VARCHAR, 12, '0') || '.jsonl' AS name,
         CASE o_orderkey % 5 WHEN 0 THEN '00000000-0000-0000-0000-' || lpad(o_orderkey::VARCHAR, 12, '0') || '.jsonl' WHEN 1 THEN 'x/sub/agent-' || o_orderkey || '.jsonl'
           WHEN 2 THEN 'notes' || o_orderkey || '.jsonl' WHEN 3 THEN 'sub/00000000-0000-0000-0000-' || lpad(o_orderkey::VARCHAR, 12, '0') || '.jsonl' ELSE 'agent-' || o_orderkey || '.meta.json' END AS rest,
         floor(o_totalprice)::BIGINT AS length FROM orders)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of files, one for each order: main transcripts, side ones, and others."""
    key = F.col("o_orderkey").cast("string")
    main = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(key, 12, "0"), F.lit(".jsonl"))
    kind = F.col("o_orderkey") % 5
    rest = (
        F.when(kind == 0, main).when(kind == 1, F.concat(F.lit("x/sub/agent-"), key, F.lit(".jsonl"))).when(kind == 2, F.concat(F.lit("notes"), key, F.lit(".jsonl")))
        .when(kind == 3, F.concat(F.lit("sub/"), main)).otherwise(F.concat(F.lit("agent-"), key, F.lit(".meta.json")))
    )
    path = F.concat(F.lit("file:/data/"), F.lit("p"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), rest)
    return _table(spark, sf_dir, "orders").select(path.alias("path"), F.floor("o_totalprice").cast("long").alias("length"))


@query(f"WITH {FILES_SQL} SELECT folder, rest AS session_key, length, k % 5 = 1 AS is_sidechain FROM files WHERE k % 5 IN (0, 1)")
def transcript_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many listed files are transcripts, and their keys."""
    return source_records.transcript_sources(_files(spark, sf_dir), "/data").select("folder", "session_key", "length", "is_sidechain")


CUSTOMERS_SQL = """
places AS (SELECT c_custkey, n_nationkey, '/' || r_name || '/' || n_name AS nation, '/' || r_name || '/' || n_name || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '/c' || c_custkey END AS cwd
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
gone AS (SELECT '/' || r_name || '/' || n_name AS prefix FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)
"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A folder for each customer below nation and region, and the nations that are excluded."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("nation", F.concat_ws("/", F.lit(""), "r_name", "n_name"))
    own = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("/c"), F.col("c_custkey").cast("string")))
    places = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "nation", F.concat("nation", own).alias("cwd"))
    return places, n.where("n_nationkey % 3 = 0").select(F.concat("nation", F.lit("/")).alias("prefix"))


@query(f"WITH {CUSTOMERS_SQL} SELECT c_custkey, cwd FROM places WHERE NOT EXISTS (SELECT 1 FROM gone WHERE cwd = prefix OR starts_with(cwd, prefix || '/'))")
def excluded_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: folders under no excluded one."""
    places, gone = _places(spark, sf_dir)
    return source_records.exclude_projects(places, gone).select("c_custkey", "cwd")


@query(
    f"""WITH {CUSTOMERS_SQL}, f AS (SELECT c_custkey, regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g') AS folder FROM places),
g AS (SELECT regexp_replace(prefix, '[^A-Za-z0-9]', '-', 'g') AS name FROM gone)
SELECT c_custkey, folder FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE folder = name OR starts_with(folder, name || '-'))"""
)
def excluded_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded folder names under no excluded path."""
    places, gone = _places(spark, sf_dir)
    return source_records.exclude_folders(places.select("c_custkey", source_records.folder_name(F.col("cwd")).alias("folder")), gone)


@query(
    f"""WITH {CUSTOMERS_SQL}, v AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE nation END AS project, CASE WHEN c_custkey % 3 = 0 THEN cwd END AS pre_worktree FROM places),
x AS (SELECT prefix FROM gone UNION ALL SELECT cwd FROM places WHERE c_custkey % 6 = 0)
SELECT c_custkey, project, pre_worktree FROM v WHERE NOT EXISTS (SELECT 1 FROM x WHERE prefix = project) AND NOT EXISTS (SELECT 1 FROM x WHERE prefix = pre_worktree)"""
)
def visible_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows neither of whose keys is excluded; null keys stay."""
    places, gone = _places(spark, sf_dir)
    rows = places.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("nation")).alias("project"), F.when(F.col("c_custkey") % 3 == 0, F.col("cwd")).alias("pre_worktree"))
    hidden = gone.select(F.rtrim(F.col("prefix"), F.lit("/")).alias("project")).unionByName(places.where("c_custkey % 6 = 0").select(F.col("cwd").alias("project")))
    return search.visible(rows, hidden)


@query(
    """WITH o AS (SELECT 'o' || o_custkey || '/agent-' || o_orderkey AS k, o_orderkey FROM orders)
SELECT k || '.jsonl' AS session_key, CASE WHEN o_orderkey % 3 = 0 THEN 'b' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'a' || o_orderkey END AS meta FROM o"""
)
def sidecar_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text beside each side transcript; of two the first path wins."""
    name = F.concat(F.lit("o"), F.col("o_custkey").cast("string"), F.lit("/agent-"), F.col("o_orderkey").cast("string"))
    o = _table(spark, sf_dir, "orders").select(name.alias("k"), "o_orderkey")
    beside = lambda first: F.concat(F.lit(first), F.col("o_orderkey").cast("string"))
    meta = lambda rows, first, path: rows.select(F.concat("k", F.lit(".meta.json")).alias("session_key"), F.lit(path).alias("path"), beside(first).cast("binary").alias("content"))
    files = meta(o.where("o_orderkey % 3 = 1"), "a", "/1").unionByName(meta(o.where("o_orderkey % 3 = 1"), "c", "/2")).unionByName(meta(o.where("o_orderkey % 3 = 0"), "b", "/2"))
    return source_records.attach_meta(o.select(F.concat("k", F.lit(".jsonl")).alias("session_key")), files)


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, 20 + (floor(o_totalprice)::BIGINT % 10000) AS n FROM orders)
SELECT o_orderkey::VARCHAR AS session_key, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN n + 2 > 8192 THEN n + 2 END AS elided, o_orderkey % 3 <> 0 AND n + 2 <= 8192 AS whole FROM o"""
)
def reduced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beyond 8,192 bytes become a note of their size; a note stays as it is."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey"), (20 + F.floor("o_totalprice").cast("long") % 10000).cast("int").alias("n"))
    result = F.when(F.col("o_orderkey") % 3 == 0, F.lit('{"elidedBytes":0}')).otherwise(F.concat(F.lit('"'), F.repeat(F.lit("x"), F.col("n")), F.lit('"')))
    recs = o.select(F.col("o_orderkey").cast("string").alias("session_key"), F.concat(F.lit('{"type":"user","toolUseResult":'), result, F.lit("}")).alias("line"))
    done = redact.reduce_records(recs)
    return done.select("session_key", F.get_json_object("line", "$.toolUseResult.elidedBytes").cast("long").alias("elided"), F.get_json_object("line", "$.toolUseResult").startswith("x").alias("whole"))


@query("""SELECT o_orderkey::VARCHAR AS session_key, CASE WHEN o_orderkey % 2 = 0 THEN '[redacted]' ELSE o_clerk END AS api_key, o_clerk AS clerk FROM (SELECT o_orderkey, 'C' || o_custkey AS o_clerk FROM orders)""")
def redacted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values under secret names in tool input are replaced, those elsewhere stay."""
    clerk = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    given = F.struct(clerk.alias("api_key"), clerk.alias("clerk"))
    line = F.when(
        F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), given.alias("input"))).alias("content")).alias("message")))
    ).otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), given.alias("other"))).alias("content")).alias("message"))))
    done = redact.redact_records(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session_key"), line.alias("line")))
    at = lambda key: F.coalesce(*[F.get_json_object("line", f"$.message.content[0].{part}.{key}") for part in ("input", "other")])
    return done.select("session_key", at("api_key").alias("api_key"), at("clerk").alias("clerk"))


@query(
    """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations),
t AS (SELECT conv_id, n, n % 5 = 2 AND conv_id % 2 = 0 AS own, CASE WHEN n % 5 = 3 THEN ' ' WHEN n % 5 = 2 AND conv_id % 2 = 0 THEN 'own ' || n ELSE 'made ' || n END AS title FROM c)
SELECT conv_id::VARCHAR AS session_key, arg_max(title, n + CASE WHEN own THEN 1000000 ELSE 0 END) AS title, bool_or(own) AS is_custom FROM t WHERE trim(title) <> '' GROUP BY conv_id"""
)
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the last title of each session; a generated one never replaces a custom one."""
    conv = source_records.records_from_table(_table(spark, sf_dir, "conversations").withColumn("place", F.struct("turn", "role", "text")), "conv_id", "place", "text")
    n, own = F.col("line_no"), (F.col("line_no") % 5 == 2) & (F.col("session_key").cast("long") % 2 == 0)
    name = lambda word: F.concat(F.lit(word), n.cast("string"))
    line = F.when(own, F.to_json(F.struct(name("own ").alias("customTitle")))).otherwise(F.to_json(F.struct(F.when(n % 5 == 3, " ").otherwise(name("made ")).alias("aiTitle"))))
    return records.session_titles(conv.withColumn("line", line))


@query(f"WITH {EVENTS_SQL} SELECT session_key, turn_seq, 'cargo test ' || cwd || '/' || file AS command FROM typed WHERE tool_name = 'Bash'")
def bash_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines of all tool calls."""
    return records.commands(_turns(spark, sf_dir)).select("session_key", "turn_seq", "command")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Ship order ' || o_orderkey WHEN 1 THEN 'Fix  ' || o_orderkey WHEN 2 THEN 'Drop' || o_orderkey WHEN 3 THEN 'Pack ' || o_orderkey END AS subject
FROM orders WHERE o_orderkey % 6 < 4"""
)
def commit_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of commits, by every spelling of a message."""
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 6
    command = (
        F.when(kind == 0, F.concat(F.lit('git commit -a -m "Ship order '), k, F.lit('" && git push'))).when(kind == 1, F.concat(F.lit("git -C /r commit --message 'Fix  "), k, F.lit("'")))
        .when(kind == 2, F.concat(F.lit("/usr/bin/git commit --message=Drop"), k, F.lit(" -q"))).when(kind == 3, F.concat(F.lit("git commit -m \"$(cat <<'EOF'\n\n  Pack "), k, F.lit("  \nmore\nEOF\n)\"")))
        .when(kind == 4, F.concat(F.lit("git log "), k)).otherwise(F.concat(F.lit("cargo test -m "), k))
    )
    return records.commit_subjects(_table(spark, sf_dir, "orders").select("o_orderkey", command.alias("command"))).select("o_orderkey", "subject")


@query(f"WITH {EVENTS_SQL} SELECT session_key, turn_seq FROM typed WHERE tool_name = 'Read' AND record_type = 'assistant' AND ts >= '2024-01-10T00:00:00.000Z' AND ts <= '2024-01-20T23:59:59.999Z'")
def filtered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns of one tool and kind between two days."""
    return _turns(spark, sf_dir).where(search.SearchFilters(tool="Read", record_type="assistant", since="2024-01-10", until="2024-01-20").condition()).select("session_key", "turn_seq")


@query(
    """SELECT 'o' || o_custkey || '/x/agent-' || o_orderkey || '.jsonl' AS session_key, CASE WHEN o_custkey % 3 <> 0 THEN 'o' || o_custkey || '.jsonl' END AS parent_key FROM orders"""
)
def sidecar_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript whose folder holds each side transcript."""
    name = F.concat(F.lit("o"), F.col("o_custkey").cast("string"))
    o = _table(spark, sf_dir, "orders")
    sides = o.select(F.concat(name, F.lit("/x/agent-"), F.col("o_orderkey").cast("string"), F.lit(".jsonl")).alias("session_key"))
    return sessions.sidecar_parents(sides.unionByName(o.where("o_custkey % 3 <> 0").select(F.concat(name, F.lit(".jsonl")).alias("session_key")).distinct()))


@query("SELECT o_orderkey AS session_key, least(floor(o_totalprice)::BIGINT, 50000 + o_orderkey % 1000) AS byte_offset FROM orders WHERE o_orderkey % 5 <> 0")
def repaired_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks beyond what is stored are lowered, those of unknown sessions go."""
    o = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "session_key")
    marks = o.select("session_key", F.floor("o_totalprice").cast("long").alias("byte_offset"))
    return sessions.repair_watermarks(marks, o.where("session_key % 5 <> 0").select("session_key", (50000 + F.col("session_key") % 1000).alias("stored")))


@query(
    """WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS n, 40000 + o_orderkey % 7 AS held FROM orders WHERE o_orderkey % 4 <> 0)
SELECT k AS session_key, CASE WHEN n < held THEN 'shorter' ELSE 'changed' END AS reason FROM o WHERE n < held OR k % 9 = 0"""
)
def diverged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are shorter than, or differ in, what was archived of them."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_key"), F.floor("o_totalprice").cast("long").alias("length"))
    digest = F.md5(F.col("session_key").cast("string").cast("binary"))
    archive = o.where("session_key % 4 <> 0").select("session_key", (40000 + F.col("session_key") % 7).alias("length"), digest.alias("prefix_hash"))
    found = sessions.diverged(o.withColumn("prefix_hash", F.when(F.col("session_key") % 9 == 0, "x").otherwise(digest)), archive)
    return found.select("session_key", "reason")


@query("SELECT o_orderkey AS run_id, o_custkey AS sessions, round(o_totalprice, 2) AS seconds FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with the highest number."""
    return sessions.last_run(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("sessions"), F.round("o_totalprice", 2).alias("seconds")))


@query(f"WITH {EVENTS_SQL} SELECT user_id AS session_no, session_key, project, turn_count, CASE WHEN user_id % 2 = 0 THEN 'T' || user_id END AS title FROM meta JOIN (SELECT DISTINCT session_key, user_id FROM typed) USING (session_key)")
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in the order of their numbers, with titles."""
    meta = _meta(spark, sf_dir)
    numbered = meta.select("session_key", F.col("session_key").cast("long").alias("session_no"))
    titles = numbered.where("session_no % 2 = 0").select("session_key", F.concat(F.lit("T"), "session_key").alias("title"))
    return sessions.list_sessions(meta, numbered, titles).select("session_no", "session_key", "project", "turn_count", "title")


@query(f"WITH {EVENTS_SQL} SELECT session_key, turn_count FROM meta WHERE project = '/r2'")
def observation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of one project."""
    return sessions.list_observations(_meta(spark, sf_dir), "/r2").select("session_key", "turn_count")


@query(f"WITH {EVENTS_SQL} SELECT session_key, turn_seq, CASE WHEN user_id % 4 = 0 THEN 'kept' ELSE uuid END AS uuid FROM typed")
def rebuilt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns made anew from the records, and the kept ones of sessions whose records are gone."""
    turns = _turns(spark, sf_dir).select("session_key", "turn_seq", F.lit("kept").alias("uuid"))
    recs = _records(spark, sf_dir).where("cast(session_key as int) % 4 <> 0")
    return sessions.rebuild(recs, lambda r: records.classify_turns(r).select("session_key", "turn_seq", "uuid"), turns)


@query(
    """WITH o AS (SELECT o_custkey AS decision_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS turn_id, CASE WHEN o_orderkey % 2 = 0 THEN 'hit' ELSE 'false positive' END AS label, o_orderkey FROM orders)
SELECT decision_id, turn_id, label FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.o_orderkey % 3 = 0 AND p.decision_id = o.decision_id AND p.turn_id IS NOT DISTINCT FROM o.turn_id AND p.label = o.label)"""
)
def appended_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are not recorded yet; a null turn equals a null turn."""
    o = _table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("decision_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("turn_id"), F.when(F.col("o_orderkey") % 2 == 0, "hit").otherwise("false positive").alias("label"), "o_orderkey")
    return recommend.append_labels(rows.drop("o_orderkey"), rows.where("o_orderkey % 3 = 0").drop("o_orderkey"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 AS r, 1700000000000 + o_orderkey * 1001 AS ms FROM orders)
SELECT 's' || k AS session_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, CASE WHEN k % 2 = 0 THEN k ELSE (SELECT max(c_custkey) FROM customer) END AS watermark_session_no FROM o WHERE r <> 3"""
)
def loaded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of decisions: excluded folders dropped, watermarks stamped, times as text."""
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(
            F.concat(F.lit("s"), k.cast("string")).alias("session_id"), (F.lit(1700000000000) + k * 1001).alias("at_ms"), F.lit("fix it").alias("prompt"),
            F.concat(F.lit("/r"), (F.col("o_custkey") % 10).cast("string"), F.lit("/src")).alias("cwd"), F.when(k % 2 == 0, k).alias("watermark_session_no"),
        )).alias("line")
    )
    log = o.unionByName(spark.range(1).select(F.lit("no json").alias("line")))
    stored_now = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_no"))
    return recommend.load_decisions(log, stored_now, spark.range(1).select(F.lit("/r3").alias("prefix"))).select("session_id", "ts", "watermark_session_no")


@query(
    f"""WITH {EVENTS_SQL}, a AS (SELECT session_key, user_id % 4 = 0 AS gone, user_id % 4 = 1 AS text_gone FROM typed)
SELECT 'records' AS name, count(*) FILTER (NOT gone AND NOT text_gone) AS rows FROM a UNION ALL SELECT 'turns', count(*) FILTER (NOT gone) FROM a
UNION ALL SELECT 'decisions', count(*) FROM meta WHERE session_key::INT % 8 <> 0"""
)
def retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of three tables once sessions are evicted or deleted."""
    turns = _turns(spark, sf_dir)
    meta = _meta(spark, sf_dir)
    n = F.expr("try_cast(session_key as int)")  # a twin's key is no number, and a join may carry a condition to its side
    # of every eighth deleted session another main file holds the same id
    twins = meta.where(n % 8 == 4).withColumn("session_key", F.concat(F.lit("twin"), "session_key"))
    selection = meta.where(n % 4 < 2).select("session_key", F.when(n % 4 == 0, "delete").otherwise("evict").alias("action"))
    tables = {"records": _records(spark, sf_dir).select("session_key"), "turns": turns.select("session_key"), "decisions": meta.select("session_id")}
    left = sessions.retention_apply(tables, selection, meta.unionByName(twins))
    made = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in left.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    f"""WITH {EVENTS_SQL},
t AS (SELECT session_key, list(turn_seq ORDER BY turn_seq DESC)[1:3] AS p FROM typed WHERE is_typed GROUP BY session_key),
r AS (SELECT session_key, max(turn_seq) AS newest_reply FROM typed WHERE record_type = 'assistant' GROUP BY session_key),
n AS (SELECT meta.*, p, newest_reply, row_number() OVER (PARTITION BY project ORDER BY last_turn_at DESC, session_key) AS r FROM meta JOIN t USING (session_key) LEFT JOIN r USING (session_key))
SELECT project, session_key, array_to_string(p, ',') AS prompts, newest_reply, (SELECT count(*) FROM n o WHERE o.project = n.project) AS sessions,
  (SELECT string_agg(session_key, ',' ORDER BY o.r) FROM n o WHERE o.project = n.project AND o.r BETWEEN 2 AND 6) AS other_sessions FROM n WHERE r = 1"""
)
def project_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where work stopped in each project."""
    turns = _turns(spark, sf_dir)
    made = sessions.project_digest(sessions.session_summary(_meta(spark, sf_dir), turns, records.extract_entities(turns)))
    return made.select("project", "session_key", F.array_join(F.col("prompts").cast("array<string>"), ",").alias("prompts"), "newest_reply", "sessions", F.array_join("other_sessions", ",").alias("other_sessions"))


# --- recommendation and feedback ----------------------------------------------

# BM25 over the bodies of all turns for the spellings of each prompt, then entity weights, then each row of the grid.
FEEDBACK_SQL = f"""{EVENTS_SQL},
tid AS (SELECT *, (user_id << 24) | turn_seq AS turn_id FROM typed),
ents AS (SELECT turn_id, kind, value FROM ent JOIN tid USING (session_key, turn_seq)),
body AS ({BODIES_SQL}),
words AS (SELECT (session_key::BIGINT << 24) | turn_seq AS turn_id, {WORDS.format('body')} AS w FROM body),
tf AS (SELECT turn_id, t, count(*) AS tf FROM (SELECT turn_id, unnest(w) AS t FROM words) GROUP BY ALL),
terms AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
weighed AS (
  SELECT turn_id, t, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) AS score FROM tf JOIN terms USING (t) JOIN words USING (turn_id), corpus),
prompt AS (
  SELECT turn_id AS query_id, session_id, ts, user_id << 24 AS before, cwd, file, name, unnest([cwd || '/' || file, file, name]) AS spelling FROM tid WHERE is_typed),
sets AS (SELECT spelling, unnest(w) AS t, len(w) AS need FROM (SELECT spelling, list_distinct({WORDS.format('spelling')}) AS w FROM (SELECT DISTINCT spelling FROM prompt))),
found AS (
  SELECT spelling, turn_id, sum(score) AS score FROM sets JOIN weighed USING (t) GROUP BY spelling, turn_id, need HAVING count(*) = need),
texts AS (SELECT query_id, turn_id, sum(score) AS text_score FROM prompt JOIN found USING (spelling) WHERE turn_id < before GROUP BY ALL),
pool AS (
  SELECT query_id, turn_id, text_score, tid.ts FROM texts JOIN tid USING (turn_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC, tid.ts DESC NULLS LAST, turn_id) <= 200),
asked AS (SELECT DISTINCT query_id, unnest({WORDS.format("cwd || '/' || file || ' Please fix ' || file || ' and ' || name")}) AS t FROM prompt),
known AS (SELECT kind, value, count(DISTINCT turn_id) AS df FROM ents GROUP BY ALL),
parts AS (SELECT kind, value, df, unnest(list_distinct(w)) AS t, len(list_distinct(w)) AS need FROM (SELECT *, {WORDS.format('value')} AS w FROM known)),
weights AS (
  SELECT query_id, kind, value, ln(1 + (SELECT count(*) FROM typed) / greatest(df, 1)) AS weight FROM parts JOIN asked USING (t) GROUP BY query_id, kind, value, df, need HAVING count(*) = need),
held AS (SELECT query_id, turn_id, sum(weight) AS entity_score, count(*) AS entity_count FROM pool JOIN ents USING (turn_id) JOIN weights USING (query_id, kind, value) GROUP BY ALL),
hits AS (
  SELECT query_id, turn_id, coalesce(entity_count, 0) AS entity_count,
    row_number() OVER (PARTITION BY query_id ORDER BY round(text_score + coalesce(entity_score, 0), 9) DESC, pool.ts DESC NULLS LAST, turn_id) AS rank
  FROM pool LEFT JOIN held USING (query_id, turn_id)),
grid(grid, ranked, co_occurring, max_turns) AS (VALUES (0, 3, 2, 3), (1, 1, 3, 1), (2, 10, 1, 5)),
chosen AS (
  SELECT grid, query_id, turn_id, place FROM (
    SELECT grid, query_id, turn_id, max_turns, row_number() OVER (PARTITION BY grid, query_id ORDER BY rank) AS place FROM hits JOIN tid USING (turn_id), grid
    WHERE rank <= 10 AND entity_count > 0 AND (rank <= ranked OR entity_count >= co_occurring) AND NOT (record_type = 'user' AND coalesce(is_typed, true) = false))
  WHERE place <= max_turns),
decided AS (SELECT DISTINCT query_id AS decision_id, session_id, ts FROM prompt JOIN meta USING (session_id) WHERE last_turn_at < '2024-01-30T18:00:00.000Z'),
given AS (SELECT query_id AS decision_id, turn_id, session_id, ts FROM chosen JOIN decided ON decision_id = query_id WHERE grid = 0),
used AS (SELECT session_id, kind, value, max(ts) AS last FROM ents JOIN tid USING (turn_id) WHERE kind IN ('path', 'symbol', 'error', 'command') GROUP BY ALL),
labels AS (
  SELECT decision_id, g.turn_id, CASE WHEN EXISTS (
    SELECT 1 FROM ents e JOIN used u USING (kind, value) WHERE e.turn_id = g.turn_id AND u.session_id = g.session_id AND u.last > g.ts) THEN 'hit' ELSE 'false positive' END AS label
  FROM given g),
sought AS (SELECT session_id, value, max(ts) AS last FROM ents JOIN tid USING (turn_id) WHERE ends_with(tool_name, '_recall_search') AND kind IN ('path', 'symbol') GROUP BY ALL),
missed AS (
  SELECT decision_id, min(spelling) AS detail FROM decided JOIN prompt ON query_id = decision_id JOIN sought ON sought.session_id = decided.session_id AND value = spelling AND last > decided.ts
  WHERE NOT EXISTS (SELECT 1 FROM given g JOIN ents e USING (turn_id) WHERE g.decision_id = decided.decision_id AND e.value = spelling) GROUP BY decision_id),
wasted AS (SELECT decision_id FROM labels GROUP BY decision_id HAVING count(*) FILTER (label = 'hit') = 0)
"""


def _prompts(turns: DataFrame) -> DataFrame:
    """Typed prompts; each may be given turns of sessions with a lower number only."""
    text = values.string_at("v", "$.message.content")
    t = _with_ids(turns.where("is_typed").withColumn("v", values.variant("line")).withColumn("text", text).withColumn("cwd", values.string_at("v", "$.cwd")))
    return t.select(
        F.col("turn_id").alias("query_id"), "text", "cwd", "session_key", F.col("ts"), F.concat(F.lit("s"), "session_key").alias("session_id"),
        F.shiftleft(F.col("session_key").cast("long"), 24).alias("before_turn_id"),
    )


@query(
    f"""WITH {EVENTS_SQL} SELECT (user_id << 24) | turn_seq AS query_id, cwd || '/' || file || '|' || file || '|' || name AS spellings FROM typed WHERE is_typed"""
)
def prompt_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each prompt names."""
    made = recommend.prompt_spellings(_prompts(_turns(spark, sf_dir)))
    return made.select("query_id", F.array_join("spellings", "|").alias("spellings"))


def _searchable(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, search.Index]:
    """What prompts are matched with: turns without their texts, entities beside their turn's session and time, how many turns hold each, and the index."""
    named = turns.withColumn("session_id", F.concat(F.lit("s"), "session_key"))
    listed = named.select("turn_id", "session_key", "ts", F.lit(False).alias("is_sidechain"), "record_type", "is_typed", "tool_name", "session_id")
    entities = stored(_with_ids(records.extract_entities(named, "session_id", "ts", "tool_name")).select("turn_id", "kind", "value", "session_id", "ts", "tool_name"), "entities")
    known = entities.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("df"))  # a turn's entities are distinct
    return listed, entities, known, search.build_index(turns.select("turn_id", "body", F.lit(0).alias("side"), "ts"))


def _decided(spark: SparkSession, sf_dir: str, closed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Prompts, turns, entities and judged hits; with ``closed`` only prompts of closed sessions are given any."""
    read = stored(records.with_texts(_with_ids(records.numbered_records(_records(spark, sf_dir)))), "records")
    turns = read.where("turn_seq is not null")
    prompts = _prompts(turns).withColumn("spellings", recommend.named_in())
    if closed:
        prompts = recommend.eligible_decisions(prompts, sessions.finalize_sessions(records.session_meta(read, None), NOW))
    prompts = stored(prompts, "prompts")
    listed, entities, known, index = _searchable(turns)
    hits = recommend.candidates(prompts, index, listed, entities, known=known)
    none = listed.select(F.col("turn_id").alias("query_id"), "turn_id").where("false")
    return prompts, listed, entities, recommend.refuse(hits, none, prompts.select("query_id", "session_key"), none.select("turn_id"))


DECIDED_SQL = FEEDBACK_SQL.replace("user_id << 24 AS before", "turn_id AS before") + """,
p AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY query_id) AS n, cnt > lag(cnt, 1, 0) OVER (PARTITION BY user_id ORDER BY query_id) AS owed FROM (
    SELECT turn_id AS query_id, user_id, turn_seq, turn_seq // 10 AS cnt, turn_seq // 10 * 10 - 1 AS b FROM tid WHERE is_typed)),
offered AS (
  SELECT query_id, list({t: hits.turn_id, own: t.user_id = p.user_id, fell: t.user_id = p.user_id AND t.turn_seq < b - 2} ORDER BY rank) AS l
  FROM hits JOIN p USING (query_id) JOIN tid t ON t.turn_id = hits.turn_id
  WHERE rank <= CASE WHEN owed THEN 50 ELSE 10 END AND entity_count > 0 AND (rank <= 3 OR entity_count >= 2) AND NOT (record_type = 'user' AND coalesce(is_typed, true) = false)
    AND (NOT owed OR (t.user_id = p.user_id AND t.turn_seq < b - 2)) GROUP BY query_id),
told AS (
  SELECT user_id + 5 AS user_id, list(turn_id) AS briefed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn_seq DESC) AS r FROM tid WHERE record_type = 'assistant') WHERE r <= 12 GROUP BY user_id),
steps AS (
  SELECT p.user_id, n, p.query_id, owed, coalesce(l, []) AS l, coalesce(briefed, []) AS briefed FROM p LEFT JOIN offered USING (query_id) LEFT JOIN told ON told.user_id = p.user_id),
run AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS query_id, false AS owed, [{t: 0::BIGINT, own: false, fell: false}][2:] AS l, [0::BIGINT][2:] AS briefed, [0::BIGINT][2:] AS given, [0::BIGINT][2:] AS chosen FROM p
  UNION ALL
  SELECT s.user_id, s.n, s.query_id, s.owed, s.l, s.briefed, list_concat(run.given, run.chosen),
    list_transform(list_filter(s.l, lambda x: NOT list_contains(list_concat(run.given, run.chosen), x.t) AND NOT (x.own AND NOT (s.owed AND x.fell)) AND NOT list_contains(s.briefed, x.t))[1:3], lambda x: x.t)
  FROM run JOIN steps s ON s.user_id = run.user_id AND s.n = run.n + 1),
looked AS (
  SELECT *, unnest(CASE WHEN len(chosen) = 3 THEN l[1:list_position(list_transform(l, lambda x: x.t), chosen[3])] ELSE l END) AS x FROM run),
verdicts AS (
  SELECT query_id, x.t AS turn_id, nullif(list_position(chosen, x.t), 0)::INTEGER AS place,
    CASE WHEN list_contains(given, x.t) THEN 'already given' WHEN x.own AND NOT (owed AND x.fell) THEN 'visible' WHEN list_contains(briefed, x.t) THEN 'carried by digest' END AS reason, owed AS compacted
  FROM looked)
"""


@query(f"WITH RECURSIVE {DECIDED_SQL} SELECT * FROM verdicts")
def decided_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11, R12, U3, U4, T4 as a batch: prompts of a session one after the other, with what each was refused and why."""
    turns = stored(records.with_texts(_with_ids(_turns(spark, sf_dir))), "turns")
    prompts = stored(_prompts(turns).withColumn("before_turn_id", F.col("query_id")), "prompts")
    listed, entities, known, index = _searchable(turns)
    hits = recommend.candidates(prompts, index, listed.drop("tool_name", "session_id"), entities, known=known, window=recommend.THRESHOLDS["compacted_window"])
    compactions = decide.boundary_turns(records.boundaries(_records(spark, sf_dir)), turns)
    arrived = decide.latest_boundary(prompts.select("query_id", "session_key", "session_id", F.col("query_id").alias("arrival")), compactions)
    # what a session was told at its start: the newest replies of the session before it in the same folder
    replies = turns.where("record_type = 'assistant'").withColumn("r", F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("turn_seq")))).where("r <= 12")
    briefed = replies.select(F.concat(F.lit("s"), (F.col("session_key").cast("long") + 5).cast("string")).alias("session_id"), "turn_id")
    made = decide.decide(decide.offers(hits, arrived), briefed)
    return made.select("query_id", "turn_id", "place", "reason", "compacted")


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 3, 2, 3), (1, 1, 3, 1), (2, 10, 1, 5)], "grid int, ranked int, co_occurring int, max_turns int")


@query(
    f"""WITH {FEEDBACK_SQL}
SELECT query_id, turn_id, place FROM chosen WHERE grid = 0"""
)
def recommended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns given to each prompt under the default thresholds."""
    *_, hits = _decided(spark, sf_dir)
    return recommend.choose(hits, _grid(spark).where("grid = 0")).select("query_id", "turn_id", "place")


def _labelled(spark: SparkSession, sf_dir: str):
    """Decisions of closed sessions and what they chose under every row of the grid."""
    prompts, turns, entities, hits = _decided(spark, sf_dir, closed=True)
    decisions = prompts.select(F.col("query_id").alias("decision_id"), "session_id", "ts", "spellings")
    chosen = stored(recommend.choose(hits, _grid(spark)), "chosen")
    injected = chosen.where("grid = 0").select(F.col("query_id").alias("decision_id"), "turn_id")
    return decisions, turns, entities, chosen, injected


@query(
    f"""WITH {FEEDBACK_SQL}
SELECT decision_id, turn_id, label FROM labels"""
)
def turn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a later turn used what was given."""
    decisions, turns, entities, _, injected = _labelled(spark, sf_dir)
    return recommend.label_turns(injected, decisions.drop("spellings"), turns, entities)


@query(
    f"""WITH {FEEDBACK_SQL}
SELECT decision_id, 'miss' AS label, detail FROM missed UNION ALL SELECT decision_id, 'wasted budget', NULL FROM wasted"""
)
def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses and wasted budgets."""
    decisions, turns, entities, _, injected = _labelled(spark, sf_dir)
    labels = recommend.label_turns(injected, decisions.drop("spellings"), turns, entities)
    miss = recommend.label_miss(decisions, injected, turns, entities)
    return miss.unionByName(recommend.label_waste(labels).withColumn("detail", F.lit(None).cast("string")))


@query(
    f"""WITH {FEEDBACK_SQL}
, c AS (SELECT chosen.* FROM chosen JOIN decided ON decision_id = query_id),
b AS (SELECT grid, query_id, turn_id FROM c WHERE grid = 0),
o AS (SELECT g.grid, query_id, turn_id FROM b, (SELECT DISTINCT grid FROM c) g),
j AS (SELECT coalesce(o.grid, c.grid) AS grid, o.turn_id IS NOT NULL AS was, c.turn_id IS NOT NULL AS now, label = 'hit' AS hit
  FROM o FULL JOIN c ON o.grid = c.grid AND o.query_id = c.query_id AND o.turn_id = c.turn_id
  LEFT JOIN labels ON decision_id = coalesce(o.query_id, c.query_id) AND labels.turn_id = coalesce(o.turn_id, c.turn_id))
SELECT grid, count(*) FILTER (was AND now) AS kept, count(*) FILTER (now AND NOT was) AS added, count(*) FILTER (was AND NOT now) AS removed,
  count(*) FILTER (was AND hit) AS hits_before, count(*) FILTER (was AND now AND hit) AS hits_kept FROM j GROUP BY grid"""
)
def threshold_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions under a grid of thresholds against the default ones."""
    decisions, turns, entities, chosen, injected = _labelled(spark, sf_dir)
    labels = recommend.label_turns(injected, decisions.drop("spellings"), turns, entities)
    return recommend.replay(chosen, labels, 0)


@query(
    f"""WITH {FEEDBACK_SQL},
c AS (SELECT DISTINCT grid, query_id AS decision_id, turn_id FROM chosen JOIN decided ON decision_id = query_id),
judged AS (
  SELECT grid, c.decision_id, EXISTS (
    SELECT 1 FROM ents e JOIN used u USING (kind, value) WHERE e.turn_id = c.turn_id AND u.session_id = d.session_id AND u.last > d.ts) AS hit
  FROM c JOIN decided d ON d.decision_id = c.decision_id),
counted AS (SELECT grid, decision_id, count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS f FROM judged GROUP BY ALL),
miss AS (
  SELECT DISTINCT g.grid, d.decision_id FROM decided d JOIN prompt ON query_id = d.decision_id JOIN sought ON sought.session_id = d.session_id AND value = spelling AND last > d.ts, (SELECT DISTINCT grid FROM c) g
  WHERE NOT EXISTS (SELECT 1 FROM c JOIN ents e USING (turn_id) WHERE c.grid = g.grid AND c.decision_id = d.decision_id AND e.value = spelling)),
every AS (
  SELECT g.grid, d.decision_id, coalesce(h, 0) AS h, coalesce(f, 0) AS f, (miss.decision_id IS NOT NULL)::INT AS m, (coalesce(h, 0) = 0 AND coalesce(f, 0) > 0)::INT AS w
  FROM decided d CROSS JOIN (SELECT DISTINCT grid FROM c) g LEFT JOIN counted ON counted.grid = g.grid AND counted.decision_id = d.decision_id LEFT JOIN miss ON miss.grid = g.grid AND miss.decision_id = d.decision_id),
sums AS (
  SELECT n.grid, sum(o.h) AS oh, sum(n.h) AS nh, sum(o.f) AS of, sum(n.f) AS nf, sum(o.m) AS om, sum(n.m) AS nm, sum(o.w) AS ow, sum(n.w) AS nw,
    count(*) FILTER (n.h <> o.h OR n.f <> o.f OR n.m <> o.m OR n.w <> o.w) AS changed FROM every n JOIN every o ON o.decision_id = n.decision_id AND o.grid = 0 GROUP BY n.grid)
SELECT grid, 'hit' AS label, oh::BIGINT AS before, nh::BIGINT AS after, changed FROM sums UNION ALL SELECT grid, 'false positive', of::BIGINT, nf::BIGINT, changed FROM sums
UNION ALL SELECT grid, 'miss', om::BIGINT, nm::BIGINT, changed FROM sums UNION ALL SELECT grid, 'wasted budget', ow::BIGINT, nw::BIGINT, changed FROM sums"""
)
def replay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels all decisions would have under each row of a grid, and how many decisions change."""
    decisions, turns, entities, chosen, _ = _labelled(spark, sf_dir)
    counts, changed = recommend.replay_labels(stored(recommend.relabelled(chosen, decisions, turns, entities), "relabels"), 0)
    number = changed.groupBy("grid").agg(F.count(F.lit(1)).alias("changed"))
    return counts.join(number, "grid", "left").fillna(0, ["changed"])


@query(
    f"""WITH {FEEDBACK_SQL}
, n AS (SELECT (SELECT count(*) FROM decided) AS decisions, (SELECT count(*) FROM given) AS injected, (SELECT count(DISTINCT decision_id) FROM given) AS fired,
  (SELECT count(*) FROM labels WHERE label = 'hit') AS hits, (SELECT count(*) FROM labels WHERE label <> 'hit') AS false_positives,
  (SELECT count(*) FROM missed) AS misses, (SELECT count(*) FROM wasted) AS wasted)
SELECT *, CASE WHEN hits + false_positives > 0 THEN round(hits / (hits + false_positives), 6) END AS precision FROM n"""
)
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of label counts and precision."""
    decisions, turns, entities, _, injected = _labelled(spark, sf_dir)
    labels = recommend.label_turns(injected, decisions.drop("spellings"), turns, entities)
    own = recommend.label_miss(decisions, injected, turns, entities).select("decision_id", "label").unionByName(recommend.label_waste(labels))
    return recommend.feedback_stats(decisions, injected, labels, own)


@query(f"WITH {FEEDBACK_SQL}, t AS (SELECT DISTINCT k, 'mod' || k AS t, '/r' || (k % 5) || '/' || file AS path FROM typed WHERE k IS NOT NULL)\n"
"""SELECT q AS query_id, turn_id, round(score, 6) AS score, rank FROM (
  SELECT q, turn_id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, tid.ts DESC, turn_id) AS rank
  FROM (SELECT t.k AS q, weighed.turn_id, score FROM t JOIN weighed USING (t) WHERE EXISTS (SELECT 1 FROM ents e WHERE e.turn_id = weighed.turn_id AND e.kind = 'path' AND e.value = t.path)) h JOIN tid USING (turn_id))
WHERE rank <= 50""")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for every file's word among the turns that name one path."""
    turns = _with_ids(_turns(spark, sf_dir))
    entities = _with_ids(records.extract_entities(turns)).select("turn_id", "kind", "value")
    bodies = _with_ids(records.turn_bodies(turns)).select("turn_id", "body")
    k = F.get_json_object("props", "$.k").cast("int")
    asked = _table(spark, sf_dir, "events").select(k.alias("query_id")).where("query_id is not null").distinct()
    text = asked.select("query_id", F.concat(F.lit("mod"), F.col("query_id").cast("string")).alias("text"))
    paths = asked.select("query_id", F.concat(F.lit("/r"), (F.col("query_id") % 5).cast("string"), F.lit("/src/mod"), F.col("query_id").cast("string"), F.lit(".rs")).alias("value"))
    listed = turns.select("turn_id", "ts", F.lit(False).alias("is_sidechain"))
    hits = search.search(text, search.build_index(stored(bodies, "bodies")), listed, stored(entities, "entities"), paths=paths)
    return hits.select("query_id", "turn_id", F.round("text_score", 6).alias("score"), "rank")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
