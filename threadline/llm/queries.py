"""One registered query per operator of this package, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 40
SEQUENCE = 1024
MEDIA_BLOCK = 576
RUN_WORDS = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op3_dom_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract, train

    pages = _table(spark, sf_dir, "pages")
    model = train(pages, "page_id", "html")
    return extract(pages.select("page_id", "url", "html"), "html", model).withColumn("n_chars", F.length("text").cast("long"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard import place_records

    return place_records(_table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)


def op6_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    docs = _table(spark, sf_dir, "documents")
    packed = pack_documents(docs, "doc_id", "text", _vocabulary("byte_bpe_50k.json"), "attach", 0, SEQUENCE)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"
    )


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .media import media_features, with_png

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = materialize(with_png(docs, "text", MEDIA_BLOCK), "media")
    return media_features(stored)


def op8_bitpacked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitpack import document_digests, write_token_files

    docs = _table(spark, sf_dir, "documents")
    partitions = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = write_token_files(
        docs, "doc_id", "text", _vocabulary("word_bpe_49k.json"), "drop", end_id=1, vocabulary=49408, partitions=partitions
    )
    return document_digests(files).withColumnRenamed("key", "doc_id")


def op9_metric_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_classes

    return similarity_classes(_table(spark, sf_dir, "documents"))


def op10_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linedup import dedupe_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_lines(docs, min_words=RUN_WORDS)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_all

    return score_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_latent_decontamination, op2_markov_secrets, op3_dom_belief, op4_byte_cnn, op5_rendezvous_shards, op6_cutting_stock_packing, op7_png_media, op8_bitpacked_tokens, op9_metric_jaccard, op10_suffix_line_dedup, op11_importance_resampling, op12_nearest_toxicity, op13_source_divergence)}


#: crc32 of a text's UTF-8 bytes in SQL, byte by byte over the table of the reflected polynomial.
_CRC_TABLE = (
    "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), "
    "lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t)"
)
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
    "lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
)

OP5_SQL = f"""
WITH {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
         ({_CRC.format(text="coalesce(text, '')")})::BIGINT AS text_crc32, row_number() OVER () AS rid
  FROM documents, crc_table),
s AS (
  SELECT rid, i, -1.0 / ln((('0x' || substr(md5(k || '#' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM d, range(0, {SHARDS + 1}) AS r(i)),
b AS (
  SELECT rid, (arg_max(i, score) FILTER (i < {SHARDS}))::INTEGER AS shard, arg_max(i, score)::INTEGER AS grown_shard
  FROM s GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 4))::BIGINT % 256, doc_id, size, text_crc32) - 1 AS slot,
       grown_shard
FROM d JOIN b USING (rid)
"""


#: Later copies of line runs, by joins: every shortest run of enough words is spelled out and compared.
LINE_RUNS = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT *, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos,
         sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto
  FROM worded WHERE words > 0),
pairs AS (
  SELECT a.doc_id, a.pos AS s, b.pos AS e FROM numbered a JOIN numbered b
  ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + {RUN_WORDS} AND b.upto - a.upto + a.words >= {RUN_WORDS}),
runs AS (
  SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s
  UNION SELECT doc_id, max(s), e FROM pairs GROUP BY doc_id, e),
spelled AS (
  SELECT r.doc_id, s, e, string_agg(n.body, chr(10) ORDER BY n.pos) AS t
  FROM runs r JOIN numbered n ON n.doc_id = r.doc_id AND n.pos BETWEEN s AND e GROUP BY ALL),
firsts AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(s) OVER w AS first_at FROM spelled
  WINDOW w AS (PARTITION BY t ORDER BY doc_id, s)),
later AS (SELECT doc_id, s, e FROM firsts WHERE doc_id <> first_doc OR s > first_at + e - s),
gone AS (
  SELECT DISTINCT n.doc_id, n.pos, n.line, n.words FROM numbered n JOIN later l ON l.doc_id = n.doc_id AND n.pos BETWEEN l.s AND l.e),
islands AS (
  SELECT doc_id, min(line) AS a, max(line) AS b, count(*) AS c, sum(words) AS w
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
spans AS (
  SELECT doc_id, sum(c) AS c, sum(w) AS w, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans FROM islands GROUP BY doc_id),
rest AS (
  SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) AS text FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.doc_id = l.doc_id AND l.line BETWEEN i.a AND i.b) GROUP BY l.doc_id),
deduped AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
         coalesce(s.c, 0)::BIGINT AS removed_lines, coalesce(s.w, 0)::BIGINT AS removed_words, coalesce(s.removed_spans, '') AS removed_spans
  FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id)
"""
OP10_SQL = f"WITH {LINE_RUNS} SELECT * FROM deduped"

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every distinct run of up to three words gets its CRC byte by byte, once.
OP11_SQL = f"""
WITH {_CRC_TABLE},
texts AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id, {_LOWER.format("text")} AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, {_LOWER.format("text")} FROM benchmark),
split AS (SELECT side, rid, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, rid, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS g
  FROM split, range(1, 4) AS r(n) WHERE len(w) >= n),
counted AS (SELECT side, rid, g, count(*) AS c FROM grams GROUP BY ALL),
hashed AS (SELECT g, ({_CRC.format(text="g")}) % 10000 AS b FROM (SELECT DISTINCT g FROM counted), crc_table),
held AS (SELECT side, rid, b, sum(c)::BIGINT AS c FROM counted JOIN hashed USING (g) GROUP BY ALL),
sums AS (
  SELECT b, coalesce(sum(c) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(c) FILTER (side = 1), 0)::BIGINT AS t
  FROM (SELECT side, b, c FROM held UNION ALL SELECT 0, x, 0 FROM range(10000) AS r(x)) GROUP BY b),
gains AS (
  SELECT b, floor(1000.0::DOUBLE * ln((t::DOUBLE + 1) * ((sum(s) OVER ())::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain
  FROM sums),
weights AS (
  SELECT rid, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM held JOIN gains USING (b) WHERE side = 0 GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (rid) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r,
         count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed
"""

#: Shares of all groups and kept terms, spelled out and compared pair by pair.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, {_LOWER.format("text")} AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT f.lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (f.n + 2 * v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (total + 2)) // (l.n + 2 * v)::HUGEINT AS q
  FROM full_counts f JOIN langs l ON l.lang = f.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": OP11_SQL, "op13_source_divergence": OP13_SQL, "op5_rendezvous_shards": OP5_SQL, "op10_suffix_line_dedup": OP10_SQL}
