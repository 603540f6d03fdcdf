"""Secret scans (operator 2): rules and character Markov models, in DataFrame functions only.

Three rules find keyed assignments, access key ids and long hex strings.  Two
first-order Markov models over characters, one of random strings and one of
ordinary words and identifiers, add strings that are likelier under the first.
Every run of 12 or more characters of the alphabet is judged, with or without
digits.  A run in capitals only is judged by its small letters; a UUID is a name
and not a secret; a run of fewer than six different characters is not random.

Defined results: null texts are empty; null keys are keys of their own; repeated
rows get equal results; a table without texts is an empty result; other columns
are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

# The rules.  (kind, expression, group whose length counts, least length)
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same places of a text as the rule's with short matches left out, where that is the same thing.
FAST = {"access": r"AKIA[A-Z0-9]{14,}+", "hex": r"[0-9a-f]{16,}+"}
#: Candidates of the models: whole runs of 12 or more characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Ordinary words of six or more characters; long ones that mix letters and digits are not taught, as they may be secrets.
WORD, DOUBTFUL = r"[A-Za-z0-9+/_=-]{6,}", r"^(?=.*[0-9])(?=.*[A-Za-z]).{12,}$"
FEWEST_SYMBOLS = 6
#: Words of which ordinary identifiers, paths and file names are made up, to be taught beside the texts' own words.
IDENTIFIER_WORDS = (
    "get set user name id list item file path load save read write open close data base table row column index key value map node tree graph "
    "edge page view form field input output event handler listener manager factory builder service client server request response session "
    "token store cache queue task worker job thread pool lock state status error message log level config option setting default parse parser "
    "format string number count size length width height color image text line word char byte buffer stream reader writer update delete create "
    "insert select find search sort filter merge split join copy move test mock check verify validate abstract base proxy bean http api rest "
    "json xml html css main core util helper common shared module component package class type object array profile account order product "
    "customer report export import sync async start stop run init setup src lib bin"
).split()
MARKOV = "markov"
KINDS = [*(kind for kind, *_ in RULES), MARKOV]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1  # and one for all else
#: Weight of the single symbols' frequencies in a row of transitions, in counts.
BACK_OFF = 5.0


def _symbols(token: Column) -> Column:
    """Positions of a string's characters in the alphabet, 0 for others; a string in capitals counts as its small letters."""
    cased = F.when(token.rlike("^[A-Z]+$"), F.lower(token)).otherwise(token)
    return F.transform(F.split(cased, ""), lambda c: F.instr(F.lit(ALPHABET), c) * (c != "").cast("int"))


def _pairs(token: Column) -> Column:
    s = _symbols(token)
    return F.transform(
        F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: F.element_at(s, i + 1) * SYMBOLS + x
    )


def matches(rows: DataFrame, keys: list[str], text: str, kind: str, expression: str, group: int, least: int) -> DataFrame:
    """Leftmost non-overlapping matches: ``keys, kind, start, end, value``.

    Offsets count code points, the end is exclusive.  The pieces between the
    matches and the matches themselves are laid out in order, and a running sum
    of their lengths places them, so a text with very many matches stays cheap.
    """
    t = F.col(text)
    pieces = F.arrays_zip(
        F.transform(F.split(t, expression, -1), lambda g: F.length(g)).alias("gap"),
        F.regexp_extract_all(t, F.lit(expression), F.lit(0)).alias("match"),
        F.regexp_extract_all(t, F.lit(expression), F.lit(group)).alias("value"),
    )
    laid = rows.where(t.rlike(expression)).select(*keys, F.posexplode(pieces).alias("i", "piece")).where("piece.match is not null")
    end = F.sum(F.col("piece.gap") + F.length("piece.match")).over(Window.partitionBy(*keys).orderBy("i"))
    return (
        laid.withColumn("end", end).where(F.length("piece.value") >= least)
        .select(*keys, F.lit(kind).alias("kind"), (F.col("end") - F.length("piece.match")).alias("start"), "end", F.col("piece.value").alias("value"))
    )


def base_spans(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Spans of the three rules."""
    found = None
    for kind, expression, group, least in RULES:
        part = matches(rows, keys, text, kind, FAST.get(kind, expression), group, least)
        found = part if found is None else found.unionByName(part)
    return found


def markov_scores(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every pair of symbols, from labelled samples.

    ``samples`` has the columns ``token`` and ``random`` (boolean).  A
    transition seldom seen falls back on how common its second symbol is.  The table's size is fixed by the
    alphabet, so it is small enough for the driver whatever the samples hold.
    """
    pairs = samples.select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
    counted = pairs.groupBy("pair").agg(
        F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o")
    )
    got = {row[0]: (row[1], row[2]) for row in counted.collect()}
    table = [0.0] * (SYMBOLS * SYMBOLS)
    for model, sign in ((0, 1.0), (1, -1.0)):
        single = [0.5] * SYMBOLS
        for pair, n in got.items():
            single[pair % SYMBOLS] += n[model]
        whole = sum(single)
        for a in range(SYMBOLS):
            row = [got.get(a * SYMBOLS + b, (0, 0))[model] for b in range(SYMBOLS)]
            seen = sum(row) + BACK_OFF
            for b in range(SYMBOLS):
                table[a * SYMBOLS + b] += sign * log((row[b] + BACK_OFF * single[b] / whole) / seen)
    return table


def markov_ratio(token: Column, table: list[float]) -> Column:
    """A token's log-likelihood ratio: above 0 it is likelier a random string."""
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    return F.aggregate(_pairs(token), F.lit(0.0), lambda acc, p: acc + F.element_at(ratios, p + 1))


def looks_random(token: Column, table: list[float], threshold: float) -> Column:
    """Whether a candidate's ratio exceeds the threshold; a UUID or a run of few different characters never does."""
    varied = F.size(F.array_distinct(F.split(token, ""))) >= FEWEST_SYMBOLS
    return varied & ~token.rlike(UUID) & (markov_ratio(token, table) > threshold)


def identifiers(spark: SparkSession, number: int) -> DataFrame:
    """``token``: names in the usual manners of writing, of two to five of ``IDENTIFIER_WORDS``, some with a number."""
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    pick = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", i), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    turn = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    rows = spark.range(number).withColumn("w", F.transform(F.sequence(F.lit(1), (turn("n", 4) + 2).cast("int")), pick))
    camel = F.transform("w", lambda w: F.initcap(w))
    first = F.concat(F.array(F.element_at("w", 1)), F.slice(camel, 2, 9))
    abbreviated = F.concat(F.array(F.upper(F.element_at("w", 1))), F.slice(camel, 2, 9))
    camel = F.when(turn("u", 4) == 0, abbreviated).otherwise(camel)
    form, digits = turn("form", 5), F.when(turn("d", 5) < 2, turn("v", 1000).cast("string"))
    written = F.when(form == 0, F.concat_ws("_", "w", digits)).when(form == 1, F.concat_ws("-", "w", digits)).when(form == 2, F.concat_ws("", camel, digits))
    return rows.select(written.when(form == 3, F.concat_ws("", first, digits)).otherwise(F.concat(F.concat_ws("/", "w"), F.coalesce(digits, F.lit("")))).alias("token"))


def labelled_samples(docs: DataFrame, key: str, text: str, spans: DataFrame, rows: int = 2000, strings: int = 4000) -> DataFrame:
    """Labelled tokens for the models, bounded by ``rows`` and ``strings``.

    Random: values of the rules' matches, and digests written in hex and in
    base 64.  Ordinary: words of six or more characters in the texts of the
    ``rows`` records whose texts hash lowest, of records in which no rule matches,
    and six times ``strings`` identifiers.
    """
    spark = docs.sparkSession
    # the rows of the sample are found from hashes alone; only theirs are read whole, those of null keys among them
    ids = docs.select(F.xxhash64(text, key).alias("k")).orderBy("k").limit(rows).distinct()
    clean = F.lit(True)
    for kind, expression, _, _ in RULES:
        clean = clean & ~F.col(text).rlike(FAST.get(kind, expression))
    words = (
        docs.join(F.broadcast(ids), F.xxhash64(docs[text], docs[key]) == ids["k"]).where(clean)
        .select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("token")).where(~F.col("token").rlike(DOUBTFUL))
    )
    values = spans.select(F.col("value").alias("token")).distinct().orderBy(F.xxhash64("token"), "token").limit(strings)
    made = spark.range(strings).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    hexes = made.select(F.substring("h", 1, 40).alias("token"))
    base = made.select(F.substring(F.base64(F.unhex("h")), 1, 40).alias("token"))
    random = values.unionByName(hexes).unionByName(base)
    return words.unionByName(identifiers(spark, 6 * strings)).withColumn("random", F.lit(False)).unionByName(random.withColumn("random", F.lit(True)))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 10.0) -> DataFrame:
    """Secrets in every text: counts of the rules' kinds, a digest of their spans, and all spans.

    Returns a row per record: ``<key>, n_assign, n_access, n_hex, n_markov,
    base_sha256, spans``.  A null text is empty.  Repeated rows (equal key and
    text) are scanned once and get the same result each.  The models add the
    candidates that exceed the threshold (in nats) and overlap no rule's span.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    keys = ["key", "row"]
    hit = F.lit(False)
    for kind, expression, _, _ in RULES:
        hit = hit | F.col("text").rlike(FAST.get(kind, expression))
    suspects = materialize(rows.where(hit).dropDuplicates(keys), "suspects")
    base = materialize(base_spans(suspects, keys, "text"), "spans")
    table = markov_scores(labelled_samples(docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))), key, text, base))
    judged = F.exists(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda v: looks_random(v, table, threshold))
    found = rows.where(judged).dropDuplicates(keys)  # few texts hold any, so few are laid out
    more = matches(found, keys, "text", MARKOV, CANDIDATE, 0, 12).where(looks_random(F.col("value"), table, threshold))
    both = base.unionByName(more).withColumn("rule", F.col("kind") != MARKOV)
    order = Window.partitionBy(*keys).orderBy("start", F.desc("rule"), "end")
    before = F.max(F.when(F.col("rule"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(*keys).orderBy(F.desc("start"), "rule", F.desc("end"))
    after = F.min(F.when(F.col("rule"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = both.withColumn("free", free).where(F.col("rule") | F.col("free"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    span = F.struct("start", rank.cast("int").alias("rank"), "end")
    of = lambda k: F.count(F.when(F.col("kind") == k, 1))
    found = kept.groupBy(*keys).agg(
        *[of(k).alias(f"n_{k}") for k in KINDS],
        _written(F.collect_list(F.when(F.col("rule"), span))).alias("base"),
        _written(F.collect_list(span)).alias("spans"),
    )
    all_rows = rows.select(*keys)
    joined = all_rows.join(
        found.withColumnsRenamed({"key": "k2", "row": "r2"}), (F.col("key").eqNullSafe(F.col("k2"))) & (F.col("row") == F.col("r2")), "left"
    )
    return joined.select(
        F.col("key").alias(key),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
