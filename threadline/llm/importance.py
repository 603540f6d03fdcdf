"""Importance resampling towards a target distribution (operator 11), on hashed n-gram counts.

Arrow kernels do the text work inside the tasks: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn a batch
into word numbers; shifted word numbers are pairs and triples, which are encoded
again so that the CRC is taken of distinct ones only.  A CRC of joined words
comes from the CRCs of its parts by the shift tables of the polynomial, so no
n-gram is ever spelled out.  Bucket counts are summed in every task; gains are
taken by bucket and summed by document.

A document's own state is a few numbers; texts are never shuffled.  Null and
empty texts have no features; rows of null keys draw noise for the empty key;
repeated rows are counted and drawn each for itself; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

#: What stands between words, once lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IS_GAP = np.ones(256, bool)
_IS_GAP[0x30:0x3A] = _IS_GAP[0x61:0x7B] = _IS_GAP[0x41:0x5B] = _IS_GAP[0x80:] = False
#: Longer texts are cut between words and go through the kernels in pieces.
PIECE_BYTES = 4 << 20
#: Longest word plus blank whose shift tables are kept.
KEPT_SHIFT = 64
GRAMS = 3


def _shift_tables(length: int) -> np.ndarray:
    """Four tables of 256 entries: what ``length`` further zero bytes make of each byte of a CRC."""
    # a CRC register after a zero byte: shifted by eight bits, then changed by the table of the byte that left
    basis = np.array([1 << k for k in range(32)], np.uint32)
    for _ in range(length):
        basis = (basis >> np.uint32(8)) ^ _BYTE[basis & np.uint32(255)]
    out = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for bit in range(8):
            out[part, (np.arange(256) >> bit) & 1 == 1] ^= basis[8 * part + bit]
    return out


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    return table


_BYTE = _byte_table()
_KEPT: list[np.ndarray] = []


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of ``a + b`` from those of ``a`` and ``b`` and the bytes of ``b``."""
    if not _KEPT:
        _KEPT.append(np.stack([_shift_tables(n) for n in range(KEPT_SHIFT)]))
    tables, out = _KEPT[0], np.empty(len(left), np.uint32)
    short = length < KEPT_SHIFT
    c, n = left[short], length[short]
    out[short] = tables[n, 0, c & 255] ^ tables[n, 1, (c >> 8) & 255] ^ tables[n, 2, (c >> 16) & 255] ^ tables[n, 3, c >> 24]
    for n in np.unique(length[~short]):
        at, own = length == n, _shift_tables(int(n))
        c = left[at]
        out[at] = own[0, c & 255] ^ own[1, (c >> 8) & 255] ^ own[2, (c >> 16) & 255] ^ own[3, c >> 24]
    return out ^ right


def _pieces(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: ``texts, row, carried``.

    A piece of a long text begins with the last words of the one before it,
    ``carried`` of them, so that no n-gram is lost at a cut.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size <= PIECE_BYTES)
    if len(rows):
        yield texts.take(pa.array(rows)) if len(rows) < len(texts) else texts, rows, np.zeros(len(rows), np.int64)
    for row in np.flatnonzero(size > PIECE_BYTES):
        data = texts[int(row)].as_py().encode()
        gaps = np.flatnonzero(_IS_GAP[np.frombuffer(data, np.uint8)])
        start, before = 0, b""
        while start < len(data):
            k = np.searchsorted(gaps, start + PIECE_BYTES)
            end = int(gaps[k]) if k < len(gaps) else len(data)
            words = before.split()
            piece = b" ".join([*words, data[start:end]])
            yield pa.array([piece.decode()]), np.array([row]), np.array([len(words)])
            # the last words: look back over enough gaps, however many of them stand together
            words, back = [], 1 << 12
            while True:
                tail = piece[-back:]
                words = "".join(chr(b) if not _IS_GAP[b] else " " for b in tail).split()
                if len(words) > GRAMS - 1 or back >= len(piece):
                    break
                back *= 4
            before = b" ".join(w.encode("latin-1") for w in words[len(words) - min(len(words), GRAMS - 1) :])
            start = end


def hashed_grams(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of texts in pieces: for each ``n`` ``owner row, bucket`` of every run of ``n`` words, ``n`` first.

    Yields ``(n, owner, bucket)`` with ``owner`` rising.
    """
    for piece, rows, carried in _pieces(texts):
        lists = pc.split_pattern_regex(pc.ascii_lower(piece), pattern=GAPS)
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)
        coded, owner = words.filter(real).dictionary_encode(), owner.filter(real).to_numpy(zero_copy_only=False)
        ids, spelled = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
        if not len(ids):
            continue
        alone = np.fromiter((zlib.crc32(w) for w in spelled), np.uint32, len(spelled))
        after = np.fromiter((zlib.crc32(b" " + w) for w in spelled), np.uint32, len(spelled))
        length = np.fromiter((len(w) + 1 for w in spelled), np.int64, len(spelled))
        # place of each word in its piece, to leave out what ended in the piece before
        first = np.searchsorted(owner, np.arange(len(rows)))
        fresh = np.arange(len(owner)) - first[owner] >= carried[owner]
        yield 1, rows[owner[fresh]], (alone % np.uint32(buckets))[ids[fresh]]
        codes, crc = ids, alone
        for n in range(2, GRAMS + 1):
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            last = ids[n - 1 :]
            key = pa.array(codes[: len(last)] * len(spelled) + last).dictionary_encode()
            codes, pairs = key.indices.to_numpy(zero_copy_only=False).astype(np.int64), key.dictionary.to_numpy(zero_copy_only=False)
            head, tail = np.divmod(pairs, len(spelled))
            crc = joined_crc(crc[head], after[tail], length[tail])
            use = inside & fresh[n - 1 :]
            yield n, rows[owner[n - 1 :][use]], (crc % np.uint32(buckets))[codes[use]]


def bucket_counts(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """``bucket, n``: features of all texts by bucket; each task sends one row for a bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in hashed_grams(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return df.select(F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` for every bucket: thousandths of the log ratio of smoothed shares, rounded down."""
    spark = raw.sparkSession
    counted = (
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    )
    sums = counted.agg(F.sum("s").alias("__s"), F.sum("t").alias("__t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1.0) * (d("__s") + float(buckets)) / ((d("s") + 1.0) * (d("__t") + float(buckets)))
    return counted.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))  # sums is one row


def weigh(df: DataFrame, key: str, text: str, gains: np.ndarray) -> DataFrame:
    """``key, n_words, n_features, weight`` of every row; ``gains`` has a number for each bucket."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for n, owner, bucket in hashed_grams(batch.column(1), buckets):
                if not len(owner):
                    continue
                at = np.flatnonzero(np.diff(owner, prepend=-1))  # a document's features stand together
                number = np.diff(at, append=len(owner))
                features[owner[at]] += number
                words[owner[at]] += number if n == 1 else 0
                weight[owner[at]] += np.add.reduceat(gains.take(bucket), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), f"key {kind}, n_words long, n_features long, weight long")


def gumbel(key: str, seed: int):
    """Noise of a key in thousandths: from 32 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked_from_the_top(scored: DataFrame, order: list, out: str) -> DataFrame:
    """Rank all rows of a table without a single task that sorts them.

    Rows are stored by ranges of ``order``; each range is ranked for itself and
    shifted by the rows of the ranges before it.
    """
    apart = materialize(scored.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = apart.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return apart.withColumn(out, place).join(F.broadcast(shift), "__part").withColumn(out, (F.col(out) + F.col("__shift")).cast("long")).drop("__part", "__shift")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42,
) -> DataFrame:
    """Draw ``percent`` of the documents with enough words, without replacement, by weight and Gumbel noise.

    Returns ``key, n_features, weight, score, rank`` for every row; ``rank`` is
    null for what is not drawn.  Ties go to the smaller key, null keys last.
    """
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets).collect():
        gains[bucket] = gain
    scored = materialize(weigh(docs, key, text, gains).withColumn("score", F.col("weight") + gumbel("key", seed)), "scored")
    fit = F.col("n_words") >= least_words
    share = max(0.0, 1 - 1.2 * percent / 100)
    n, guess = scored.where(fit).agg(F.count(F.lit(1)), F.percentile_approx("score", share, 1000)).first()
    drawn = percent * n // 100
    # rows that cannot be drawn are not ranked: the guess is tested, and dropped where it leaves too few
    above = fit & (F.col("score") >= F.lit(guess)) if drawn else F.lit(False)
    if drawn and scored.where(above).count() < drawn:
        above = fit
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("n_features"), F.asc("weight")]
    high = ranked_from_the_top(scored.where(above), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    low = scored.where(~above).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return high.select(*columns).unionByName(low.select(*columns))
