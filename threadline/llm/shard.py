"""Sharding by rendezvous hashing (operator 5): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

#: Hash bits of a draw; they fit a double exactly.
DRAW_BITS = 52


def _hex(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that depends on the key and the shard's index only."""
    h = _hex(F.md5(F.concat(key, F.lit("#"), shard.cast("string")).cast("binary")), DRAW_BITS // 4)
    return (h + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))


def shard_records(
    df: DataFrame, key: str, weights: list[float], grown_weight: float = 1.0, out: str = "shard"
) -> DataFrame:
    """Add ``out`` (int) and ``grown_<out>``: the shard with one more shard of ``grown_weight``.

    A key goes to the largest of -weight / ln(draw), so loads follow the weights,
    and a new shard takes rows only into itself.  A tie goes to the lower index.
    A null key counts as the empty string.  Equal keys share a shard; all other
    columns pass through.  There is no shuffle: every row is placed alone.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    n = len(weights)
    score = lambda i, w: -F.lit(float(w)) / F.log(draw(k, i))
    array = F.array(*[F.lit(float(w)) for w in weights])
    best = F.array_max(
        F.transform(array, lambda w, i: F.struct((-w / F.log(draw(k, i))).alias("score"), (-i).alias("shard")))
    )
    return (
        df.withColumn("__best", best)
        .withColumn(out, (-F.col("__best.shard")).cast("int"))
        .withColumn(
            f"grown_{out}",
            F.when(score(F.lit(n), grown_weight) > F.col("__best.score"), F.lit(n)).otherwise(F.col(out)).cast("int"),
        )
        .drop("__best")
    )


def place_records(
    df: DataFrame, key: str, text: str, weights: list[float], overhead: int = 16, buckets: int = 256
) -> DataFrame:
    """Shard, size and slot of every record.

    Returns ``<key>, size, text_crc32, law, shard, slot, grown_shard``.  ``size``
    is the text's UTF-8 bytes plus ``overhead`` (a null text has no bytes),
    ``slot`` numbers a shard's records from 0 without gaps: by a hash bucket of
    the key, then key, size and checksum.  Repeated rows get a slot each.  Only
    these few columns are shuffled, never the text; an empty table gives none.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = df.select(
        F.col(key), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    placed = materialize(shard_records(slim, key, weights), "shard")
    bucket = _hex(F.md5(k.cast("binary")), 4) % buckets
    ranked = gapless_rank(placed, ["shard"], bucket, [F.col(key).asc_nulls_first(), "size", "text_crc32"], "slot")
    return ranked.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
