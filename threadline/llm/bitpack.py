"""Token ids in fixed-width bit-packed files (operator 8).

A file holds whole documents in ascending key order::

    magic 'TLBP', version u16, bits u16, block u32, documents u32, ids u64
    blocks  u64 x (number of blocks + 1)   byte offset of each block in the body
    ends    u64 x documents                 ids up to and with each document
    body    blocks of ``block`` ids, each id in ``bits`` bits, low bit first

All integers are little-endian.  A block starts at a byte, so any range of ids
is read by unpacking only the blocks it touches.  Files are the rows of a
Parquet table (``file`` binary beside the range of keys), which every store that
Spark writes to can hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize

MAGIC, VERSION = b"TLBP", 1
HEADER = struct.Struct("<4sHHIIQ")
#: Ids in a block, and about as many ids in a file.
BLOCK, FILE_IDS = 4096, 1 << 20
#: Texts encoded together.
TEXTS_AT_ONCE = 512


class BadFile(ValueError):
    """The bytes are not a whole file of this format."""


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """The ids' low ``bits`` bits, one after the other."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def write_file(ids: np.ndarray, ends: list[int], bits: int, block: int = BLOCK) -> bytes:
    parts = [pack_ids(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.uint64)
    head = HEADER.pack(MAGIC, VERSION, bits, block, len(ends), len(ids))
    return b"".join([head, offsets.astype("<u8").tobytes(), np.array(ends, "<u8").tobytes(), *parts])


class Reader:
    """Random access to one file."""

    def __init__(self, data: bytes):
        if len(data) < HEADER.size:
            raise BadFile("no header")
        magic, version, self.bits, self.block, docs, self.n = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise BadFile("unknown magic or version")
        blocks, at = -(-self.n // self.block), HEADER.size
        self.body = at + 8 * (blocks + 1 + docs)
        if len(data) < self.body:
            raise BadFile("truncated tables")
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * (blocks + 1)).astype(np.int64)
        if len(data) != self.body + int(self.offsets[-1]) or (docs and int(self.ends[-1]) != self.n):
            raise BadFile("wrong length")
        self.data = data

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only the blocks that hold them."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            a, b = self.body + int(self.offsets[k]), self.body + int(self.offsets[k + 1])
            parts.append(unpack_ids(self.data[a:b], self.bits, min(self.block, self.n - k * self.block)))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(
    df: DataFrame, key: str, text: str, tokenizer: str, spaces: str, end_id: int, vocabulary: int, partitions: int,
    block: int = BLOCK, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending key order.

    Returns the stored table ``part, seq, keys, file``: files ``seq`` 0, 1, ... of
    a ``part`` follow each other, and parts follow each other in the order of
    their keys.  ``keys`` lists the keys of the file's documents.  A null text is
    empty, repeated rows are documents each (equal keys by a hash of the text), null keys come
    first.  The rows are range-partitioned by the key, so no task holds more
    than its range, and a task holds one file's ids at a time.
    """
    bits = bits_for(vocabulary)
    stop = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = encoder(tokenizer, spaces), TaskContext.get().partitionId()
        seq, keys, ends, held, n = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = write_file(np.frombuffer(b"".join(held), "<u4"), ends, bits, block)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["part", "seq", "keys", "file"],
            )

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(names), TEXTS_AT_ONCE):
                for name, ids in zip(names[a:], codes.encode_all(texts[a : a + TEXTS_AT_ONCE].to_pylist())):
                    keys.append(name)
                    held.append(ids + stop)
                    n += len(held[-1]) // 4
                    ends.append(n)
                    if n >= file_ids:
                        yield flush()
                        seq, keys, ends, held, n = seq + 1, [], [], [], 0
        if keys:
            yield flush()

    rows = (
        df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(partitions, F.col("key").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    )
    files = rows.mapInArrow(run, "part int, seq int, keys array<long>, file binary")
    return materialize(files, "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of the files: ``part, seq, key, at`` (ids of the file before it), ``ids`` (u32 little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, keys, data in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Reader(data)
                starts = [0, *reader.ends[:-1].tolist()]
                for a in range(0, len(keys), TEXTS_AT_ONCE):
                    span = range(a, min(a + TEXTS_AT_ONCE, len(keys)))
                    low, ids = starts[a], reader.ids(starts[a], int(reader.ends[span[-1]])).astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(span), pa.int32()), pa.array([seq] * len(span), pa.int32()),
                            pa.array([keys[k] for k in span], pa.int64()), pa.array([starts[k] for k in span], pa.int64()),
                            pa.array([ids[starts[k] - low : int(reader.ends[k]) - low].tobytes() for k in span], pa.binary()),
                        ],
                        names=["part", "seq", "key", "at", "ids"],
                    )

    return files.select("part", "seq", "keys", "file").mapInArrow(run, "part int, seq int, key long, at long, ids binary")


def file_starts(files: DataFrame) -> DataFrame:
    """``part, seq, file_start``: the ids of all files before each one, read from the headers.

    Totals of the parts (one per range, a number the writer's parameter bounds)
    are summed in key order; inside a part a window runs over its files.
    """
    count = sum(
        (F.conv(F.hex(F.substring("file", 17 + i, 1)), 16, 10).cast("long") * F.lit(256**i) for i in range(7)),
        F.lit(0).cast("long"),
    )
    sizes = files.select("part", "seq", count.alias("n"), F.element_at("keys", 1).alias("first"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"), F.min_by("first", "seq").alias("first"))
    order = Window.orderBy(F.col("first").asc_nulls_first(), "part")
    before = parts.withColumn("before", F.sum("total").over(order) - F.col("total")).select("part", "before")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    return (
        sizes.withColumn("inside", inside).join(F.broadcast(before), "part")
        .select("part", "seq", (F.col("before") + F.col("inside")).alias("file_start"))
    )


def token_documents(files: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids`` of every document, read back from the files."""
    docs, starts = read_token_files(files), file_starts(files)
    return docs.join(starts, ["part", "seq"]).select(
        "key", (F.col("file_start") + F.col("at")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"
    )


def document_digests(files: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids_crc32``: the digest of what :func:`token_documents` returns.

    The checksums are taken before the join with the files' starts, so ids are
    not shuffled.
    """
    docs = read_token_files(files).select(
        "part", "seq", "key", "at", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    return docs.join(file_starts(files), ["part", "seq"]).select(
        "key", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )

