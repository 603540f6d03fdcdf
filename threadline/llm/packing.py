"""Packing token sequences (operator 6): cutting stock by column generation.

Documents are cut into pieces of at most ``capacity`` tokens.  The pieces'
lengths, rounded up to bins, form a histogram; a linear program over patterns
(which bins share one sequence) finds how many sequences of each pattern to
make, and a knapsack over the program's prices proposes its columns.  The
histogram and the program have a size that ``capacity / bin_width`` bounds, so
the driver solves them; the pieces themselves never leave the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import gapless_rank, materialize, tidy

TEXTS_AT_ONCE = 512


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if n:
            worth = best[c - sizes[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], last[c] = worth[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 2e-3, steps: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{size: copies}`` and how often to use each, covering the demand exactly.

    Column generation by the revised simplex method, until the knapsack finds no
    better column or the program is within ``gap`` of sequences without padding; the solution is rounded down and
    what remains is packed largest first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    columns = np.diag(capacity // sizes).astype(float)
    for k, other in enumerate(np.searchsorted(sizes, capacity - sizes)):  # start from pairs that fill a sequence
        if k < other < len(sizes) and sizes[k] + sizes[other] == capacity:
            rare, common = (k, other) if need[k] <= need[other] else (other, k)
            columns[rare, rare] = columns[common, rare] = 1
    scale = 1 / np.diag(columns)
    inverse = 2 * np.diag(scale) - scale[:, None] * columns * scale  # what is off the diagonal squares to nothing
    amount = np.maximum((inverse * need).sum(axis=1), 0)
    least = float((need * sizes).sum()) / capacity
    for _ in range(steps):
        if amount.sum() <= (1 + gap) * least:
            break
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(prices, sizes, capacity)
        if value <= 1 + gap:
            break
        direction = (inverse * pattern).sum(axis=1)
        ratio = np.where(direction > 1e-9, amount / np.maximum(direction, 1e-9), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[:, out] = pattern
    times = np.floor(amount + 1e-6)
    left = (need - (columns * times).sum(axis=1)).astype(int)
    while (left < 0).any():  # rounding noise: use one sequence less
        k = int(np.argmax(columns[int(np.argmin(left))] * (times > 0)))
        times[k] -= 1
        left = (need - (columns * times).sum(axis=1)).astype(int)
    plan = [({int(s): int(a) for s, a in zip(sizes, columns[:, k]) if a}, int(times[k])) for k in np.flatnonzero(times)]
    while left.any():
        room, pattern = capacity, {}
        for k in range(len(sizes) - 1, -1, -1):
            n = min(int(left[k]), room // int(sizes[k]))
            if n:
                pattern[int(sizes[k])] = n
                room -= n * int(sizes[k])
        often = min(int(left[np.searchsorted(sizes, s)]) // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[np.searchsorted(sizes, s)] -= n * often
        plan.append((pattern, often))
    return plan


def cut_documents(
    df: DataFrame, key: str, text: str, tokenizer: str, spaces: str, end_id: int, capacity: int = 1024, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: ``<key>, start, length, ids_crc32, doc_tokens`` and, on request, ``ids``.

    A document is its text's ids (a null text has none) and ``end_id``; all its
    pieces but the last have ``capacity`` ids.
    """
    stop = np.array([end_id], "<u4").tobytes()
    schema = df.select(key).schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, width = encoder(tokenizer, spaces), 4 * capacity
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(a, TEXTS_AT_ONCE)
                docs, starts, lengths, sums, totals, pieces = [], [], [], [], [], []
                for k, ids in enumerate(codes.encode_all(part.column(1).to_pylist())):
                    ids += stop
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        docs.append(k)
                        starts.append(at // 4)
                        lengths.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        totals.append(len(ids) // 4)
                        if with_ids:
                            pieces.append(piece)
                made = [part.column(0).take(pa.array(docs, pa.int32())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
                yield pa.RecordBatch.from_arrays([*made, pa.array(pieces, pa.binary())][: len(schema)], names=schema.names)

    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(tidy(run), schema)


def assign_pieces(pieces: DataFrame, key: str, capacity: int = 1024, bin_width: int = 4, buckets: int = 256) -> DataFrame:
    """Put stored pieces into sequences: adds ``sequence_id``, ``offset`` and ``padded_length``.

    Pieces are ranked inside their length bin (by key, start and checksum within
    hash buckets); the rank says which pattern, which of its sequences and which
    place.  A sequence is padded to ``capacity``, or not at all if its length is
    a power of two.
    """
    if capacity % bin_width:
        raise ValueError("capacity must be a multiple of bin_width")
    binned = pieces.withColumn("__bin", F.ceil(F.col("length") / bin_width).cast("int"))
    histogram = {r[0]: r[1] for r in binned.groupBy("__bin").count().collect()}  # capacity / bin_width rows at most
    plan = cutting_stock(histogram, capacity // bin_width)
    table: dict[int, list] = {}
    base = 0
    used: dict[int, int] = {}
    for pattern, times in plan:
        for size, copies in pattern.items():
            table.setdefault(size, []).append((used.get(size, 0), copies, base))
            used[size] = used.get(size, 0) + copies * times
        base += times
    table = {size: np.array(rows, np.int64).T for size, rows in table.items()}
    ranked = gapless_rank(
        binned, ["__bin"], F.pmod(F.xxhash64(key, "start"), F.lit(buckets)), [F.col(key).asc_nulls_first(), "start", "ids_crc32"], "__rank"
    )
    names = ranked.columns
    schema = T.StructType(list(ranked.schema)).add("sequence_id", "long").add("__slot", "long")
    at_bin, at_rank = names.index("__bin"), names.index("__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column(at_bin).to_numpy(), batch.column(at_rank).to_numpy()
            seq, slot = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
            for size in np.unique(bins):
                rows = np.flatnonzero(bins == size)
                first, copies, start = table[int(size)]
                k = np.searchsorted(first, ranks[rows], "right") - 1
                inside = ranks[rows] - first[k]
                seq[rows], slot[rows] = start[k] + inside // copies[k], inside % copies[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(slot)], names=[*names, "sequence_id", "__slot"])

    placed = ranked.mapInArrow(place, schema)
    whole = Window.partitionBy("sequence_id")
    order = whole.orderBy(F.desc("__bin"), "__slot")
    total = F.sum("length").over(whole)
    return (
        placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
        .withColumn("padded_length", F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(capacity)).cast("long"))
        .drop("__bin", "__rank", "__slot")
    )


def pack_documents(
    df: DataFrame, key: str, text: str, tokenizer: str, spaces: str, end_id: int, capacity: int = 1024, bin_width: int = 4,
    with_ids: bool = False,
) -> DataFrame:
    """Cut, rank and pack all documents.

    Null texts count as empty, repeated rows are documents each, an empty table
    gives no piece.  ``with_ids`` keeps the pieces' ids in the result.
    """
    pieces = materialize(cut_documents(df, key, text, tokenizer, spaces, end_id, capacity, with_ids), "pieces")
    return assign_pieces(pieces, key, capacity, bin_width)
