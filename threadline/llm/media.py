"""Media columns (operator 7): lossless PNG in binary columns, and cosine-transform hashes.

A PNG file here is 8-bit greyscale.  The writer picks for every image row the
filter None, Sub or Up with the smallest sum of absolute residuals; the reader
takes all five filters.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREYSCALE = 0
#: Image rows whose transform is computed at once; bounds the memory of long payloads.
ROWS_AT_ONCE = 4096
#: Side of the square of low frequencies that make the hash.
LOW = 8


class BadMedia(ValueError):
    """The stored bytes are not an intact PNG of the kind written here."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int, level: int = 6) -> bytes:
    """A PNG of ``width`` samples a row; the payload must fill whole rows."""
    if not payload or len(payload) % width:
        raise BadMedia("payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    options = np.stack([rows, sub, up])
    cost = np.minimum(options, 0 - options).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = options[kind, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, GREYSCALE, 0, 0, 0)
    data = zlib.compress(lines.tobytes(), level)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters; runs of rows of one vectorisable filter are undone together."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    height, width = out.shape
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for a, b in zip(starts, [*starts[1:], height]):
        kind = kinds[a]
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * width
                left = corner = 0
                row = out[y].tolist()
                for x in range(width):
                    if kind == 3:
                        guess = (left + above[x]) // 2
                    else:
                        p = left + above[x] - corner
                        guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                        corner = above[x]
                    left = row[x] = (row[x] + guess) & 255
                out[y] = row
        elif kind:
            raise BadMedia(f"unknown filter {kind}")
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """The samples (height x width) of a PNG, after testing every chunk's checksum."""
    if stored[:8] != SIGNATURE:
        raise BadMedia("no PNG signature")
    at, data, header, ended = 8, [], None, False
    while at < len(stored):
        if at + 12 > len(stored):
            raise BadMedia("truncated chunk")
        (size,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if at + 12 + size > len(stored) or struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise BadMedia(f"chunk {kind!r} fails its checksum")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if header is None or not ended or header[2:] != (8, GREYSCALE, 0, 0, 0):
        raise BadMedia("not an 8-bit greyscale PNG")
    width, height = header[:2]
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width + 1):
        raise BadMedia("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(LOW), np.arange(n) + 0.5)).astype(np.float32)


_BY_WIDTH: dict[int, np.ndarray] = {}


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest frequencies lie above their median.

    The constant term takes no part in the median.  Long images are transformed
    in blocks of rows, so memory stays bounded.
    """
    height, width = samples.shape
    across = _BY_WIDTH.setdefault(width, _cosines(width))
    low = np.zeros((LOW, LOW), np.float64)
    step = np.pi / height
    for a in range(0, height, ROWS_AT_ONCE):
        part = samples[a : a + ROWS_AT_ONCE].astype(np.float32) @ across.T
        y = np.arange(a, a + len(part)) + 0.5
        low += np.cos(step * np.outer(np.arange(LOW), y)) @ part
    flat = low.ravel()
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


MEDIA = "payload_bytes long, media binary"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_png(df: DataFrame, column: str, block: int, fill: int = 255, width: int | None = None) -> DataFrame:
    """Append ``n_bytes`` and ``media``: the column's UTF-8 bytes as a PNG.

    ``column`` may be string or binary; null counts as empty.  The bytes are
    filled up with ``fill`` to a positive multiple of ``block``, a row of the
    image being ``width`` (``block`` if not given) samples.  Other columns pass
    through; columns named ``n_bytes`` or ``media`` are replaced.
    """
    width = width or block
    if block % width:
        raise ValueError("block must be a multiple of width")
    kept = df.drop("n_bytes", "media") if column not in ("n_bytes", "media") else df
    body = F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))
    if column not in ("n_bytes", "media"):
        kept = kept.drop(column)
    names = kept.columns
    source = df.select(*[F.col(f"`{n}`") for n in names], body.alias("__body"))
    schema = kept.schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for cell in batch.column(len(names)):
                data = cell.as_py()
                sizes.append(len(data))
                full = max(block, -(-len(data) // block) * block)
                media.append(encode_png(data.ljust(full, bytes([fill])), width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                names=[*names, "n_bytes", "media"],
            )

    return source.mapInArrow(run, schema)


def media_features(df: DataFrame, column: str = "media", tail: int = 32) -> DataFrame:
    """Replace a column of PNG bytes by what is computed from the decoded samples.

    Adds ``payload_bytes, payload_sha256, tail_crc32`` (of the last ``tail``
    samples), ``media_bytes, media_sha256`` (of the stored bytes) and
    ``feature``, the cosine hash.  Damaged bytes raise ``BadMedia``; a null cell
    gives nulls.
    """
    names = [n for n in df.columns if n != column]
    schema = df.drop(column).schema
    for field in FEATURES.split(", "):
        schema = schema.add(*field.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(len(names)):
                stored = cell.as_py()
                if stored is None:
                    rows.append((None,) * 6)
                    continue
                samples = decode_png(stored)
                payload = samples.tobytes()
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples),
                ))
            made = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *[pa.array(list(v), k) for v, k in zip(made, kinds)]],
                names=[*names, *[f.split(" ")[0] for f in FEATURES.split(", ")]],
            )

    return df.select(*[F.col(f"`{n}`") for n in names], F.col(column)).mapInArrow(run, schema)
