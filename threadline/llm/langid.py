"""Language identification (operator 4): a byte convolutional network in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of a fixed
number of bytes, each filter's maximum is kept and a softmax layer reads the
maxima.  A document's class probabilities are the means over all its windows,
weighted by the bytes they hold.  Texts are lower-cased first.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tidy

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
WIDE = max(WIDTHS)
#: Windows that go through the network at once.
WINDOWS_AT_ONCE = 128
UNKNOWN = "und"
#: More labels than this are a mistake in the data, not languages.
MOST_LABELS = 400


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    """Parameters: byte embeddings, filters (as one matrix of the largest width) and the softmax layer."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.labels = labels
        self.mask = np.zeros((WIDE * EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (WIDE * EMBED, n)).astype(np.float32) * self.mask,
            "shift": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.2, (n, len(labels))).astype(np.float32),
            "bias": np.zeros(len(labels), np.float32),
        }

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x].reshape(len(x), -1)
        shape = (len(x), WINDOW - WIDE + 1, WIDE * EMBED)
        return np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], EMBED * 4, 4))

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches = self._patches(x)
        flat = np.ascontiguousarray(patches).reshape(-1, WIDE * EMBED)
        return (flat @ self.p["filters"]).reshape(len(x), WINDOW - WIDE + 1, -1), patches

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for a in range(0, len(x), WINDOWS_AT_ONCE):
            h = np.maximum(self._pooled(x[a : a + WINDOWS_AT_ONCE])[0].max(axis=1) + self.p["shift"], 0)
            z = h @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; only the winning place of each filter takes part."""
        responses, patches = self._pooled(x)
        rows = np.arange(len(x))
        best = responses.argmax(axis=1)
        raw = np.take_along_axis(responses, best[:, None], 1)[:, 0] + self.p["shift"]
        h = np.maximum(raw, 0)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[rows, y] -= 1
        z /= len(x)
        dh = (z @ self.p["out"].T) * (raw > 0)
        won = patches[rows[:, None], best]  # windows x filters x patch
        df = np.einsum("nf,nfp->pf", dh, won) * self.mask
        dp = (dh[:, :, None] * self.p["filters"].T[None]).reshape(len(x), -1, WIDE, EMBED)
        de = np.zeros((256, EMBED), np.float32)
        places = best[:, :, None] + np.arange(WIDE)
        np.add.at(de, x[rows[:, None, None], places], dp)
        return {"embed": de, "filters": df, "shift": dh.sum(0), "out": h.T @ z, "bias": z.sum(0)}

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels), **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as f:
            net = cls([str(x) for x in f["labels"]])
            net.p = {k: f[k] for k in net.p}
        return net


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Network:
    """Train by Adam with a falling rate, every class weighing the same through sampling."""
    rng, net = np.random.default_rng(seed), Network(labels, seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    of_class = [np.flatnonzero(y == k) for k in range(len(labels))]
    steps = max(100, epochs * len(x) // batch)
    for t in range(1, steps + 1):
        pick = np.array([rng.choice(of_class[k]) for k in rng.integers(0, len(labels), batch)])
        now = rate * (1 - 0.95 * t / steps)
        for k, g in net.gradients(x[pick], y[pick]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = net.p[k] - (now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train(df: DataFrame, key: str, text: str, lang: str, per_label: int = 1200, windows: int = 6) -> bytes | None:
    """Fit a network on a bounded sample and return it as bytes; None without a labelled row.

    The sample: of every label the ``per_label`` rows whose keys hash lowest, and
    of each row ``windows`` evenly spread windows.  Rows with a null text or label
    are not used.  The training runs in one task on that sample.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    ids = rows.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.xxhash64(key).alias("h"))
    # the slice of hashes in which each label's lowest end is found by counts, so that a label with most rows is no single task
    ids = ids.withColumn("part", F.shiftright("h", 54))
    counted = ids.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    last = counted.withColumn("before", before).where(F.col("before") < per_label).groupBy("lang").agg(F.max("part").alias("last"))
    picked = ids.join(F.broadcast(last), "lang").where("part <= last")  # a row for each label
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))
    picked = picked.withColumn("r", rank).where(F.col("r") <= per_label)
    picked = picked.select("k").distinct()
    sample = materialize(
        rows.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(picked), "k"), "langs"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, langs = [], []
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                every = windows_of(t.as_py().lower().encode())
                keep = np.unique(np.linspace(0, len(every) - 1, windows).astype(int))
                parts += [w.tobytes() for w in every[keep]]
                langs += [name] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array(langs, pa.string())], names=["w", "lang"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, langs = [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        if parts:
            labels = sorted(set(langs))
            if len(labels) > MOST_LABELS:
                raise ValueError(f"{len(labels)} labels")
            x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
            order = np.array(sorted(range(len(parts)), key=lambda i: (langs[i], parts[i])))  # windows come in any order
            y = np.array([labels.index(v) for v in langs])
            yield pa.RecordBatch.from_arrays([pa.array([fit(x[order], y[order], labels).save()], pa.binary())], names=["net"])

    got = sample.select("text", "lang").mapInArrow(tidy(cut), "w binary, lang string").repartition(1).mapInArrow(learn, "net binary").collect()
    return bytes(got[0][0]) if got else None


def predict(df: DataFrame, text: str, network: bytes | None, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its probability, from all windows of the text.

    A text that is null or has no letter, and any text when there is no network,
    gets ``und`` and 0.  All other columns pass through.
    """
    names = df.columns
    schema = T.StructType(list(df.schema)).add(lang_out, "string").add(score_out, "double")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(network) if network else None
        for batch in batches:
            n = batch.num_rows
            total = np.zeros((n, len(net.labels) if net else 1))
            known = np.zeros(n, bool)
            held: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            size = 0

            def flush() -> None:
                if held:
                    x, own = np.concatenate(held), np.concatenate(owners)
                    weight = (x != 0).sum(axis=1) + 1e-9
                    np.add.at(total, own, net.probabilities(x) * weight[:, None])
                held.clear()
                owners.clear()

            for k, cell in enumerate(batch.column(at) if net else ()):
                value = cell.as_py()
                if not value or not any(map(str.isalpha, value)):
                    continue
                known[k] = True
                every = windows_of(value.lower().encode())
                for a in range(0, len(every), 8192):
                    held.append(every[a : a + 8192])
                    owners.append(np.full(len(held[-1]), k))
                    size += len(held[-1])
                    if size >= 2048:
                        flush()
                        size = 0
            flush()
            share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
            best = share.argmax(axis=1)
            langs = [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            scores = [float(round(share[k, b], 6)) if known[k] else 0.0 for k, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def held_out(key: str, folds: int = 3, fold: int = 1):
    """Whether a row belongs to the fold that training never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled rows outside the held-out fold and predict every row."""
    network = train(df.where(~held_out(key)), key, text, lang)
    return predict(df.select(key, text, held_out(key).alias("held_out")), text, network).drop(text)


def keep_identified(df: DataFrame, network: bytes | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose language is one of the network's with a probability of at least ``least``."""
    found = predict(df, text, network, "__lang", "__score")
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).drop("__lang", "__score")
