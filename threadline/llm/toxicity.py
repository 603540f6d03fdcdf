"""Toxicity (operator 12): votes of the nearest labelled examples, found through a block-max inverted index.

Examples are a bounded sample of labelled rows.  Terms that tell the labels
apart (by the likelihood ratio of their document counts) span the space, with
one more dimension for all other words, so that a telling word in a long text
differs from one in a short text; a text is its TF-IDF vector over them, of
length one, and examples are compared by cosine.  The index keeps, for every term, its postings by block of examples and
the largest weight in each block: the sum of a query's products with these
maxima bounds every cosine in the block, so blocks are opened from the highest
bound down and the search ends, exactly, at the first bound below the last of
the nearest found so far.  Neighbours vote with their cosine; the share of the
vote is calibrated on the examples themselves, each left out of its own search.

Texts are read once and never shuffled: the index is bounded by the sample and
goes to every task.  A text without any of the terms has no neighbour and gets
the rate of examples that have none.  Null and empty texts are such texts; rows
of null keys are scored but cannot be learned from, as labels are joined by key;
of repeated keys one text is learned, the smallest; without labels all scores
are 0.  Other columns of both tables are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy
from .langid import held_out

#: What stands between terms, once lower-cased: anything but letters.
GAPS = r"[^\p{L}]+"
BLOCK, FIRST_BLOCKS = 16, 4
NEIGHBOURS = 15
#: The term that stands for every word that tells nothing; as a word it cannot occur.
REST = ""
#: Score from which a text counts as toxic.
TOXIC = 0.7


def text_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms of a batch and, for every place of a term, ``row, term`` as two columns."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=GAPS)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    return coded.dictionary, np.stack([owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)])


class BlockMaxIndex:
    """Labelled unit vectors by blocks of ``BLOCK``; exact nearest neighbours by cosine.

    ``postings`` are ``example, term, weight`` in order of (term, example);
    ``keys`` and ``labels`` are by example, ``votes`` what each vote weighs.
    """

    def __init__(self, terms: list[str], idf: np.ndarray, keys: np.ndarray, labels: np.ndarray, votes: np.ndarray, example: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.terms, self.idf, self.keys, self.labels, self.votes = terms, idf, keys, labels, votes
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(example, weight**2, len(keys)))
        order = np.lexsort((example, term))
        self.example, self.term = example[order], term[order]
        self.weight = weight[order] / norm[self.example]
        # one entry for each (term, block): where its postings begin, and the largest weight
        at = np.flatnonzero(np.diff(self.term * (len(keys) // BLOCK + 1) + self.example // BLOCK, prepend=-1)) if len(order) else np.zeros(0, np.int64)
        self.begin, self.end = at, np.append(at[1:], len(order))
        self.block = self.example[at] // BLOCK
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.of_term = np.searchsorted(self.term[at], np.arange(len(terms) + 1))
        self.calibration: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
        self.opened = 0

    def _cosines(self, entries: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples in the postings of some entries, and the sums of products."""
        size = self.end[entries] - self.begin[entries]
        place = np.repeat(self.begin[entries] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        ids, where = np.unique(self.example[place], return_inverse=True)
        return ids, np.bincount(where, np.repeat(mine, size) * self.weight[place], len(ids))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples nearest to a unit vector and their cosines, best first; ties to the earlier example.

        The blocks of the highest bounds are opened first; of the others only
        those whose bound reaches the last of the nearest found so far.
        """
        entries = [np.arange(self.of_term[t], self.of_term[t + 1]) for t in term]
        if not sum(map(len, entries)):
            return np.zeros(0, np.int64), np.zeros(0)
        at, mine = np.concatenate(entries), np.repeat(weight, [len(e) for e in entries])
        bound = np.bincount(self.block[at], mine * self.most[at], len(self.keys) // BLOCK + 1)
        ids, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        first = np.zeros(len(bound), bool)
        first[np.argpartition(-bound, min(FIRST_BLOCKS, len(bound)) - 1)[:FIRST_BLOCKS]] = True
        for chosen in (first, ~first):
            chosen = chosen & (bound > 0) & (bound >= least - 1e-9)
            self.opened += int(chosen.sum())
            use = chosen[self.block[at]]
            more, found = self._cosines(at[use], mine[use])
            keep = more != but
            ids, sims = np.append(ids, more[keep]), np.append(sims, found[keep])
            best = np.lexsort((ids, -np.round(sims, 9)))[:k]
            ids, sims = ids[best], sims[best]
            least = sims[-1] if len(ids) == k else 0.0
        return ids, sims

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """Share of the votes for label 1; -1 without a neighbour."""
        weight = sims * self.votes[ids]
        return float((weight * self.labels[ids]).sum() / weight.sum()) if len(ids) else -1.0

    def calibrate(self, k: int) -> None:
        """Fit how often label 1 is true at a share of the votes: pooled neighbours that rise, with one doubtful example each side."""
        by_example = np.argsort(self.example, kind="stable")
        cut = np.searchsorted(self.example[by_example], np.arange(len(self.keys) + 1))
        raw = np.array([self.vote(*self.nearest(self.term[p], self.weight[p], k, but=x)) for x, p in ((x, by_example[cut[x] : cut[x + 1]]) for x in range(len(self.keys)))])
        pools: list[list[float]] = []
        for share in np.unique(np.round(raw, 2)):
            here = np.round(raw, 2) == share
            pools.append([share, float(self.votes[here].sum()), float((self.votes * self.labels)[here].sum())])
            while len(pools) > 1 and pools[-1][0] >= 0 and pools[-2][0] >= 0 and pools[-1][2] * pools[-2][1] <= pools[-2][2] * pools[-1][1]:
                _, n, y = pools.pop()
                pools[-1][1] += n
                pools[-1][2] += y
        rate = float((self.votes * self.labels).sum() / max(self.votes.sum(), 1e-9))
        self.calibration = (np.array([p[0] for p in pools] or [-1.0]), np.array([(p[2] + rate) / (p[1] + 1) for p in pools] or [0.0]))

    def score(self, share: float) -> float:
        starts, rates = self.calibration
        if share < 0 and starts[0] >= 0:
            return float((self.votes * self.labels).sum() / max(self.votes.sum(), 1e-9))
        return float(rates[max(0, np.searchsorted(starts, round(share, 2) + 1e-9, side="right") - 1)])

    def save(self) -> bytes:
        out = io.BytesIO()
        fields = {n: getattr(self, n) for n in ("idf", "keys", "labels", "votes", "example", "term", "weight", "begin", "end", "block", "most", "of_term")}
        np.savez(out, terms=np.array(self.terms, dtype=str), starts=self.calibration[0], rates=self.calibration[1], **fields)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BlockMaxIndex:
        index = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            index.__dict__.update({n: f[n] for n in f.files if n not in ("terms", "starts", "rates")}, terms=[str(t) for t in f["terms"]], calibration=(f["starts"], f["rates"]), opened=0)
        return index


def sample_examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int) -> DataFrame:
    """``key, text, label, vote``: of each label the ``per_label`` keys that hash lowest, with what each stands for.

    Labels are picked before any text is read; a key labelled twice takes the
    larger label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi").withColumn("h", F.xxhash64("k")).withColumn("part", F.shiftright("h", 54))
    known = materialize(known, "labelled")
    # the slice of hashes in which each label's lowest end is found by counts: no label is one task
    counted = known.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("y").orderBy("part")) - F.col("n")
    last = counted.withColumn("before", before).where(F.col("before") < per_label).groupBy("y").agg(F.max("part").alias("last"))
    all_of = counted.groupBy("y").agg(F.sum("n").alias("all"))
    near = known.join(F.broadcast(last), "y").where("part <= last")  # a row for each label
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "k"))).where(F.col("r") <= per_label).select("k", "y")
    share = all_of.join(picked.groupBy("y").agg(F.count(F.lit(1)).alias("taken")), "y").select("y", (F.col("all") / F.col("taken")).alias("vote"))
    picked = picked.join(F.broadcast(share), "y")
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "k")  # two labels, per_label rows each
    return texts.groupBy("k", "y", "vote").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 3000, least_docs: int = 3, least_gain: float = 15.0, least_lift: float = 4.0, most_terms: int = 5000,
) -> bytes | None:
    """Index a bounded sample of labelled rows and return it as bytes; None without any.

    Bounds: ``per_label`` examples of each label and ``most_terms`` terms, those
    that tell the labels apart best: at least by ``least_gain``, so that it is no
    chance, and ``least_lift`` times as frequent under one label as under the
    other, so that words of a language or a topic do not crowd the space.
    """
    examples = materialize(sample_examples(docs, labels, key, text, label, per_label), "examples")
    about = examples.select("k", "y", "vote").orderBy("k").collect()  # per_label rows of each label
    if not about:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, places = text_terms(batch.column(2))
            if not places.size:
                continue
            pair, times = np.unique(places[0] * len(terms) + places[1], return_counts=True)
            row, term = np.divmod(pair, len(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), terms.take(pa.array(term)), pa.array(times.astype(np.int64))], names=["k", "y", "term", "n"])

    kind = examples.schema["k"].dataType.simpleString()
    counts = materialize(examples.select("k", "y", "text").mapInArrow(tidy(count), f"k {kind}, y int, term string, n long"), "example_terms")
    n1 = sum(r["y"] for r in about)
    n0 = len(about) - n1
    held = counts.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    part = lambda seen, share: F.when(F.expr(seen) > 0, F.expr(seen) * F.log(F.expr(seen) / F.expr(share))).otherwise(0.0)
    n = n0 + n1
    gain = 2 * (part("a", f"(a + b) * {n1} / {n}") + part("b", f"(a + b) * {n0} / {n}") + part(f"{n1} - a", f"({n} - a - b) * {n1} / {n}") + part(f"{n0} - b", f"({n} - a - b) * {n0} / {n}"))
    lift = F.abs(F.log((F.col("a") + 0.5) / (n1 + 1) / ((F.col("b") + 0.5) / (n0 + 1)))) >= math.log(least_lift)
    telling = held.where((F.col("a") + F.col("b") >= least_docs) & lift).withColumn("gain", F.round(gain, 6)).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "term").limit(most_terms)
    terms = [(REST, n), *sorted((r["term"], r["a"] + r["b"]) for r in telling.collect())]
    number, place = {t: i for i, (t, _) in enumerate(terms)}, {r["k"]: i for i, r in enumerate(about)}
    tells = counts.join(F.broadcast(telling.select("term", F.lit(True).alias("tells"))), "term", "left")
    tells = tells.groupBy("k", F.when(F.col("tells"), F.col("term")).otherwise(REST).alias("term")).agg(F.sum("n").alias("n"))
    # an example without a telling term says nothing of what a term means
    rows = tells.join(tells.where(F.col("term") != REST).select("k").distinct(), "k", "left_semi").collect()
    example, term, times = (np.array(v, np.int64) for v in ([place[r["k"]] for r in rows], [number[r["term"]] for r in rows], [r["n"] for r in rows]))
    idf = np.array([math.log(1 + n / d) for _, d in terms])
    # examples of the same heaviest term and density stand together, so that the maxima of a block are tight
    heavy, dense = np.full(len(about), -1), np.zeros(len(about))
    by_weight = np.argsort((1 + np.log(times)) * idf[term] * (term > 0), kind="stable")
    heavy[example[by_weight]] = term[by_weight]
    dense[example[term == 0]] = times[term == 0]
    order = np.lexsort((dense, heavy))
    example, about = np.argsort(order)[example], [about[i] for i in order]
    index = BlockMaxIndex([t for t, _ in terms], idf, np.array([str(r["k"]) for r in about]), np.array([float(r["y"]) for r in about]), np.array([float(r["vote"]) for r in about]), example, term, times.astype(float))
    index.calibrate(NEIGHBOURS)
    return index.save()


def score(df: DataFrame, key: str, text: str, index: bytes | None, evidence: int = 3) -> DataFrame:
    """``key, score, evidence`` for every row: the calibrated vote, and the nearest examples as ``key:cosine:label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BlockMaxIndex.load(index) if index else None
        spelled = pa.array(model.terms, pa.string()) if model else None
        for batch in batches:
            scores, near = np.full(batch.num_rows, model.score(-1.0) if model else 0.0), [""] * batch.num_rows
            if model:
                # few texts hold a telling term: only their places are counted
                terms, places = text_terms(batch.column(1))
                known = pc.index_in(terms, spelled).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
                term = known[places[1]] if len(terms) else known
                tells = np.zeros(batch.num_rows, bool)
                tells[places[0][term >= 0]] = True
                held = tells[places[0]]
                pair, times = np.unique(places[0][held] * len(spelled) + np.maximum(term[held], 0), return_counts=True)
                row, term = np.divmod(pair, len(spelled))
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(cut, np.append(cut[1:], len(row))):
                    weight = (1 + np.log(times[a:b])) * model.idf[term[a:b]]
                    ids, sims = model.nearest(term[a:b], weight / np.sqrt((weight**2).sum()), NEIGHBOURS)
                    scores[row[a]] = model.score(model.vote(ids, sims))
                    near[row[a]] = ",".join(f"{model.keys[i]}:{s:.4f}:{int(model.labels[i])}" for i, s in zip(ids[:evidence], sims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.round(scores, 6), 0.0, 1.0)), pa.array(near, pa.string())], names=["key", "score", "evidence"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"key {kind}, score double, evidence string")


def score_all(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", **bounds: float) -> DataFrame:
    """Learn from labelled rows outside the held-out fold and score every row.

    Returns ``key, held_out, score, predicted, evidence``.
    """
    index = train(docs.where(~held_out(key)), labels, key, text, label, **bounds)
    scored = score(docs, key, text, index)
    return scored.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
