"""Benchmark decontamination (operator 1): latent semantic retrieval, then sequence checks.

Passages are windows of words, weighed by TF-IDF over hashed terms; the document
frequencies cover every record.  A randomised SVD of every text and every passage
of every item, summed up over partitions by blocks of terms, gives the latent space.
Every window of every text is compared with every benchmark item, and with every
passage of an item, by their cosine in that space; what of an item the space does
not hold counts by a fixed share, so that it holds any number of items.  Runs of
words in common with an item are looked up as well.  Candidates must then share a
long enough common subsequence of words with the item and hold the words of its
last part, the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import Workspace, tidy

TERMS, TERM_BLOCK = 1 << 14, 256
WINDOW, STRIDE = 32, 8
RANK, OVERSAMPLE, POWER = 200, 8, 1
#: What all texts, all items and one item weigh in the SVD at most, in passages: many texts do not outweigh few items.
TEXTS_WEIGH, ITEMS_WEIGH, ITEM_WEIGHS = 8000.0, 8000.0, 4.0
#: Rows and words of a block that is multiplied at once.
BLOCK_PASSAGES, BLOCK_WORDS = 64, 1 << 14
#: Columns of the first, random basis that a term has a sign in.
SIGNS = 4
#: Vectors of items and of their passages that are searched for at once.
ASKED_AT_ONCE = 512
#: Weight of what the latent space does not hold.
OUTSIDE = 0.5
#: Cosine of a candidate; share of an item's words in a common subsequence; share of the answer's words.
COSINE, COMMON, ANSWER = 0.3, 0.6, 0.5
#: Items shorter than this must occur whole, word after word.
SHORT = 8
#: Sums of a block of words with an item that are held at once; words of texts that are searched together.
CELLS, WORDS_AT_ONCE = 1 << 20, 1 << 15
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytes(32 if not (chr(c).isalnum() or c > 127) else c for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-cased words, ASCII punctuation being white space."""
    words = (text or "").lower().encode().translate(_TABLE).split()
    return np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << k)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def hashed_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, tag, words``: each text's word hashes, packed; the tag tells texts of one key apart."""
    named = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(cell.as_py()).tobytes() for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["doc", "tag", "words"])

    return named.mapInArrow(tidy(run), named.drop("text").schema.add("words", "binary"))


def term_weights(words: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all hashed terms, from every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for cell in batch.column(0):
                df[np.unique(np.frombuffer(cell.as_py(), np.uint32) % TERMS)] += 1
                n += 1
        df[TERMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "n"])

    rows = words.select("words").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 at most
    df = np.zeros(TERMS + 1)
    for term, n in rows:
        df[term] = n
    return np.log((1 + df[TERMS]) / (1 + df[:TERMS])).astype(np.float32) + np.float32(0.1)


def _passage_rows(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of unit length: row, term and value of each word."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    term = np.concatenate([p % TERMS for p in passages]).astype(np.int64) if passages else np.empty(0, np.int64)
    both, back = np.unique(row * TERMS + term, return_inverse=True)
    tf = np.bincount(back)
    row, term = both // TERMS, both % TERMS
    value = tf * idf[term]
    norm = np.sqrt(np.bincount(row, value * value, len(passages)))
    return row, term, (value / np.maximum(norm[row], 1e-9)).astype(np.float32)


def random_signs(width: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random basis: SIGNS columns of each term and its sign in each, both terms x SIGNS."""
    rng = np.random.default_rng(0)
    return rng.integers(0, width, (TERMS, SIGNS)), rng.choice(np.array([-1, 1], np.float32), (TERMS, SIGNS))


def _add_gram_times(z: np.ndarray, passages: list[np.ndarray], weights: list[float], idf: np.ndarray, q: np.ndarray | tuple[np.ndarray, np.ndarray]) -> None:
    """Add A'A Q to ``z`` for the passages' weighted TF-IDF matrix A, in the rows of the terms that occur; Q is dense, or :func:`random_signs`."""
    term = np.concatenate(passages) % TERMS
    seen = np.zeros(TERMS, bool)
    seen[term] = True
    terms = np.flatnonzero(seen)
    column = np.cumsum(seen) - 1
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    a = np.bincount(row * len(terms) + column[term], minlength=len(passages) * len(terms)).reshape(len(passages), len(terms)).astype(np.float32) * idf[terms]
    scale = np.sqrt(np.asarray(weights, np.float32) / np.maximum(np.einsum("ij,ij->i", a, a), np.float32(1e-18)))
    a *= scale[:, None]
    if isinstance(q, tuple):
        value, width = idf[term] * scale[row], z.shape[1]
        y = sum(np.bincount(row * width + q[0][term, k], value * q[1][term, k], len(passages) * width) for k in range(SIGNS)).reshape(-1, width).astype(np.float32)
    else:
        y = a @ q[terms]
    z[terms] += a.T @ y


def latent_space(words: DataFrame, benchmark: DataFrame, idf: np.ndarray, space: Workspace, parts: int | None = None) -> np.ndarray:
    """Right singular vectors (terms x rank) of all texts and of all passages of the items (``words``).

    Every text is a row of the matrix, with all its words, and every window of
    every item is one.  Rows are weighed: all texts together count as
    TEXTS_WEIGH passages at most, an item as ITEM_WEIGHS and all items as
    ITEMS_WEIGH.  Each partition multiplies its own rows and gives out the rows of
    terms that occur in them; these are summed by blocks of terms.  The number of
    terms and the rank bound what comes back, RANK + OVERSAMPLE numbers a term,
    so a task for each core reads all its share and gives this out once.
    """
    width = min(RANK, TERMS) + OVERSAMPLE
    of_text = min(1.0, TEXTS_WEIGH / max(1, words.count()))
    of_items = min(1.0, ITEMS_WEIGH / ITEM_WEIGHS / max(1, benchmark.count()))
    rows = words.select("words", F.lit(False).alias("item")).unionByName(benchmark.select("words", F.lit(True).alias("item")))
    rows = rows.coalesce(parts or words.sparkSession.sparkContext.defaultParallelism)
    basis = random_signs(width)

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((TERM_BLOCK, width), np.float64)
        for terms, part in zip(rows["terms"], rows["z"]):
            at = np.frombuffer(terms, np.int64) % TERM_BLOCK
            z[at] += np.frombuffer(part, np.float32).reshape(len(at), width)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "z": [z.astype(np.float32).tobytes()]})

    for step in range(POWER + 1):
        now = words.sparkSession.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            q, z, passages, weights, held = now.value, np.zeros((TERMS, width), np.float32), [], [], 0
            for batch in batches:
                for cell, is_item in zip(batch.column(0), batch.column(1).to_pylist()):
                    whole = np.frombuffer(cell.as_py(), np.uint32)
                    own = _windows(whole) if is_item else [whole] if len(whole) else []
                    passages += own
                    weights += [of_items * min(1.0, ITEM_WEIGHS / len(own)) if is_item else of_text] * len(own) if own else []
                    held += sum(map(len, own))
                    if held >= BLOCK_WORDS or len(passages) >= BLOCK_PASSAGES:
                        _add_gram_times(z, passages, weights, idf, q)
                        passages, weights, held = [], [], 0
            if passages:
                _add_gram_times(z, passages, weights, idf, q)
            terms = np.flatnonzero(z.any(axis=1))
            cuts = np.unique(terms // TERM_BLOCK, return_index=True)
            for block, i, j in zip(cuts[0].tolist(), cuts[1].tolist(), [*cuts[1][1:].tolist(), len(terms)]):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "terms": pa.array([terms[i:j].tobytes()], pa.binary()), "z": pa.array([z[terms[i:j]].tobytes()], pa.binary())})

        summed = rows.mapInArrow(tidy(multiply), "block long, terms binary, z binary").groupBy("block").applyInPandas(add_up, "block long, z binary")
        z = np.zeros((TERMS, width), np.float32)
        for block, part in summed.collect():  # TERMS / TERM_BLOCK at most
            z[block * TERM_BLOCK : (block + 1) * TERM_BLOCK] = np.frombuffer(part, np.float32).reshape(TERM_BLOCK, width)
        now.destroy()
        # orthonormal columns, ordered by the singular values: Z W / sqrt(L) for the eigenvectors W and eigenvalues L of Z'Z
        values, vectors = np.linalg.eigh(z.T.astype(np.float64) @ z)
        kept = np.flatnonzero(values > 1e-10 * max(values.max(), 1e-300))[::-1]
        basis = (z @ (vectors[:, kept] / np.sqrt(values[kept]))).astype(np.float32)
        basis = np.pad(basis, ((0, 0), (0, width - basis.shape[1])))
    return basis[:, : min(RANK, TERMS)]


def _windows(words: np.ndarray) -> list[np.ndarray]:
    if len(words) <= WINDOW:
        return [words] if len(words) else []
    return [words[a : a + WINDOW] for a in range(0, len(words) - WINDOW + STRIDE, STRIDE)]


def _pieces(item: np.ndarray) -> list[np.ndarray]:
    """A long item's own passages, side by side, the last one ending with it.

    Of two windows that make up an item one has a cosine of 0.7 with the whole, so up to there none are needed.
    """
    if len(item) <= 2 * WINDOW:
        return []
    return [*(item[a : a + WINDOW] for a in range(0, len(item) - WINDOW, WINDOW)), item[-WINDOW:]]


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` words that start at each place."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _seeds(items: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Run length -> sorted hashes and their items: short items whole, of others each run of SHORT words, side by side."""
    found: dict[int, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        n = min(SHORT, len(item))
        runs = {*range(0, len(item) - n + 1, n), len(item) - n}
        found.setdefault(n, []).extend({(int(h), k) for h in _gram_hashes(item, n)[sorted(runs)]})
    out = {}
    for n, pairs in found.items():
        pairs.sort()
        out[n] = (np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs]))
    return out


def _spans(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows that each window is made of."""
    out = rows[at].copy()
    for k in range(1, WINDOW // STRIDE):
        out += rows[at + k]
    return out


def _vectors(passages: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of unit length, terms x passages."""
    row, term, value = _passage_rows(passages, idf)
    out = np.zeros((TERMS, len(passages)), np.float32)
    out[term, row] = value
    return out


def asked_vectors(items: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """What is searched for by cosine, items and their own passages, and the item each belongs to."""
    owner = np.array([k for k, x in enumerate(items) if len(x) >= SHORT for _ in range(1 + len(_pieces(x)))], np.int64)
    return [p for x in items if len(x) >= SHORT for p in (x, *_pieces(x))], owner


def mixed_gains(asked: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What one occurrence of a term adds to the product of a window with each asked vector, terms x asked.

    The product takes the projections on the latent space whole and what is left by the share OUTSIDE.
    """
    vectors = _vectors(asked, idf)
    latent = basis @ (basis.T @ vectors)
    return np.concatenate([(OUTSIDE * vectors + (1 - OUTSIDE) * latent) * idf[:, None], np.zeros((1, len(asked)), np.float32)])


def search(words: DataFrame, items: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> DataFrame:
    """``doc, tag, k, common, cosine``: items, by their place in the list, that a text holds, checked.

    A window is a candidate for an item if its cosine with the item, or with one
    of the item's own passages, is large enough.  A window that has a run of SHORT
    words in common with an item is one whatever its cosine.  Windows are sums of
    blocks of STRIDE words.  Windows whose sum of every term's largest gain over
    all items stays below the cosine are left out first, which drops no candidate.
    """
    asked, owner = asked_vectors(items)
    sent = words.sparkSession.sparkContext.broadcast(mixed_gains(asked, idf, basis) if asked else None)
    needed = [math.ceil(COMMON * len(x)) for x in items]
    weights = np.append(idf, np.float32(0))  # the last term fills blocks up
    spelled = [x.tolist() for x in items]
    answers = [frozenset(x[-max(1, len(x) // 4) :]) for x in spelled]
    seeds = _seeds(items)
    schema = words.select("doc", "tag").schema.add("k", "long").add("common", "double").add("cosine", "double")

    def check(doc: np.ndarray, at: int, k: int) -> float:
        n = len(items[k])
        part = doc[max(0, at - n) : at + WINDOW + n]
        there = set(part.tolist())
        if sum(map(there.__contains__, spelled[k])) < needed[k] or len(answers[k] & there) < ANSWER * len(answers[k]):
            return 0.0
        common = common_subsequence(items[k], part)
        return common / n if common >= needed[k] else 0.0

    def lengths(windows: np.ndarray) -> np.ndarray:
        """Lengths of the windows' TF-IDF vectors; a row of ``windows`` has the terms of one."""
        terms = np.sort(windows, axis=1)
        place = np.arange(terms.shape[1])
        starts = np.ones(terms.shape, bool)
        starts[:, 1:] = terms[:, 1:] != terms[:, :-1]
        nth = place - np.maximum.accumulate(np.where(starts, place, 0), axis=1)  # of equal terms
        return np.sqrt(((weights * weights)[terms] * (2 * nth + 1)).sum(axis=1))  # 1 + 3 + 5 + ... are the squares

    def close(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """Candidates by cosine: text, place of the window, item, cosine."""
        gains, highest = tables()
        sizes = np.array([len(d) for d in docs])
        blocks = -(-sizes // STRIDE) + WINDOW // STRIDE - 1
        begins = np.cumsum(blocks) - blocks
        grid = np.full(int(blocks.sum()) * STRIDE, TERMS)
        grid[np.arange(sizes.sum()) + np.repeat(begins * STRIDE - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(docs) % TERMS
        grid = grid.reshape(-1, STRIDE)
        count = -(-np.maximum(1, sizes - WINDOW + STRIDE) // STRIDE)
        whose = np.repeat(np.arange(len(docs)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = begins[whose] + place
        # no window is shorter than the sum over its words
        kept = np.flatnonzero(_spans(highest[grid].sum(axis=1), start) >= COSINE * np.sqrt(_spans((weights * weights)[grid].sum(axis=1), start)))
        whose, place, start = whose[kept], place[kept], start[kept]
        norm = lengths(grid[start[:, None] + np.arange(WINDOW // STRIDE)].reshape(len(start), WINDOW)).astype(np.float32)
        kept = np.flatnonzero(_spans(highest[grid].sum(axis=1), start) >= COSINE * norm)
        whose, place, start, norm = whose[kept], place[kept], start[kept], np.maximum(norm[kept], np.float32(1e-9))
        used = np.zeros(len(grid) + 1, bool)
        for k in range(WINDOW // STRIDE):
            used[start + k] = True
        used = np.flatnonzero(used)
        step = max(64, CELLS // len(asked))
        for a in range(0, len(used), step):
            # blocks of this turn, and as many of the next as its last windows reach into
            turn = used[a : a + step + WINDOW // STRIDE - 1]
            some = slice(*np.searchsorted(start, [turn[0], used[a + step] if a + step < len(used) else len(grid)]))
            if some.start == some.stop:
                continue
            sums = gains[grid[turn, 0]]
            for k in range(1, STRIDE):
                sums += gains[grid[turn, k]]
            cosine = _spans(sums, np.searchsorted(turn, start[some])) / norm[some][:, None]
            i, q = np.nonzero(cosine >= COSINE)
            score, k = cosine[i, q], owner[q]
            sort = np.lexsort((-score, k, i))
            i, k, score = i[sort], k[sort], score[sort]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
            yield from zip(whose[some][i[new]].tolist(), (place[some][i[new]] * STRIDE).tolist(), k[new].tolist(), score[new].tolist())

    def alike(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """Candidates by a common run of words."""
        sizes = np.array([len(d) for d in docs])
        ends, every = np.cumsum(sizes), np.concatenate(docs)
        for n, (hashes, those) in seeds.items():
            got = _gram_hashes(every, n)
            low = np.searchsorted(hashes, got)
            at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == got)
            doc = np.searchsorted(ends, at, side="right")
            at, doc = at[at + n <= ends[doc]], doc[at + n <= ends[doc]]
            last: dict[tuple[int, int], int] = {}
            for p, d in zip(at.tolist(), doc.tolist()):
                begin = p - int(ends[d] - sizes[d])
                for j in range(low[p], np.searchsorted(hashes, got[p], side="right")):
                    k = int(those[j])
                    if last.get((d, k), -STRIDE) + STRIDE <= begin:
                        last[d, k] = begin
                        yield d, begin, k, -1.0

    def cosine_of(k: int, window: np.ndarray) -> float:
        gains, _ = tables()
        terms = window % TERMS
        best = gains[terms][:, owner == k].sum(axis=0).max()
        return float(best / max(1e-9, lengths(terms[None, :])[0]))

    def found_in(docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float]]:
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for source in ([close(docs)] if asked else []) + [alike(docs)]:
            for d, at, k, cosine in source:
                if best.get((d, k), (0.0,))[0] == 1.0:  # its closest window gives the cosine
                    best[d, k] = (1.0, max(best[d, k][1], cosine))
                    continue
                if len(items[k]) < SHORT:
                    common = float(np.array_equal(docs[d][at : at + len(items[k])], items[k]))
                    cosine = 1.0
                else:
                    common = check(docs[d], at, k)
                if common and common > best.get((d, k), (0.0,))[0]:
                    best[d, k] = (common, cosine if cosine >= 0 else cosine_of(k, docs[d][at : at + WINDOW]))
        return best

    held_tables: list = []

    def tables() -> tuple[np.ndarray, np.ndarray]:
        if not held_tables:
            held_tables.extend([sent.value, sent.value.max(axis=1)])
        return held_tables[0], held_tables[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows_at: list[int] = []
            docs: list[np.ndarray] = []
            held = 0
            for row_at, cell in enumerate(batch.column(2)):
                doc = np.frombuffer(cell.as_py(), np.uint32)
                if len(doc):
                    rows_at.append(row_at)
                    docs.append(doc)
                    held += len(doc)
                if docs and (held >= WORDS_AT_ONCE or row_at == batch.num_rows - 1):
                    out += [(rows_at[d], k, c, s) for (d, k), (c, s) in found_in(docs).items()]
                    rows_at, docs, held = [], [], 0
            if out:
                rows, k, common, cosine = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in batch.columns[:2]), pa.array(k, pa.int64()), pa.array(common, pa.float64()), pa.array(cosine, pa.float64())],
                    names=["doc", "tag", "k", "common", "cosine"],
                )

    return words.select("doc", "tag", "words").mapInArrow(tidy(run), schema)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Names and words of the items, block by block, so that the driver holds one block."""
    names, items, held = [], [], 0
    for name, packed in benchmark.select("doc", "words").toLocalIterator():
        words = np.frombuffer(packed, np.uint32)
        vectors = 1 + len(_pieces(words))
        if items and held + vectors > ASKED_AT_ONCE:
            yield names, items
            names, items, held = [], [], 0
        names.append(name)
        items.append(words)
        held += vectors
    if items:
        yield names, items


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc, tag, item, common, cosine``: a row for each item that a text (``doc`` its key, ``tag`` its xxhash64) holds.

    Texts and items may be null or empty and then match nothing.  Repeated rows
    are searched once each, rows with a null key like others, and an item with a
    null id is an item.  Items are searched for in blocks of ASKED_AT_ONCE vectors;
    the driver holds one block, and each block reads the stored words once.
    """
    space = Workspace(docs.sparkSession, "decontam")
    words = space.store(hashed_words(docs, key, text), "words")
    asked = hashed_words(benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct(), "i", "t")
    asked = space.store(asked.where(F.octet_length("words") > 0), "asked")
    idf, basis, found = term_weights(words), None, None
    for names, items in _blocks(asked):
        basis = latent_space(words, asked, idf, space) if basis is None else basis
        named = docs.sparkSession.createDataFrame([(k, name) for k, name in enumerate(names)], benchmark.select(F.lit(0).cast("long").alias("k"), F.col(f"`{item}`").alias("item")).schema)
        hits = search(words, items, idf, basis).join(F.broadcast(named), "k").select("doc", "tag", "item", "common", "cosine")
        hits = space.store(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = benchmark.schema[item].dataType
        found = words.select("doc", "tag", F.lit(None).cast(kind).alias("item"), F.lit(0.0).alias("common"), F.lit(0.0).alias("cosine")).limit(0)
    return space.finish(found, "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per record: ``<key>, contaminated, n_items, item_id, common, cosine`` (of the best item, the lowest id in a tie).

    Columns of ``docs`` besides the key and the text are ignored.
    """
    hits = find_items(docs, benchmark, key, text)
    best = hits.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(
        F.countDistinct(F.struct("item")).alias("n_items"), F.min(F.struct((-F.col("common")).alias("least"), "item", "cosine")).alias("top")
    )
    rows = docs.select(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")).alias("__own"))
    joined = rows.join(best, F.col(f"`{key}`").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__tag")), "left")
    return joined.select(
        F.col(f"`{key}`"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("top.item").alias("item_id"), F.round(-F.col("top.least"), 6).alias("common"), F.round("top.cosine", 4).alias("cosine"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The records that hold no benchmark item; all columns pass through, of equal keys each text is judged by itself."""
    hits = find_items(docs, benchmark, key, text).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).distinct()
    return docs.join(hits, F.col(f"`{key}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__tag")), "left_anti")
