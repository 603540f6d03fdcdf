"""Resampling, toxicity and source divergence against loops over plain Python values."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from compare import rows
from threadline.llm import divergence, importance, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- resampling -----------------------------------------------------------------


def loop_grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def loop_resample(docs, target, percent, least, buckets, seed):
    raw, aim = Counter(), Counter()
    for _, t in docs:
        raw.update(c % buckets for c in loop_grams(t)[1])
    for t in target:
        aim.update(c % buckets for c in loop_grams(t)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        n, crcs = loop_grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in crcs)
        out.append([key, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = fit[: percent * len(fit) // 100]
    place = {id(r): k + 1 for k, r in enumerate(drawn)}
    return pd.DataFrame([[*r[:4], place.get(id(r))] for r in out], columns=["doc_id", "n_features", "weight", "score", "rank"])


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_resample_against_loop(spark, percent):
    rng = np.random.default_rng(percent)
    vocabulary = ["Ab", "ba", "é", "Ünd", "x1", "0", "the", "of", "İ", "ÄÖ", "longer-word", "日本", "w" * 90]
    docs = [(k if k % 17 else None, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for k in range(150)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (500, None), (501, ""), (502, " -- "), (-7, "the of " * 3000)]
    target = [" ".join(rng.choice(vocabulary[:4], 40)) for _ in range(5)] + [None]
    frame = spark.createDataFrame([(k, t, "extra", 1.0) for k, t in docs], "doc_id long, text string, rank string, key double").repartition(5)
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=97)
    assert rows(got.toPandas()) == rows(loop_resample(docs, target, percent, 20, 97, 42))


def test_resample_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(one, empty).collect()[0]["rank"] is None


def test_long_texts_are_cut_without_losing_runs(monkeypatch):
    monkeypatch.setattr(importance, "PIECE_BYTES", 64)
    texts = ["", "a b c " * 400, None, "x" * 500 + " " + "y z " * 100, "é " * 300 + "-" * 9000 + " Zz9 q r", " " * 500, "one " + "-" * 200 + " two three"]
    got = {k: [] for k in range(len(texts))}
    for _, owner, bucket in importance.hashed_grams(pa.array(texts), 10_000):
        for o, b in zip(owner, bucket):
            got[int(o)].append(int(b))
    for k, text in enumerate(texts):
        assert sorted(got[k]) == sorted(c % 10_000 for c in loop_grams(text)[1])


def test_joined_crc_of_any_lengths():
    rng = np.random.default_rng(1)
    pairs = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(1, 200, (200, 2))]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    got = importance.joined_crc(crc([a for a, _ in pairs]), crc([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert (got == crc([a + b for a, b in pairs])).all()


# --- divergence -----------------------------------------------------------------


def loop_audit(docs, least, top):
    docs = [tuple(v or "" for v in d) for d in docs]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)), lang, source) for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held = Counter(w for words, at, _ in found if at == lang for w in set(words))
        kept = sorted(w for w in held if held[w] >= least)
        counts = {s: Counter() for s in {d[2] for d in docs if d[1] == lang}}
        for words, at, s in found:
            if at == lang:
                counts[s].update(w for w in words if held[w] >= least)
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value", "rank"])


@pytest.mark.parametrize(("rows_of", "leaf", "columns"), [(64, 8, 1024), (4, 2, 6), (2, 1, 3)])
def test_audit_against_loop(spark, monkeypatch, rows_of, leaf, columns):
    monkeypatch.setattr(divergence, "HELD_PAIRS", 50)
    monkeypatch.setattr(divergence, "TILE_ROWS", rows_of)
    monkeypatch.setattr(divergence, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(rows_of)
    vocabulary = [f"{a}{b}" for a in "abcé日" for b in "xyzäK"] + ["Z9z", "\U0001f600", "￮"]
    docs = []
    for k in range(240):
        lang, source = rng.choice(["de", "en", None, ""]), rng.choice([f"s{x}" for x in range(9)] + [None, ""], p=[0.4] + [0.06] * 10)
        mine = vocabulary[: 20 if source == "s0" else 28] if lang != "de" else vocabulary[:5]
        docs.append((" ".join(rng.choice(mine, rng.integers(0, 12))), lang, source))
    docs += [(None, "fr", "a"), ("", "fr", "b"), ("solo words", "it", "only"), ("Aa " * 4000, "en", "s1")] + [docs[0]] * 3
    monkeypatch.setattr(divergence, "compare_tiles", _traced(rows_of, leaf))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, value int, term string").repartition(4)
    got = divergence.audit(frame, least_docs=4, top=5, columns=columns)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows(got.toPandas()) == rows(loop_audit(docs, 4, 5))


def _traced(rows_of, leaf):
    """``compare_tiles`` with the sizes of a test, which workers would not see otherwise."""
    compare = divergence.compare_tiles

    def run(key, frame):
        divergence.TILE_ROWS, divergence.LEAF_ROWS = rows_of, leaf
        return compare(key, frame)

    return run


def test_empty_quadrants_are_priced_whole():
    rng = np.random.default_rng(5)
    cells = np.zeros((8, 32), np.int64)
    cells[:2, :8] = rng.integers(1, 1000, (2, 8))
    empty = rng.integers(1, 50, 8)
    tile = divergence.Tile(cells, empty, (1, 4), 3)
    total, priced = divergence.walk(tile, tile, 30, True)
    full = np.where(cells > 0, cells, empty[:, None])[:, :30]
    want = ((full[:, None] - full[None]) ** 2 // (full[:, None] + full[None])).sum(axis=2)
    assert (np.triu(total, 1) == np.triu(want, 1)).all()
    assert 0 < priced < 40  # of 8 * 9 / 2 * 8 leaves


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.createDataFrame([(8_000_000_000_000_000_000, 9_000_000_000_000_000_000, 5)], "c long, n long, v long").select(divergence.share("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (8_000_000_000_000_000_002) // (9_000_000_000_000_000_010)


# --- toxicity -------------------------------------------------------------------

BAD = ["rotten", "vile", "scoundrel"]
PLAIN = ["river", "house", "green", "walks", "over", "under", "seven", "lamp", "stone", "winter"]


def toxic_tables(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(PLAIN, 30)) + (list(rng.choice(BAD, 3)) if toxic else [])
        docs.append((k, " ".join(rng.permutation(words)), "x"))
        labels.append((k, toxic, "y"))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity_on_planted_words(spark):
    docs, labels, frame, truth = toxic_tables(spark)
    got = toxicity.score_all(frame, truth).toPandas().set_index("doc_id")
    assert list(got.columns) == ["held_out", "score", "predicted", "evidence"]
    want = {k: y for k, y, _ in labels}
    assert all(got.predicted[k] == want[k] for k in want)
    assert all(got.held_out[k] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in want)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    # evidence names learned examples only, the label with each
    for k in [k for k in want if want[k]][:20]:
        for part in got.evidence[k].split(","):
            key, cosine, label = part.split(":")
            assert zlib.crc32(key.encode()) % 3 != 1 and int(label) == want[int(key)] and 0 < float(cosine) <= 1


def test_held_out_labels_are_not_learned(spark):
    docs, labels, frame, truth = toxic_tables(spark)
    flipped = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y, z) for k, y, z in labels], truth.schema)
    assert rows(toxicity.score_all(frame, truth).toPandas()) == rows(toxicity.score_all(frame, flipped).toPandas())


def random_index(rng, examples=300, terms=40):
    pairs = [(e, t) for e in range(examples) for t in rng.choice(terms, rng.integers(0, 8), replace=False)]
    example, term = (np.array(v, np.int64) for v in zip(*pairs))
    return toxicity.BlockMaxIndex([f"t{t}" for t in range(terms)], rng.random(terms) + 0.5, np.arange(examples).astype(str), rng.integers(0, 2, examples).astype(float), rng.random(examples) + 0.5, example, term, rng.integers(1, 5, len(pairs)).astype(float))


def test_block_max_search_is_exact():
    rng = np.random.default_rng(8)
    index = random_index(rng)
    dense = np.zeros((300, 40))
    dense[index.example, index.term] = index.weight
    saved = toxicity.BlockMaxIndex.load(index.save())
    for _ in range(200):
        term = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        weight = rng.random(len(term)) + 0.1
        weight /= np.sqrt((weight**2).sum())
        cosines = dense[:, term] @ weight
        want = [i for i in np.lexsort((np.arange(300), -np.round(cosines, 9)))[:10] if cosines[i] > 0]
        for one in (index, saved):
            ids, sims = one.nearest(term, weight, 10)
            assert list(ids) == want and np.allclose(sims, cosines[want])
        ids, _ = index.nearest(term, weight, 10, but=int(want[0]))
        assert want[0] not in ids
    assert index.opened < 401 * 19  # blocks below the bound stay closed


def test_calibration_rises_with_the_share():
    rng = np.random.default_rng(9)
    index = random_index(rng)
    index.calibrate(10)
    found = [index.score(x) for x in np.linspace(0, 1, 101)]
    assert all(a <= b + 0.05 for a, b in zip(found, found[1:])) and 0 <= min(found) and max(found) <= 1


def test_toxicity_of_odd_rows(spark):
    docs, labels, frame, truth = toxic_tables(spark, 200)
    odd = spark.createDataFrame([(None, "rotten vile"), (None, None), (9001, ""), (9002, "rotten " * 300_000), (9003, None), (9003, "1 2 3")], "doc_id long, text string")
    again = truth.unionByName(truth.limit(50)).unionByName(spark.createDataFrame([(1, None, ""), (None, 1, ""), (70_000, 1, "")], truth.schema))
    got = toxicity.score_all(frame.drop("score").unionByName(odd).unionByName(frame.drop("score").limit(20)), again).toPandas()
    assert len(got) == 226
    quiet = got[got.doc_id.isin([9001, 9003])]
    assert quiet.score.nunique() == 1 and (quiet.evidence == "").all() and (quiet.predicted == 0).all()
    assert not got[got.doc_id.isna()].held_out.any()


def test_toxicity_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_all(frame, none).collect()} == {0.0}
    assert toxicity.score_all(frame.limit(0), none).count() == 0
    one_sided = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_all(frame, one_sided).collect()} == {0}
