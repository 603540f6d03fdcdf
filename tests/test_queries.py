"""Every registered query against its SQL on the smallest tables."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import same
from conftest import SF
from threadline.operators import asof, search
from threadline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(registry.queries()[name], registry.oracle_sql()[name], spark, SF)
    spark.catalog.clearCache()


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def frames(spark, *names):
    got = {n: registry.queries()[n](spark, SF).toPandas() for n in names}
    spark.catalog.clearCache()
    return got.values()


def test_feedback_against_loops(spark):
    """Labels, stats and replay against plain loops over the turns given and the entities of all turns."""
    chosen, labels, own, stats, replayed, spelled, turns, entities, closed = frames(
        spark, "recommended_turns", "turn_labels", "decision_labels", "feedback_stats", "threshold_replay", "prompt_spellings", "classify_turns", "turn_entities", "closed_sessions"
    )
    assert (chosen.groupby("query_id").size() <= 3).all()
    assert ((chosen.turn_id.to_numpy() >> 24) < (chosen.query_id.to_numpy() >> 24)).all()
    number = lambda df: df.session_key.astype("int64") * (1 << 24) + df.turn_seq
    at = {t: (s, ts, tool) for t, s, ts, tool in zip(number(turns), turns.session_key, turns.ts, turns.tool_name)}
    named: dict[int, set] = {}
    for t, kind, value in zip(number(entities), entities.kind, entities.value):
        named.setdefault(t, set()).add((kind, value))
    final = {int(s) for s, c in zip(closed.session_key, closed.closed) if c}
    judged = [(q, t) for q, t in zip(chosen.query_id, chosen.turn_id) if q >> 24 in final]
    assert 0 < len(judged) < len(chosen)  # decisions of open sessions wait
    of_session: dict[str, list[int]] = {}
    for t, (s, *_) in at.items():
        of_session.setdefault(s, []).append(t)
    kinds = ("path", "symbol", "error", "command")
    want = {}
    for q, t in judged:
        session, since, _ = at[q]
        mine = {e for e in named.get(t, ()) if e[0] in kinds}
        used = any(at[u][1] > since and mine & named.get(u, set()) for u in of_session[session])
        want[q, t] = "hit" if used else "false positive"
    assert {(d, t): y for d, t, y in zip(labels.decision_id, labels.turn_id, labels.label)} == want
    handed: dict[int, set] = {}
    for q, t in judged:
        handed.setdefault(q, set()).update(v for _, v in named.get(t, ()))
    miss = {}
    for q, text in zip(spelled.query_id, spelled.spellings):
        if q >> 24 in final:
            session, since, _ = at[q]
            sought = {v for u in of_session[session] if (at[u][2] or "").endswith("recall_search") and at[u][1] > since for k, v in named.get(u, ()) if k in ("path", "symbol")}
            left = sorted(s for s in text.split("|") if s in sought and s not in handed.get(q, ()))
            if left:
                miss[q] = left[0]
    wasted = {q for q, _ in judged} - {q for (q, _), y in want.items() if y == "hit"}
    assert {d: v for d, y, v in zip(own.decision_id, own.label, own.detail) if y == "miss"} == miss
    assert {d for d, y in zip(own.decision_id, own.label) if y == "wasted budget"} == wasted
    row = stats.iloc[0]
    hits = sum(y == "hit" for y in want.values())
    assert (row.hits, row.false_positives, row.injected, row.misses, row.wasted) == (hits, len(want) - hits, len(want), len(miss), len(wasted))
    base = replayed.set_index("grid").loc[0]
    assert base.kept == len(want) and base.added == base.removed == 0


def test_values_meet_queries_by_one_word(spark):
    """Values meet queries by one word and its salt, never by lists of words."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sets = spark.createDataFrame([("q", ["src", "mod1", "rs"])], "set_id string, tokens array<string>")
        entities = spark.createDataFrame([(1, "path", "src/mod1.rs")], "turn_id long, kind string, value string")
        plan = search.set_matches(sets, entities, spark.createDataFrame([(9,)], "turns long"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    keys = [side for x in plan.split("\n") for both in re.findall(r"Join \[(.*?)\], \[(.*?)\]", x) for side in both]
    assert sum(x.count("salt#") for x in keys) == 2 and not any("words" in x or "asked" in x for x in keys)


def test_top_before_against_sorting(spark):
    rng = np.random.default_rng(4)
    hits = [(f"s{rng.integers(0, 4)}", int(t), float(rng.integers(0, 5)), int(rng.integers(0, 2)), rng.choice(["2024", "2023", None])) for t in rng.permutation(400)]
    hits += [("hot", 1000 + i, float(i % 7), 0, "2024") for i in range(500)]
    asks = [(i, f"s{rng.integers(0, 5)}", int(rng.integers(0, 420))) for i in range(300)] + [(1000 + i, "hot", 1000 + 2 * i) for i in range(250)]
    frames = spark.createDataFrame(hits, "set_id string, turn_id long, text_score double, side int, ts string"), spark.createDataFrame(asks, "query_id long, set_id string, before_turn_id long")
    order = lambda h: (-h[2], h[3], h[4] is None, [-ord(c) for c in h[4] or ""], h[1])
    want = {(q, h[1]) for q, s, b in asks for h in sorted((h for h in hits if h[0] == s and h[1] < b), key=order)[:6]}
    for block_rows, askers in ((500_000, 10_000), (100, 7)):
        got = [(r.query_id, r.turn_id) for r in asof.top_before(*frames, 6, block_rows, askers).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_containment_join_against_loop(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)] + ["hot"]
    sets = [(f"q{i}", [str(w) for w in rng.choice(words, rng.integers(1, 7), replace=False)] + (["hot2"] if i % 2 else [])) for i in range(80)]
    values = [(int(rng.integers(0, 50)), str(rng.choice(["path", "symbol"])), "/".join(rng.choice([*words, "hot2", "never"], rng.integers(1, 4)))) for _ in range(300)] + [(1, "path", "---")]
    frame = spark.createDataFrame(sets, "set_id string, tokens array<string>")
    got = search.set_matches(frame, spark.createDataFrame(values, "turn_id long, kind string, value string"), spark.createDataFrame([(50,)], "turns long"), hot=10)
    want = {}
    for kind, value in {v[1:] for v in values}:
        parts = [p for p in value.split("/") if p != "---"]
        df = len({t for t, k, v in values if (k, v) == (kind, value)})
        for name, asked in sets:
            if parts and set(parts) <= set(asked):
                want[name, kind, value] = math.log(1 + 50 / df) * (2 if parts == asked else 1)
    assert {(r.set_id, r.kind, r.value): round(r.weight, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_retention_holds_under_every_join(spark):
    """Keys that are no numbers meet no cast, whichever side of a join a condition is carried to."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert same(registry.queries()["retention_applied"], registry.oracle_sql()["retention_applied"], spark, SF) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pools_are_found_once_for_all_askers(spark):
    """Turns of any pool are found once for each list of words; ranked with their entities they give every asker's best."""
    rng = np.random.default_rng(6)
    hits = [("a" if t % 3 else "b", t, float(rng.integers(0, 40)), 0, str(rng.integers(2020, 2025))) for t in range(900)]
    asks = [(i, "ab"[i % 2], f"w{i % 3}", int(rng.integers(0, 950))) for i in range(400)]
    frames = spark.createDataFrame(hits, "set_id string, turn_id long, text_score double, side int, ts string"), spark.createDataFrame(asks, "query_id long, set_id string, words_id string, before_turn_id long")
    gain = lambda t, w: float((t * 7 + int(w[1])) % 11)
    newest = lambda h: [-ord(c) for c in h[4]]
    for block_rows, askers in ((500_000, 10_000), (150, 9)):
        members = asof.ever_before(*frames, 20, block_rows, askers)
        found = [(r.set_id, r.words_id, r.turn_id) for r in members.collect()]
        pools = {q: sorted((h for h in hits if h[0] == s and h[1] < b), key=lambda h: (-h[2], newest(h), h[1]))[:20] for q, s, _, b in asks}
        assert len(found) == len(set(found)) and set(found) == {(s, w, h[1]) for q, s, w, _ in asks for h in pools[q]}
        assert len(found) < sum(map(len, pools.values())) / 5
        bonus = ((F.col("turn_id") * 7 + F.substring("words_id", 2, 1).cast("int")) % 11).cast("double")
        scored = members.withColumn("entity_score", bonus).withColumn("entity_count", F.lit(1).cast("long")).withColumn("relevance", F.col("text_score") + F.col("entity_score"))
        got = {(r.query_id, r.rank): (r.turn_id, r.relevance) for r in asof.ranked_before(scored, frames[1], 20, 5, block_rows, askers).collect()}
        want = {}
        for q, _, w, _ in asks:
            for n, h in enumerate(sorted(pools[q], key=lambda h: (-h[2] - gain(h[1], w), newest(h), h[1]))[:5]):
                want[q, n + 1] = (h[1], h[2] + gain(h[1], w))
        assert got == want


def test_hits_that_no_pool_can_hold_stay_behind(spark):
    """What a task leaves out is in no pool of any asker, whatever is asked, and most of what no pool holds is left out."""
    rng = np.random.default_rng(8)
    ids = rng.permutation(4000)
    hits = [("ab"[int(t % 5 == 0)], int(t), float(rng.integers(0, 6)) / 7, int(rng.integers(0, 2)), None if rng.random() < 0.1 else str(rng.integers(2020, 2025))) for t in ids]
    names, k = ["set_id", "turn_id", "text_score", "side", "ts"], 10
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, h)) for h in hits[a : a + 250]]) for a in range(0, len(hits), 250)]
    newest = lambda h: [-ord(c) for c in h[4]] if h[4] else [0]
    for held in (100_000, 700):
        left = {(r["set_id"], r["turn_id"]) for b in asof.contenders(k, held)(iter(batches)) for r in b.to_pylist()}
        for name in "ab":
            pool = []
            for h in sorted((h for h in hits if h[0] == name), key=lambda h: h[1]):
                pool = sorted([*pool, h], key=lambda h: (-round(h[2], 9), h[3], newest(h), h[1]))[:k]
                assert {(name, x[1]) for x in pool} <= left
        assert len(left) < len(hits) / 4


def test_matches_against_loop(spark, monkeypatch):
    """Sets of lists against plain loops, in parts and with few candidates at once; alike queries are matched once and nothing of the index is shuffled."""
    rng = np.random.default_rng(7)
    bodies = [(i, " ".join(rng.choice([f"w{j}" for j in range(9)], rng.integers(0, 12)))) for i in range(200)] + [(200, None)]
    sets = [(f"s{i}", [sorted({str(w) for w in rng.choice([f"w{j}" for j in range(10)], rng.integers(1, 4))}) for _ in range(rng.integers(1, 4))]) for i in range(30)]
    index = search.build_index(spark.createDataFrame(bodies, "turn_id long, body string"))
    n, split = len(bodies), {i: (b or "").split() for i, b in bodies}
    avgdl = sum(map(len, split.values())) / n
    df = {w: sum(w in b for b in split.values()) for w in (f"w{j}" for j in range(10))}
    want = {}
    for name, lists in sets:
        for i, b in split.items():
            full = [x for x in lists if all(w in b for w in x)]
            if full:
                idf = lambda w: max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 0) or 1e-6
                want[name, i] = round(sum(idf(w) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / avgdl)) for x in full for w in x), 9)
    frame = spark.createDataFrame(sets, "set_id string, lists array<array<string>>")
    for parts in (50_000, 11):
        monkeypatch.setattr(search, "HELD_SETS", parts)
        made = search.match_sets(frame, index)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert {(r.set_id, r.turn_id): round(r.text_score, 9) for r in made.collect()} == want
