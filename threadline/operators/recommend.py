"""Which past turns to hand to a prompt, whether that helped, and what other thresholds would have done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.values import bound, lexical_path, tokens
from threadline.operators.asof import contenders, ever_before, ranked_before
from threadline.operators.search import Index, match_sets, set_id, set_matches, with_excerpts, word_sets
from threadline.sources.tables import stored

# Default thresholds.
THRESHOLDS = {"ranked": 3, "co_occurring": 2, "window": 10, "compacted_window": 50, "max_turns": 3, "max_spellings": 8}
LABEL_KINDS = ("path", "symbol", "error", "command")


def named_in(most: int = THRESHOLDS["max_spellings"]) -> Column:
    """Paths and identifiers that a prompt (``text, cwd``) names, in order, at most eight.

    A relative path counts as joined to the folder and as typed; spellings of the
    same words count once.
    """
    words = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"""^["'`(<\[]+|["'`)>\],.;:!?]+$""", "")), lambda w: w != "")
    is_path = lambda w: w.contains("/") & ~w.contains("://") & ~w.startswith("-")
    camel = r"[\p{IsLowercase}\p{N}]\p{IsUppercase}|\p{IsUppercase}\p{IsUppercase}\p{IsLowercase}|[^\W_]_+[^\W_]"
    spelled = F.flatten(
        F.transform(
            words,
            lambda w: F.when(is_path(w) & w.startswith("/"), F.array(w))
            .when(is_path(w), F.array(lexical_path(F.concat_ws("/", F.col("cwd"), w)), w))
            .when(w.rlike(camel), F.array(w))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    keyed = F.transform(F.array_distinct(spelled), lambda s: F.struct(F.array_join(tokens(s), " ").alias("k"), s.alias("s")))
    first = lambda some: F.filter(some, lambda x, i: (i == F.array_position(F.transform(some, lambda y: y["k"]), x["k"]) - 1) & (x["k"] != ""))
    return F.slice(F.transform(bound(keyed, first), lambda x: x["s"]), 1, most)


def prompt_spellings(prompts: DataFrame, most: int = THRESHOLDS["max_spellings"]) -> DataFrame:
    """``query_id, spellings``: what :func:`named_in` finds in each prompt."""
    return prompts.select("query_id", named_in(most).alias("spellings"))


def query_text() -> Column:
    """The resolved absolute paths among a prompt's spellings first, then the prompt."""
    return F.concat_ws(" ", F.array_join(F.filter("spellings", lambda s: s.startswith("/")), " "), "text")


def prompt_query(prompts: DataFrame, spellings: DataFrame) -> DataFrame:
    """``query_id, text``: :func:`query_text` of every prompt."""
    return prompts.join(spellings, "query_id").select("query_id", query_text().alias("text"))


def grouped_spellings(spellings: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Queries by their set of lists of words, and these lists: ``query_id, set_id`` (and ``more`` columns) and ``set_id, lists``.

    Prompts that name the same things share a set.
    """
    lists = F.filter(F.transform("spellings", lambda s: F.array_distinct(tokens(s))), lambda t: F.size(t) > 0)
    named = spellings.select("query_id", *more, F.array_sort(lists).alias("lists")).where(F.size("lists") > 0)
    named = stored(named.withColumn("set_id", F.md5(F.array_join(F.transform("lists", lambda t: F.array_join(t, " ")), "/"))), "named")
    return named.select("query_id", *more, "set_id"), named.groupBy("set_id").agg(F.first("lists").alias("lists"))


def candidates(prompts: DataFrame, index: Index, turns: DataFrame, entities: DataFrame, pool: int = 200, window: int = THRESHOLDS["window"], known: DataFrame | None = None) -> DataFrame:
    """Ranked turns for prompts (``query_id, text, cwd, before_turn_id``): text score of the spellings, then entity weights.

    Text scores belong to sets of spellings, entity weights to lists of words.
    A pool of ``pool`` turns is never written for each prompt: a first pass finds
    which turns of a set are in any pool, only they meet entities, and a second
    pass ranks the pool of every prompt and gives out its ``window`` best.  A
    prompt that follows a compaction (``compacted``, optional) looks at a wider
    window.  ``prompts`` may have their ``spellings``, and an index whose words have
    ``side`` and ``ts`` is not joined with ``turns`` for them.  ``known`` is
    :func:`~threadline.operators.search.entity_df` of the entities, if it is there already.
    """
    spelled = prompts if "spellings" in prompts.columns else prompts.withColumn("spellings", named_in())
    named, sets = grouped_spellings(spelled.withColumn("tokens", F.slice(F.array_distinct(tokens(query_text())), 1, 32)), "before_turn_id", "tokens")
    words = index.words
    if not {"side", "ts"} <= set(words.columns):
        words = words.join(turns.select("turn_id", F.coalesce(F.col("is_sidechain").cast("int"), F.lit(-1)).alias("side"), "ts"), "turn_id")
    hits = stored(match_sets(sets, index, words, keep=contenders(pool)), "set_hits")
    asks = stored(named.where("before_turn_id is not null").select("query_id", "before_turn_id", "set_id", set_id().alias("words_id")), "asks")
    pooled = stored(ever_before(hits, asks, pool), "pooled")
    weights = set_matches(word_sets(named), entities if known is None else known, turns.agg(F.count(F.lit(1)).alias("turns"))).withColumnRenamed("set_id", "words_id")
    # only pooled turns meet entities, never all turns: a value that most turns hold and many prompts name stays in proportion
    met = pooled.select("words_id", "turn_id").distinct().join(entities.select("turn_id", "kind", "value"), "turn_id").join(weights, ["words_id", "kind", "value"])
    scored = met.groupBy("words_id", "turn_id").agg(F.sum("weight").alias("entity_score"), F.count_distinct("kind", "value").alias("entity_count"))
    held = pooled.join(scored, ["words_id", "turn_id"], "left").fillna({"entity_score": 0.0, "entity_count": 0})
    held = stored(held.withColumn("relevance", F.col("text_score") + F.col("entity_score")), "pool")
    ranked = lambda n: ranked_before(held, asks, pool, n)
    shown = stored(turns.join(held.select("turn_id").distinct(), "turn_id", "left_semi"), "shown")  # few turns are in any pool
    full = lambda df: df.drop("side", "ts").join(shown, "turn_id")
    if "compacted" not in prompts.columns:
        return full(ranked(window))
    wide = ranked(THRESHOLDS["compacted_window"])
    after = prompts.where("compacted").select("query_id").distinct().withColumn("__wide", F.lit(True))
    return full(wide.join(after, "query_id", "left").where((F.col("rank") <= window) | F.col("__wide")).drop("__wide"))


def compacted_pool(hits: DataFrame, prompts: DataFrame, dropped: DataFrame) -> DataFrame:
    """Of the hits of a prompt that follows a compaction, those that the compaction dropped; all of any other.

    Ranks stay as they are.
    """
    after = prompts.where("compacted").select("query_id").distinct()
    others = hits.join(after, "query_id", "left_anti")
    return others.unionByName(hits.join(after, "query_id", "left_semi").join(dropped.select("turn_id").distinct(), "turn_id", "left_semi").select(*others.columns))


def eligible(ranked_first: int | Column = THRESHOLDS["ranked"], co_occurring: int | Column = THRESHOLDS["co_occurring"]) -> Column:
    """An entity matches, and the hit ranks high or several entities match."""
    return (F.col("entity_count") > 0) & ((F.col("rank") <= ranked_first) | (F.col("entity_count") >= co_occurring))


def quotable() -> Column:
    """Everything but user turns that no person typed."""
    return ~((F.col("record_type") == "user") & (F.coalesce("is_typed", F.lit(True)) == False))  # noqa: E712


def refuse(hits: DataFrame, given: DataFrame, sessions: DataFrame, dropped: DataFrame, briefed: DataFrame | None = None) -> DataFrame:
    """Add ``reason``, the first that holds.

    Already given (``query_id, turn_id``), visible in the prompt's own session and
    not dropped by a compaction, or carried by the digest (``briefed``, as ``given``).
    """
    out = hits.join(given.select("query_id", "turn_id").distinct().withColumn("__given", F.lit(True)), ["query_id", "turn_id"], "left")
    out = out.join(sessions.select("query_id", F.col("session_key").alias("__own")), "query_id", "left")
    out = out.join(dropped.select("turn_id").distinct().withColumn("__dropped", F.lit(True)), "turn_id", "left")
    reason = F.when(F.col("__given"), "already given").when((F.col("session_key") == F.col("__own")) & F.col("__dropped").isNull(), "visible")
    if briefed is not None:
        out = out.join(briefed.select("query_id", "turn_id").distinct().withColumn("__told", F.lit(True)), ["query_id", "turn_id"], "left")
        reason = reason.when(F.col("__told"), "carried by digest")
    return out.withColumn("reason", reason).drop("__given", "__own", "__dropped", "__told")


def decision_sizes(chosen: DataFrame, bodies: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, injected, chars_injected``: the chosen turns in order, each with the characters of its excerpt."""
    shown = with_excerpts(chosen, bodies, queries).withColumn("chars", F.coalesce(F.char_length("excerpt"), F.lit(0)).cast("long"))
    made = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "chars"))).alias("i"), F.sum("chars").alias("chars_injected"))
    return made.select("query_id", F.transform("i", lambda x: F.struct(x["turn_id"].alias("turn_id"), x["chars"].alias("chars"))).alias("injected"), "chars_injected")


def choose(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Injected turns under each row of a grid (``grid, ranked, co_occurring, max_turns``): ``grid, query_id, turn_id, place``.

    The grid is a handful of rows, so every hit is judged once per row.
    """
    grid = hits.crossJoin(F.broadcast(thresholds))
    ok = grid.where(eligible(F.col("ranked"), F.col("co_occurring")) & quotable() & F.col("reason").isNull())
    place = F.row_number().over(Window.partitionBy("grid", "query_id").orderBy("rank"))
    return ok.withColumn("place", place).where("place <= max_turns").select("grid", "query_id", "turn_id", "place")


def eligible_decisions(decisions: DataFrame, meta: DataFrame) -> DataFrame:
    """Decisions that may be labelled: with a session id and a time, and some closed file of that session.

    ``meta`` has ``session_id, closed``; several files may report one session id.
    """
    final = meta.where("closed and session_id is not null").select("session_id").distinct()
    return decisions.where("ts is not null").join(final, "session_id", "left_semi")


def _placed(turns: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the session, time and tool of their turns; those that have them already meet no turns."""
    own = [c for c in ("session_id", "ts", "tool_name") if c in turns.columns]
    return entities if set(own) <= set(entities.columns) else entities.select("turn_id", "kind", "value").join(turns.select("turn_id", *own), "turn_id")


def _sought(turns: DataFrame, entities: DataFrame) -> DataFrame:
    """``session_id, value, last``: paths and symbols that a session searched for, and when it last did."""
    tool = F.col("tool_name")
    sought = _placed(turns, entities.where("kind in ('path', 'symbol')")).where((tool == "recall_search") | tool.endswith("_recall_search"))
    return sought.groupBy("session_id", "value").agg(F.max("ts").alias("last"))


def label_turns(injected: DataFrame, decisions: DataFrame, turns: DataFrame, entities: DataFrame) -> DataFrame:
    """``decision_id, turn_id, label``: hit if a later turn of the session names an entity of the injected turn.

    ``decisions``: ``decision_id, session_id, ts``; ``turns``: ``turn_id,
    session_id, ts``; later is by time text, and side transcripts of the session
    count.
    """
    made = _hit_turns(injected.select("decision_id", "turn_id"), decisions, turns, entities, entities)
    return made.select("decision_id", "turn_id", F.when(F.col("hit"), "hit").otherwise("false positive").alias("label"))


def _hit_turns(injected: DataFrame, decisions: DataFrame, turns: DataFrame, entities: DataFrame, held: DataFrame) -> DataFrame:
    """``injected`` with ``hit``, see :func:`label_turns`; ``held`` are the entities of at least its turns."""
    labelled = F.col("kind").isin(*LABEL_KINDS)
    gave = injected.join(held.where(labelled).select("turn_id", "kind", "value"), "turn_id").join(decisions, "decision_id").select("decision_id", "turn_id", "session_id", F.col("ts").alias("since"), "kind", "value")
    used = _placed(turns, entities.where(labelled)).groupBy("session_id", "kind", "value").agg(F.max("ts").alias("last"))
    hit = gave.join(used, ["session_id", "kind", "value"]).where("last > since").select("decision_id", "turn_id").distinct().withColumn("hit", F.lit(True))
    return injected.join(hit, ["decision_id", "turn_id"], "left").fillna(False, ["hit"])


def label_miss(decisions: DataFrame, injected: DataFrame, turns: DataFrame, entities: DataFrame) -> DataFrame:
    """``decision_id, label, detail``: a later search of the session sought a spelling that was not handed over.

    ``decisions`` also has ``spellings``; ``turns`` also ``tool_name``.  The
    detail is the smallest such value.
    """
    sought = _sought(turns, entities)
    spelled = decisions.select("decision_id", "session_id", F.col("ts").alias("since"), F.explode("spellings").alias("value"))
    handed = injected.join(entities.select("turn_id", "value"), "turn_id").select("decision_id", "value").distinct()
    missed = spelled.join(sought, ["session_id", "value"]).where("last > since").join(handed, ["decision_id", "value"], "left_anti")
    return missed.groupBy("decision_id").agg(F.min("value").alias("detail")).select("decision_id", F.lit("miss").alias("label"), "detail")


def label_waste(turn_labels: DataFrame) -> DataFrame:
    """Decisions that handed turns over of which none was a hit: ``decision_id, label``."""
    none = turn_labels.groupBy("decision_id").agg(F.max((F.col("label") == "hit").cast("int")).alias("h")).where("h = 0")
    return none.select("decision_id", F.lit("wasted budget").alias("label"))


def append_labels(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new labels that are not recorded yet; a second run adds nothing."""
    keys = ["decision_id", "turn_id", "label"]
    seen = old.select(*[F.col(k).alias(f"o_{k}") for k in keys]).distinct()
    same = [new[k].eqNullSafe(seen[f"o_{k}"]) for k in keys]
    return new.join(seen, same, "left_anti")


def feedback_stats(decisions: DataFrame, injected: DataFrame, turn_labels: DataFrame, decision_labels: DataFrame) -> DataFrame:
    """One row: decisions, those that fired, injected turns, label counts, precision (null if nothing was judged)."""
    d = decisions.agg(F.count(F.lit(1)).alias("decisions"))
    i = injected.agg(F.count(F.lit(1)).alias("injected"), F.count_distinct("decision_id").alias("fired"))
    t = turn_labels.agg(F.count(F.when(F.col("label") == "hit", 1)).alias("hits"), F.count(F.when(F.col("label") == "false positive", 1)).alias("false_positives"))
    m = decision_labels.agg(F.count(F.when(F.col("label") == "miss", 1)).alias("misses"), F.count(F.when(F.col("label") == "wasted budget", 1)).alias("wasted"))
    row = d.crossJoin(i).crossJoin(t).crossJoin(m)  # single rows
    judged = F.col("hits") + F.col("false_positives")
    return row.withColumn("precision", F.when(judged > 0, F.round(F.col("hits") / judged, 6)))


def replay(chosen: DataFrame, labels: DataFrame, baseline: int) -> DataFrame:
    """Per grid row: turns kept, added and removed against the baseline row, and the labels of what was kept and removed."""
    base = chosen.where(F.col("grid") == baseline).select("query_id", "turn_id", F.lit(1).alias("was"))
    grids = chosen.select("grid").distinct()
    old = base.crossJoin(grids)  # a handful of rows
    new = chosen.select("grid", "query_id", "turn_id", F.lit(1).alias("now"))
    both = old.join(new, ["grid", "query_id", "turn_id"], "full_outer").join(labels.select(F.col("decision_id").alias("query_id"), "turn_id", "label"), ["query_id", "turn_id"], "left")
    n = lambda c: F.count(F.when(c, 1))
    was, now, hit = F.col("was").isNotNull(), F.col("now").isNotNull(), F.col("label") == "hit"
    return both.groupBy("grid").agg(
        n(was & now).alias("kept"), n(now & ~was).alias("added"), n(was & ~now).alias("removed"), n(was & hit).alias("hits_before"), n(was & now & hit).alias("hits_kept")
    )


def relabelled(chosen: DataFrame, decisions: DataFrame, turns: DataFrame, entities: DataFrame) -> DataFrame:
    """``grid, decision_id, hits, false_positives, misses, wasted``: the labels each decision would have under every row of a grid.

    ``chosen``: ``grid, query_id, turn_id``; ``decisions`` and ``turns`` as for
    :func:`label_turns` and :func:`label_miss`.  A turn that several rows choose
    is labelled once; what a session sought later does not depend on the row, only
    whether the row's turns had handed it over.
    """
    offered = chosen.select("grid", F.col("query_id").alias("decision_id"), "turn_id")
    held = stored(entities.select("turn_id", "kind", "value").join(offered.select("turn_id").distinct(), "turn_id", "left_semi"), "held")  # few turns are ever chosen
    every = F.collect_list("grid").alias("grids")
    labels = _hit_turns(offered.groupBy("decision_id", "turn_id").agg(every), decisions.select("decision_id", "session_id", "ts"), turns, entities, held)
    judged = labels.select("decision_id", F.explode("grids").alias("grid"), "hit").groupBy("grid", "decision_id").agg(
        F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("false_positives")
    )
    asked = decisions.select("decision_id", "session_id", "ts", F.explode("spellings").alias("value")).join(_sought(turns, entities), ["session_id", "value"]).where("last > ts").select("decision_id", "value").distinct()
    asked = stored(asked, "sought")
    grids = chosen.select("grid").distinct()
    handed = offered.join(asked.select("decision_id").distinct(), "decision_id", "left_semi").join(held.select("turn_id", "value"), "turn_id").select("grid", "decision_id", "value").distinct()
    missed = asked.crossJoin(F.broadcast(grids)).join(handed, ["grid", "decision_id", "value"], "left_anti").select("grid", "decision_id").distinct().withColumn("misses", F.lit(1))  # a handful of rows
    both = judged.join(missed, ["grid", "decision_id"], "full_outer").fillna(0, ["hits", "false_positives", "misses"])
    return both.withColumn("wasted", ((F.col("hits") == 0) & (F.col("false_positives") > 0)).cast("int"))


def replay_labels(relabels: DataFrame, baseline: int) -> tuple[DataFrame, DataFrame]:
    """Old and new counts of every label by row of the grid (``grid, label, before, after``), and the decisions that change (``grid, decision_id``).

    ``relabels`` is what :func:`relabelled` gives; a decision it lacks under some row has no label there.
    """
    names = {"hits": "hit", "false_positives": "false positive", "misses": "miss", "wasted": "wasted budget"}
    old = relabels.where(F.col("grid") == baseline).select("decision_id", *[F.col(n).alias(f"old_{n}") for n in names])
    grids = relabels.select("grid").distinct()
    both = old.crossJoin(F.broadcast(grids)).join(relabels, ["grid", "decision_id"], "full_outer").fillna(0)  # a handful of rows
    sums = both.groupBy("grid").agg(*[F.sum(f"old_{n}").cast("long").alias(f"old_{n}") for n in names], *[F.sum(n).cast("long").alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"old_{n}").alias("before"), F.col(n).alias("after")) for n, label in names.items()])
    changed = F.lit(False)
    for n in names:
        changed = changed | (F.col(n) != F.col(f"old_{n}"))
    return sums.select("grid", F.explode(rows).alias("r")).select("grid", "r.*"), both.where(changed).select("grid", "decision_id")


DECISION = """session_id string, at_ms long, cwd string, prompt string, watermark_session_no long, spellings array<string>,
candidates array<struct<turn_id: long, relevance: double, entity_score: double, entity_count: long, matched_on: array<struct<kind: string, value: string>>>>,
injected array<struct<turn_id: long, chars: long>>, chars_injected long, suppressed array<struct<turn_id: long, reason: string>>, compacted boolean,
dropped array<long>, thresholds map<string, double>"""


def load_decisions(log: DataFrame, sessions: DataFrame, excluded: DataFrame, column: str = "line") -> DataFrame:
    """Decisions from JSON lines.

    Those made in an excluded folder (``prefix``) are dropped, a missing watermark
    is the highest session number stored now, times become ISO text.
    """
    from threadline.functions.values import iso
    from threadline.sources.records import exclude_projects

    parsed = log.select(F.from_json(column, DECISION).alias("d")).where("d is not null and d.prompt is not null").select("d.*")
    top = sessions.agg(F.max("session_no").alias("__top"))  # one row
    kept = exclude_projects(parsed, excluded).crossJoin(F.broadcast(top))
    at = iso(F.timestamp_millis("at_ms"))
    return kept.withColumn("ts", at).withColumn("watermark_session_no", F.coalesce("watermark_session_no", "__top")).drop("__top")


def injected_turns(decisions: DataFrame) -> DataFrame:
    """``decision_id, turn_id, chars`` of what decisions handed over."""
    return decisions.select("decision_id", F.explode("injected").alias("i")).select("decision_id", "i.turn_id", "i.chars")
