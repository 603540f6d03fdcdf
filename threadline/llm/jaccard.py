"""N-gram Jaccard join (operator 9): exact links between sets of word shingles, searched around pivots.

Unrelated texts are all at distance 1 from each other, so pivots drawn from the
whole space would put every record into every window.  The space is therefore
divided by shared shingles first, and pivots divide what is left:

* Records with the same set are one point from the start.  A record takes part
  only if enough of its shingles occur elsewhere for it to link at all; this is
  tested on its lowest hashes first and then on the whole sets of those left.
* A region holds the records that share one shingle among the first of an order
  by frequency, the rarest first.  Two records close enough to link share such a
  shingle, so every link lies inside some region.
* Every region takes as its pivot the record whose shingles occur in most other
  records.  Regions with the same pivot make up its cell; a record at the border
  of several lies in each of their cells.  Each member's distance to the pivot is
  measured once, which links those that are near enough.
* In a cell of a few members the pairs whose two distances allow a link by the
  triangle inequality are tested at once.
* Inside a larger cell, what a member differs in from the pivot stands for the member:
  the symmetric difference of two members is that of their differences from the
  pivot.  Members that are both linked with the pivot are joined already.  For
  any other pair the triangle inequality asks that their differences have
  elements in common, and how many, by both distances to the pivot.  So the
  members are divided again by shared elements of their differences, rarest
  first; an element's place in the order tightens the window of distances in
  which partners may lie.  These are the regions of the next level: large ones
  take pivots again, others test the pairs inside the windows.

No link is lost: every exclusion above is a proven bound.  After ``LEVELS``
levels regions of any size test the pairs inside their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest, xxh64_intdigest

from .common import Workspace, connected_components, tidy

#: Cells of up to so many members test the pairs that their distances allow, larger ones are divided again.
SMALL = 16
#: Regions inside a cell up to this size test the pairs in their windows, larger ones take pivots again.
SMALL_IN_CELL = 512
#: Levels of regions; those of the last test their pairs whatever their size.
LEVELS = 4
#: Ids of records that may be sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of sets that may be sent to all executors.
BROADCAST_BYTES = 32 << 20
#: Shingles of a batch of texts or pairs that are held at once.
HELD = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams.

    Words are split at ASCII white space, A-Z are lower-cased.  A text with
    fewer words than ``width`` is one shingle, one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + count]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any set it links with, at least."""
    return -(-n * percent // 100)


def lowest_hashes(n: int, percent: int) -> tuple[int, int]:
    """How many of its lowest hashes a record looks at, and the m it does so for.

    The first m hashes that two linked sets have in common lie, in any order,
    among the first ``n - least_common(n) + m`` of either.
    """
    m = max(1, n // 10)
    return (n - least_common(n, percent) + m, m) if n else (0, 0)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64, copy=False).view(np.int64)))


def _sets_of(docs: DataFrame, key: str, text: str, width: int, percent: int | None) -> DataFrame:
    """``doc, n, set, hashes``: size and digest of each set, and its hashes.

    With ``percent`` only the lowest hashes that :func:`lowest_hashes` asks for.
    """
    names = ["doc", "n", "set", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, sizes, sets, hashes = 0, 0, [], [], []
            for at, cell in enumerate(batch.column(1)):
                s = shingle_set(cell.as_py(), width)
                data = s.tobytes()
                sizes.append(len(s))
                sets.append(xxh3_128_hexdigest(data) if data else None)
                hashes.append(s if percent is None else s[: lowest_hashes(len(s), percent)[0]])
                held += len(hashes[-1])
                if held >= HELD or at == batch.num_rows - 1:
                    columns = [pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), _lists(hashes)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at + 1 - begin), *columns], names=names)
                    begin, held, sizes, sets, hashes = at + 1, 0, [], [], []

    schema = "doc long, n long, set string, hashes array<long>"
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool) -> DataFrame:
    """``a, b, na, nb, linked, apart``, and with ``differences`` also ``diff``: pairs compared by their whole sets.

    ``apart`` is the size of the symmetric difference and ``diff`` its hashes.
    The sets that the pairs name are summed up first: if they are few bytes they
    are sent to the pairs, else the pairs are shuffled to them.
    """
    names = ["a", "b", "na", "nb", "linked", "apart", *["diff"] * differences]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, linked, apart, diffs = 0, 0, [], [], []
            for at, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                less, more = (x, y) if len(x) <= len(y) else (y, x)
                place = np.minimum(np.searchsorted(more, less), len(more) - 1)
                same = more[place] == less
                common = int(same.sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
                apart.append(len(x) + len(y) - 2 * common)
                if differences:
                    other = np.ones(len(more), bool)
                    other[place[same]] = False
                    diffs.append(np.concatenate([less[~same], more[other]]))
                    held += len(diffs[-1])
                if held >= HELD or at == batch.num_rows - 1:
                    columns = [pa.array(linked, pa.bool_()), pa.array(apart, pa.int64()), *[_lists(diffs)] * differences]
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, at + 1 - begin) for c in batch.columns[:4]), *columns], names=names)
                    begin, held, linked, apart, diffs = at + 1, 0, [], [], []

    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    used = sets.join(named, "id", "left_semi")
    size = used.agg(F.coalesce(F.sum(8 * F.col("n") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        sets = F.broadcast(used)
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("y"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y")
    schema = "a long, b long, na long, nb long, linked boolean, apart long" + ", diff array<long>" * differences
    return joined.mapInArrow(tidy(run), schema)


def set_classes(rows: DataFrame) -> DataFrame:
    """``set, rep, repeated, id``: one record for each distinct set; store it before use, so that the ids stay.

    ``rep`` is the lowest key that has the set, ``repeated`` whether several rows of that key have it.
    """
    counted = rows.where("set is not null").groupBy("set", "doc").agg(F.count(F.lit(1)).alias("c"))
    classes = counted.groupBy("set").agg(F.min("doc").alias("rep"), F.min_by("c", "doc").alias("c"))
    return classes.select("set", "rep", F.coalesce(F.col("c") > 1, F.lit(True)).alias("repeated"), F.monotonically_increasing_id().alias("id"))


def key_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the sets of each key that has more than one."""
    several = rows.where("doc is not null and set is not null").groupBy("doc").agg(F.min("set").alias("least"), F.max("set").alias("most"))
    several = several.where("least < most").select("doc")
    ids = rows.join(several, "doc").join(classes.select("set", F.col("id").alias("b")), "set").select("doc", "b")
    return ids.join(ids.groupBy("doc").agg(F.min("b").alias("a")), "doc").where("a < b").select("a", "b").distinct()


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _small(df: DataFrame) -> DataFrame:
    """Marks a table of records for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def promising_sets(docs: DataFrame, rows: DataFrame, classes: DataFrame, key: str, text: str, width: int, percent: int, space: Workspace) -> DataFrame:
    """``id, n, hashes``: the sets of which enough lowest hashes occur in other sets."""
    one_each = _small(classes.select("set", F.col("rep").alias("doc"), "id"))
    own = rows.join(one_each, (rows["set"] == one_each["set"]) & rows["doc"].eqNullSafe(one_each["doc"])).select("id", "n", "hashes")
    entries = own.select("id", F.explode("hashes").alias("h"))
    # a repeated row makes its own hashes look shared, which lets a set in, not out
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    have = space.store(entries.join(shared, "h").groupBy("id").agg(F.count(F.lit(1)).alias("have")), "have")
    # as many as the smallest set it may link with looks for
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    sizes = rows.select("set", "n").distinct().join(classes, "set")
    live = space.store(sizes.join(have, "id").where(F.col("have") >= needed).select("id", "set", "repeated", F.col("rep").alias("__doc")), "live")
    few = _small(live.select("id", "set", "repeated", "__doc"))
    texts = docs.join(_small(live.select("__doc").distinct()), F.col(key).cast("long").eqNullSafe(F.col("__doc")), "left_semi")
    # a key may have several texts: each set comes from its own
    whole = _sets_of(texts, key, text, width, None).withColumnRenamed("set", "__set")
    whole = whole.join(few, (F.col("__set") == F.col("set")) & F.col("doc").eqNullSafe(F.col("__doc"))).select("id", "n", "hashes", "repeated")
    whole = space.store(whole, "sets")
    once = space.store(whole.where("repeated").dropDuplicates(["id"]), "sets")
    return whole.where("not repeated").unionByName(once).select("id", "n", "hashes")


def _by_rarity(entries: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """``keys, shared``: each record's elements ``h`` that others have as well, as ``(df, h)`` from the rarest on."""
    counted = entries.groupBy(*within, "h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return entries.join(counted, [*within, "h"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))


def shingle_regions(sets: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Regions of the first level: ``r, id, n, w`` with a row for each rare shingle that a record is searched by.

    ``w`` is how many other records a shingle of the record occurs in on average.
    """
    ranked = _by_rarity(sets.select("id", F.explode("hashes").alias("h")), ["id"], []).join(sets.select("id", "n"), "id")
    # its own shingles, found nowhere else, come first in the order
    first = F.size("shared") - F.ceil(F.col("n") * percent / 100) + 1
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["df"] - 1) / F.col("n")
    ranked = ranked.select("id", "n", weight.alias("w"), F.slice("shared", 1, F.greatest(F.lit(0), first.cast("int"))).alias("own"))
    return space.store(ranked.select(F.explode("own.h").alias("r"), "id", "n", "w"), "regions")


def cell_regions(cells: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Regions inside cells: ``p, r, id, n, w, apart, place, near``.

    ``cells`` has the columns ``p, id, n, w, near, apart, diff``.  ``place`` is the
    element's place, from 1, among the record's differences from the pivot.
    """
    far = cells.groupBy("p").agg(F.min("near").alias("all")).where("not all").select("p")
    inside = space.store(cells.join(far, "p"), "differences")
    entries = inside.select("p", "id", F.explode("diff").alias("h"))
    ranked = _by_rarity(entries, ["p", "id"], ["p"]).join(inside.drop("diff"), ["p", "id"])
    own = F.col("apart") - F.size("shared")
    # places that any partner's window can reach
    last = F.when(F.col("near"), 1 + F.floor(F.col("apart") * 100 / (100 + percent))).otherwise(
        F.least(F.col("apart"), 1 + F.floor(F.col("n") * (100 - percent) / percent))
    )
    ranked = ranked.withColumn("own", own).withColumn("room", F.greatest(F.lit(0), (last - own).cast("int")))
    out = ranked.select("p", "id", "n", "w", "apart", "near", "own", F.posexplode(F.slice("shared", 1, F.col("room"))).alias("k", "s"))
    return space.store(out.select("p", F.col("s.h").alias("r"), "id", "n", "w", "apart", (F.col("own") + F.col("k") + 1).alias("place"), "near"), "regions")


def _window(percent: int) -> Column:
    """Whether the distances of two members of a cell to its pivot, and their common element's places, allow a link.

    A link needs ``(x.apart + y.apart - slack) / 2`` common differences, where
    slack is the largest symmetric difference of linked sets of their sizes;
    after the first common one, at a record's ``place``, at most the rest of its
    differences follow.
    """
    both = F.col("x.apart") + F.col("y.apart")
    least = (100 + percent) * both - (100 - percent) * (F.col("x.n") + F.col("y.n"))
    reach = lambda side: 2 * (100 + percent) * (1 + F.col(f"{side}.apart") - F.col(f"{side}.place")) >= least
    return reach("x") & reach("y") & ~(F.col("x.near") & F.col("y.near"))


def _near_pivots(cells: DataFrame, sets: DataFrame, percent: int, differences: bool) -> DataFrame:
    """``p, id, n, near, apart, w``, and with ``differences`` ``diff``: every member of a cell (``q, id, w``) measured against its pivot."""
    measured = _compared(cells.select(F.col("q").alias("a"), F.col("id").alias("b")), sets, percent, differences)
    found = measured.select(F.col("a").alias("p"), F.col("b").alias("id"), F.col("nb").alias("n"), F.col("linked").alias("near"), "apart", *["diff"] * differences)
    return found.join(cells.select("id", "w").distinct(), "id")


def _triangle(percent: int) -> Column:
    """Whether two members' distances to their pivot allow a link: the differences they must share are no more than the nearer one has."""
    least = (100 + percent) * (F.col("x.apart") + F.col("y.apart")) - (100 - percent) * (F.col("x.n") + F.col("y.n"))
    return (2 * (100 + percent) * F.least("x.apart", "y.apart") >= least) & ~(F.col("x.near") & F.col("y.near"))


def find_links(sets: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Links ``a, b, p`` between ids of sets, enough to connect what all links would connect; ``p`` is the pivot in whose cell each was found."""
    regions = shingle_regions(sets, percent, space)
    sizes = regions.groupBy("r").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("w", (-F.col("id")).alias("least"))).alias("top"))
    sizes = sizes.where("members > 1").select("r", (-F.col("top.least")).alias("q"))
    cells = space.store(regions.join(sizes, "r").where(F.col("id") != F.col("q")).select("q", "id", "w").distinct(), "cells")
    space.drop(regions)
    crowds = cells.groupBy("q").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > SMALL).select("q")
    # few members: what their distances allow is tested at once
    few = space.store(_near_pivots(cells.join(crowds, "q", "left_anti"), sets, percent, False), "measured")
    allowed = (F.col("x.id") < F.col("y.id")) & _alike(F.col("x.n"), F.col("y.n"), percent) & _triangle(percent)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.p") == F.col("y.p")) & allowed).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.min("x.p").alias("p"))
    links = few.where("near").select(F.col("p").alias("a"), F.col("id").alias("b"), "p").unionByName(_linked(space.store(pairs, "pairs"), sets, percent))
    links = space.store(links, "links")
    large = cells.join(crowds, "q", "left_semi")
    level = 1
    while not large.isEmpty():
        measured = space.store(_near_pivots(large, sets, percent, True), "measured")
        links = space.store(links.unionByName(measured.where("near").select(F.col("p").alias("a"), F.col("id").alias("b"), "p")), "links")
        regions = cell_regions(measured, percent, space)
        space.drop(measured)
        sizes = regions.groupBy("p", "r").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("w", (-F.col("id")).alias("least"))).alias("top"))
        sizes = sizes.where("members > 1").select("p", "r", "members", (-F.col("top.least")).alias("q"))
        sized = space.store(regions.join(sizes, ["p", "r"]), "sized")
        space.drop(regions)
        level += 1
        last = level >= LEVELS
        small = sized if last else sized.where(F.col("members") <= SMALL_IN_CELL)
        at = (F.col("x.r") == F.col("y.r")) & (F.col("x.p") == F.col("y.p"))
        allowed = (F.col("x.id") < F.col("y.id")) & _alike(F.col("x.n"), F.col("y.n"), percent) & _window(percent)
        pairs = small.alias("x").join(small.alias("y"), at & allowed).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.min("x.p").alias("p"))
        large = sized.where((F.col("members") > SMALL_IN_CELL) & (F.col("id") != F.col("q")) & F.lit(not last))
        large = space.store(large.select("q", "id", "w").distinct(), "cells")
        links = space.store(links.unionByName(_linked(space.store(pairs, "pairs"), sets, percent)), "links")
        space.drop(sized)
    return links


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b, p`` that whole sets link."""
    return _compared(pairs, sets, percent, False).where("linked").select("a", "b").join(pairs, ["a", "b"])


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Every record's shingle count and component: ``<key>, n_shingles, component_id``.

    Records link when ``100 * common >= percent * either`` for their shingle
    sets.  The component id is the smallest key reachable by links, the record's
    own included.  Rows of equal key count as one record with all their texts, and
    share its component.  A null text, or one without words, links with nothing, not
    even its like.  Repeated rows get the same result each.  A null key is no key:
    its rows' components are null unless they link with a row that has one; the
    key must be an integer.  An empty table stays empty, other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "jaccard")
    lowest = space.store(_sets_of(docs, key, text, width, percent), "lowest")
    rows = space.store(lowest.select("doc", "n", "set"), "rows")
    classes = space.store(set_classes(rows), "classes")
    sets = promising_sets(docs, lowest, classes, key, text, width, percent, space)
    space.drop(lowest)
    links = find_links(sets, percent, space)
    parts = connected_components(links.select("a", "b").unionByName(key_links(rows, classes)))
    named = classes.join(parts, F.col("id") == F.col("node"), "left").select("set", "rep", F.coalesce("component", "id").alias("part"))
    named = space.store(named, "named")
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "part").select("set", "component_id")
    found = rows.join(named, "set", "left")
    found = found.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return space.finish(found, "classes")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One record of each component, that of the smallest key; all columns pass through.

    Records with a null key stay, and of repeated rows (equal key and text) one stays.
    """
    classes = similarity_classes(docs, key, text, width, percent)
    others = classes.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__other")).distinct()
    kept = docs.join(others, F.col(key) == F.col("__other"), "left_anti")
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([key, text])
