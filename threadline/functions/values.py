"""Column expressions over JSON records, paths, times and text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seven-bit letters and digits on either side decide whether a match stands alone.
_ALNUM = "A-Za-z0-9"
#: Fixed value: bytes of pieces of identifiers that are added to a text.
EXPANSION_BYTES = 128 * 1024
#: Code points of Latin letters with marks.
ACCENTED = (range(0xC0, 0x250), range(0x1E00, 0x1F00))


def variant(line: Column | str) -> Column:
    """A record as VARIANT; null where the line is no JSON."""
    return F.try_parse_json(line)


def string_at(v: str, path: str) -> Column:
    """The JSON string at a path; null for any other type."""
    return F.expr(
        f"case when schema_of_variant(try_variant_get({v}, '{path}', 'variant')) = 'STRING' "
        f"then try_variant_get({v}, '{path}', 'string') end"
    )


def bound(value: Column, make) -> Column:
    """``make`` of a value that is worked out once, however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def string_in(v: Column, path: str) -> Column:
    """:func:`string_at` of any column, such as a bound one."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def flag_in(v: Column, path: str) -> Column:
    """True where the JSON value at a path of a VARIANT is ``true``."""
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def blocks_at(v: str, path: str = "$.message.content") -> Column:
    """The array of content blocks, empty where the content is no array."""
    return F.expr(f"coalesce(try_variant_get({v}, '{path}', 'array<variant>'), array())")


def iso(ts: Column) -> Column:
    """A timestamp as fixed-width UTC text; such texts compare as times do."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_error(text: Column, limit: int = 512) -> Column:
    """An error's shape: times, ids, addresses and line numbers become placeholders.

    Bare integers stay, white space collapses and the result is cut to ``limit``
    bytes at a character boundary.
    """
    alone, end = f"(?<![{_ALNUM}])", f"(?![{_ALNUM}])"
    steps = [
        (
            alone + r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]++|(?!\.))"
            r"(?:Z|[+-][0-9]{2}(?::[0-9]{2}|(?!:))|(?![Z+-]))" + end,
            "<ts>",
        ),
        (alone + r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}" + end, "<uuid>"),
        (alone + r"0x[0-9a-fA-F]+" + end, "<addr>"),
        (rf"(?<=[{_ALNUM}>]):[0-9]++(?::[0-9]++)?+" + end, ":<line>"),
    ]
    for pattern, mark in steps:
        text = F.regexp_replace(text, pattern, mark)
    return bound(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda flat: clip_bytes(flat, limit))


def clip_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that splits no character."""
    raw = F.encode(text, "UTF-8")
    tries = [F.expr("null").cast("string")]
    tries = [F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*tries))


def lexical_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` and doubled slashes without looking at any disk."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(F.array_join(walked, "/"))


@cache
def accents() -> tuple[str, str]:
    """Latin letters that are a plain letter with one mark, and those plain letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for block in ACCENTED for c in block]
    marked = [(c, d[0]) for c, d in pairs if len(d) == 2 and unicodedata.combining(d[1])]
    return "".join(c for c, _ in marked), "".join(d for _, d in marked)


def folded(text: Column) -> Column:
    """Lower-cased text without accents, as long as the text itself."""
    return F.translate(F.lower(text), *accents())


def tokens(text: Column) -> Column:
    """Lower-cased words without accents: runs of letters and digits."""
    return F.filter(F.split(folded(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def camel_pieces(text: Column) -> Column:
    """Pieces of mixed-case words, as written, in order."""
    words = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t.rlike(r"[\p{IsLowercase}\p{N}]\p{IsUppercase}|\p{IsUppercase}\p{IsUppercase}\p{IsLowercase}"))
    cut = r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
    return F.flatten(F.transform(words, lambda w: F.split(w, cut)))


def expanded(text: Column, limit: int = EXPANSION_BYTES) -> Column:
    """The text and, after it, the pieces of its identifiers that it does not hold as words, ``limit`` bytes of them at most."""
    pieces = F.array_distinct(F.transform(camel_pieces(text), lambda p: F.lower(p)))
    extra = bound(pieces, lambda some: F.when(F.size(some) > 0, F.array_except(some, F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"))).otherwise(some))
    size = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p) + 1)
    # pieces are kept as long as the sum of their bytes, a blank before each, fits
    fitting = lambda some: F.aggregate(
        some,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("kept"), F.lit(True).alias("open")),
        lambda a, p: F.when(
            a["open"] & (a["n"] + F.octet_length(p) + 1 <= limit),
            F.struct((a["n"] + F.octet_length(p) + 1).cast("long").alias("n"), (a["kept"] + 1).alias("kept"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["n"].alias("n"), a["kept"].alias("kept"), F.lit(False).alias("open"))),
    )["kept"]
    kept = bound(extra, lambda some: F.when(size(some) <= limit, some).otherwise(F.slice(some, 1, fitting(some))))
    return F.concat(text, bound(kept, lambda some: F.when(F.size(some) > 0, F.concat(F.lit(" "), F.array_join(some, " "))).otherwise("")))


def excerpt(text: Column, words: Column, width: int = 240, lead: int = 80) -> Column:
    """A window of the flattened text, a little before the first query word; ``...`` marks each cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    low = folded(flat)
    places = F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1))
    start = F.when(F.length(flat) <= width, 1).otherwise(F.greatest(F.lit(1), F.least(first - lead, F.length(flat) - width + 1)))
    body = F.substring(flat, start, F.lit(width))
    return F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(start + width - 1 < F.length(flat), "...").otherwise(""))
