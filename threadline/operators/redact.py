"""Redaction of secrets in text columns, with counts of what was replaced."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.operators.records import parsed_record

# Parts of secret names, and the rules in their order.
FRAGMENTS = ("token", "password", "passwd", "secret", "key", "api", "bearer", "cookie", "authorization")
RULES = ("pem", "userinfo", "header", "json", "assignment", "flag", "jwt", "github", "sk")
MARK = "[redacted]"

SCHEMES = ("bearer", "basic", "digest", "token", "negotiate", "ntlm")

#: What opens a quoted value.
_OPEN = re.compile(r"""\\"|["']""")
_SCHEME = re.compile(rf"(?:{'|'.join(SCHEMES)})\Z", re.I)
_LONGEST_SCHEME = max(map(len, SCHEMES))
_BLANKS = re.compile(r"[ \t]*")
_RUN_END = re.compile(r"""[\s"'\\]|\Z""")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"')

#: Rules that are one replacement each: what to look for first, pattern, text put in its place.
_BEFORE = {
    "pem": ("-----BEGIN ", r"(?s)-----BEGIN [^\n-]*PRIVATE KEY[^\n-]*-----.*?(?:-----END [^\n]*?-----|\z)", "[redacted: a PEM private key block]"),
    "userinfo": ("://", r"""(?U)(?<=://)[^\s/?#"'`\\@]++(?=@)""", MARK),
}
_AFTER = {
    "jwt": ("eyJ", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_.-]{9,}+", "[redacted: a JWT]"),
    "github": ("g", r"(?<![A-Za-z0-9_-])(?:ghp_|gho_|ghu_|ghs_|ghr_|github_pat_)[A-Za-z0-9_-]{6,}+", "[redacted: a GitHub token]"),
    "sk": ("sk-", r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{20,}+", "[redacted: a secret key]"),
}


@lru_cache(maxsize=16)
def _heads(fragments: tuple[str, ...]) -> dict[str, re.Pattern]:
    """What stands before a value whose name is a secret one; no other name starts a match, so none hides the next.

    A name is scanned once: to the first fragment, then to its end, and never
    given back, so that a long run of names takes time in proportion.
    """
    part = f"(?:{'|'.join(map(re.escape, fragments))})"
    header, word = "A-Za-z0-9_-", "A-Za-z0-9_.-"
    return {
        "header": re.compile(rf"(?<![{header}])(?>[{header}]*?{part})[{header}]*+:", re.I),
        "json": re.compile(rf'"(?>[^"\\\n]*?{part})[^"\\\n]*+"\s*+:\s*+(?=")', re.I),
        "assignment": re.compile(rf"(?<![{word}])(?>[{word}]*?{part})[{word}]*+[ \t]*+=++>?[ \t]*", re.I),
        "flag": re.compile(rf"(?<![{word}])-(?>[{word}]*?{part})[{word}]*+[ \t]++", re.I),
    }


def is_secret(name: str, fragments: tuple[str, ...] = FRAGMENTS) -> bool:
    low = name.lower()
    return any(f in low for f in fragments)


class _Values:
    """Where values of a text end.  What one scan has seen is kept, so scans that start inside it are not repeated."""

    def __init__(self, text: str):
        self.text = text
        self.run = (0, -1)
        self.closers: dict[str, tuple[int, int, int]] = {}

    def run_end(self, at: int) -> int:
        """End of the bare run at a place."""
        if not self.run[0] <= at <= self.run[1]:
            self.run = (at, _RUN_END.search(self.text, at).start())
        return self.run[1]

    def closer(self, quote: str, at: int) -> int:
        """The next quote of this kind in the line that no backslash escapes, or -1."""
        if self.text.startswith(quote, at):
            return at
        start, found, line = self.closers.get(quote, (0, -1, -1))
        if not (start <= at < (line if found < 0 else found)):
            line = self.text.find("\n", at)
            line = len(self.text) if line < 0 else line
            found = self.text.find(quote, at + 1, line)
            while found >= 0 and self.text[found - 1] == "\\":
                found = self.text.find(quote, found + 1, line)
            self.closers[quote] = (at, found, line)
        return found

    def span(self, at: int) -> tuple[int, int]:
        """Where the value at a place begins and ends: inside its quotes, or else a bare run; an unpaired quote is left out."""
        opened = _OPEN.match(self.text, at)
        if not opened:
            return at, self.run_end(at)
        end = self.closer(opened[0], opened.end())
        return (opened.end(), end if end >= 0 else self.run_end(opened.end()))

    def is_scheme(self, start: int, end: int) -> bool:
        return end - start <= _LONGEST_SCHEME and _SCHEME.match(self.text[start:end]) is not None


def _headers(text: str, fragments: tuple[str, ...]) -> tuple[str, int]:
    """``name: value``; a scheme's value goes with it, and values of names inside a value are covered."""
    out, copied, hits, values = [], 0, 0, _Values(text)
    for m in _heads(fragments)["header"].finditer(text):
        value = _BLANKS.match(text, m.end()).end()
        start, end = values.span(value)
        if values.is_scheme(start, end):
            end = max(end, values.run_end(_BLANKS.match(text, end).end()))
        if end == start or text.startswith(MARK[:-1], start):
            continue
        if m.end() <= copied:
            copied = max(copied, end)
            continue
        out += [text[copied : m.end()], " ", text[value:start], MARK]
        copied, hits = end, hits + 1
    return "".join([*out, text[copied:]]), hits


def _named(text: str, head: re.Pattern) -> tuple[str, int]:
    out, copied, hits, values = [], 0, 0, _Values(text)
    for m in head.finditer(text):
        start, end = values.span(m.end())
        if m.start() < copied or end == start or text.startswith(MARK[:-1], start):
            continue
        out += [text[copied:start], MARK]
        copied, hits = end, hits + 1
    return "".join([*out, text[copied:]]), hits


def _members(text: str, head: re.Pattern) -> tuple[str, int]:
    out, copied, hits = [], 0, 0
    for m in head.finditer(text):
        value = _STRING.match(text, m.end())
        if m.start() < copied or not value or value[0] == f'"{MARK}"':
            continue
        out += [text[copied : m.end()], f'"{MARK}"']
        copied, hits = value.end(), hits + 1
    return "".join([*out, text[copied:]]), hits


def redact_names(text: str, fragments: tuple[str, ...] = FRAGMENTS) -> tuple[str, list[int]]:
    """Replace the values of secret names; hits of the rules ``header``, ``json``, ``assignment`` and ``flag``."""
    heads = _heads(tuple(fragments))
    text, header = _headers(text, tuple(fragments))
    text, member = _members(text, heads["json"])
    text, assigned = _named(text, heads["assignment"])
    text, flag = _named(text, heads["flag"])
    return text, [header, member, assigned, flag]


def _replaced(text: Column, rules: dict[str, tuple[str, str, str]]) -> tuple[Column, list[Column]]:
    counts = []
    for sign, pattern, put in rules.values():
        seen = F.contains(text, F.lit(sign))
        counts.append(F.when(seen, F.regexp_count(text, F.lit(pattern))).otherwise(0))
        text = F.when(seen, F.regexp_replace(text, pattern, put)).otherwise(text)
    return text, counts


def redact(df: DataFrame, column: str, fragments: tuple[str, ...] = FRAGMENTS) -> DataFrame:
    """Replace secrets in a text column and add ``hits``, an array with a count for each of ``RULES``.

    A rule sees what the ones before it left.  Five of the nine are replacements
    in Spark itself; the other four share one scan in Python, which only texts
    that hold a fragment of a secret name are sent to.
    """
    kind = T.StructType().add("text", "string").add("hits", T.ArrayType(T.IntegerType()))

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([redact_names(t, fragments) if t else (None, None) for t in part], columns=["text", "hits"])

    named = F.col("__text").rlike("(?i)" + "|".join(re.escape(f) for f in fragments))
    text, before = _replaced(F.col(column), _BEFORE)
    step = df.withColumn("__text", text).withColumn("__before", F.array(*before)).withColumn("__done", run(F.when(named, F.col("__text"))))
    left = F.coalesce("__done.text", "__text")
    step = step.withColumn("__text", left)
    text, after = _replaced(F.col("__text"), _AFTER)
    none = F.array(*[F.lit(0)] * (len(RULES) - len(_BEFORE) - len(_AFTER)))
    hits = F.concat("__before", F.coalesce("__done.hits", none), F.array(*after))
    hits = F.when(F.col(column).isNull(), F.array_repeat(F.lit(0), len(RULES))).otherwise(hits)
    return step.withColumn("hits", hits.cast("array<int>")).withColumn(column, text).drop("__text", "__before", "__done")


def hit_counts(redacted: DataFrame, *by: str) -> DataFrame:
    """Hits of each rule by the given columns: ``rule, hits``."""
    rows = redacted.select(*by, F.posexplode("hits").alias("i", "n"))
    rule = F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("i") + 1)
    return rows.groupBy(*by, rule.alias("rule")).agg(F.sum("n").cast("long").alias("hits")).where("hits > 0")


def _walk(value, depth: int, fragments: tuple[str, ...]) -> bool:
    """Replace the strings under secret names, in place; whether there were any."""
    changed = False
    if depth < 8 and isinstance(value, dict):
        for key, inner in value.items():
            if isinstance(inner, str) and is_secret(key, fragments):
                changed |= inner != MARK
                value[key] = MARK
            else:
                changed |= _walk(inner, depth + 1, fragments)
    elif depth < 8 and isinstance(value, list):
        for inner in value:
            changed |= _walk(inner, depth + 1, fragments)
    return changed


def _json(value) -> str:
    """Compact JSON; halves of surrogate pairs stay escapes, as no column can hold them."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _rewritten(records: DataFrame, change) -> DataFrame:
    """Apply ``change`` to the record of every line; a line that holds no record, or that is not changed, stays as it is, byte by byte."""

    @F.pandas_udf(T.StringType())
    def run(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lines:
            out = []
            for line in part:
                record = parsed_record(line)
                out.append(_json(record) if record and change(record) else line)
            yield pd.Series(out)

    return records.withColumn("line", run("line"))


def redact_records(records: DataFrame, fragments: tuple[str, ...] = FRAGMENTS) -> DataFrame:
    """Replace string values under secret-named keys in tool input, tool results and attachments of JSON lines."""

    def change(record: dict) -> bool:
        changed = False
        for key in ("toolUseResult", "attachment"):
            changed |= _walk(record.get(key), 0, fragments)
        message = record.get("message")
        for block in message.get("content") if isinstance(message, dict) and isinstance(message.get("content"), list) else ():
            for key in ("input", "content") if isinstance(block, dict) else ():
                changed |= _walk(block.get(key), 0, fragments)
        return changed

    return _rewritten(records, change)


def reduce_records(records: DataFrame, mode: str = "lean", limit: int = 8192) -> DataFrame:
    """Replace large tool results and attachments by a note of their size.

    ``full`` keeps all, ``lean`` replaces those beyond ``limit`` bytes,
    ``minimal`` all of them; a note is never replaced again.
    """
    if mode == "full":
        return records
    most = limit if mode == "lean" else -1

    def change(record: dict) -> bool:
        changed = False
        for key in ("toolUseResult", "attachment"):
            if key in record and not (isinstance(record[key], dict) and set(record[key]) == {"elidedBytes"}):
                size = len(_json(record[key]).encode())
                if size > most:
                    record[key], changed = {"elidedBytes": size}, True
        return changed

    return _rewritten(records, change)
