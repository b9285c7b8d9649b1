"""Personal data in text: where it is, and text with it removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern types from the most to the least specific, and how each looks.
PATTERNS: dict[str, str] = {
    "ssn": r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}|\d{3}[-.\s]\d{3}[-.\s]\d{4})(?!\d)",
    "credit_card": r"(?<!\d)(?:\d[ -]?){13,19}(?<=\d)",
    "long_number": r"(?<!\d)\d{9,}(?!\d)",
}
SPAN_TYPE = "array<struct<pattern_type:string,start:int,end:int,value:string>>"
_RANKED = "array<struct<shorter:int,rank:int,start:int,end:int,pattern_type:string,value:string>>"


def _unicode(pattern: str) -> str:
    """Digits, blanks and word borders of every script count, as in the lists above."""
    return "(?U)" + pattern


def pattern_hits(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """Array of the types present (no overlap rule)."""
    return F.array_compact(F.array(*[F.when(text.rlike(_unicode(p)), F.lit(t)) for t, p in patterns.items()]))


def _found(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """Spans of one pattern: what matched, placed by the lengths of the text between matches."""
    gaps = F.transform(F.split(text, _unicode(pattern), -1), lambda g: F.length(g))
    hits = F.transform(F.regexp_extract_all(text, F.lit(_unicode(pattern)), F.lit(0)), lambda h, i: F.struct(h.alias("value"), F.get(gaps, i).alias("gap")))

    def place(done: Column, hit: Column) -> Column:
        start = done["at"] + hit["gap"]
        size = F.length(hit["value"])
        span = F.struct((-size).alias("shorter"), F.lit(rank).alias("rank"), start.alias("start"), (start + size).alias("end"),
                        F.lit(kind).alias("pattern_type"), hit["value"].alias("value"))
        return F.struct((start + size).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_RANKED).alias("spans"))
    return F.aggregate(hits, begin, place)["spans"]


def spans(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Array of spans in reading order. Of overlapping spans the longest stays,
    then the more specific type (extra types come last), then the earlier one.
    Patterns are regular expressions of the JVM. A null text has no spans."""
    whole = F.coalesce(text, F.lit(""))
    patterns = {**PATTERNS, **(extra or {})}
    ranks = {kind: i for i, kind in enumerate(PATTERNS)}
    every = F.array_sort(F.concat(*[_found(whole, kind, ranks.get(kind, len(ranks)), p) for kind, p in patterns.items()]))

    def add(kept: Column, span: Column) -> Column:
        free = F.forall(kept, lambda k: (span["end"] <= k["start"]) | (k["end"] <= span["start"]))
        return F.when(free, F.concat(kept, F.array(span))).otherwise(kept)

    chosen = F.aggregate(every, F.array().cast(_RANKED), add)
    placed = F.transform(chosen, lambda x: F.struct(x["start"].alias("at"), F.struct(x["pattern_type"].alias("pattern_type"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")).alias("span")))
    some = reduce(lambda x, y: x | y, [whole.rlike(_unicode(p)) for p in patterns.values()])
    return F.when(some, F.transform(F.array_sort(placed), lambda x: x["span"])).otherwise(F.array().cast(SPAN_TYPE))


def redact_with(text: Column, spans: Column, replacement: str | None = None) -> Column:
    """``text`` with every span replaced by ``[REDACTED:TYPE]`` or the given text.
    Runs on the spans, from the last to the first, so positions stay valid."""
    def tag(x: Column) -> Column:
        return F.lit(replacement) if replacement is not None else F.concat(F.lit("[REDACTED:"), F.upper(x["pattern_type"]), F.lit("]"))

    return F.aggregate(F.reverse(spans), text, lambda acc, x: F.concat(
        F.substring(acc, F.lit(1), x["start"]), tag(x), F.substring(acc, x["end"] + 1, F.length(acc))))
