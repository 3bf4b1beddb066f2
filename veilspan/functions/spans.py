"""Span algebra as Column functions: arrays of ``struct<kind, start, end>`` with half-open code-point offsets.

Everything here is a Catalyst expression over one row; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"


def named(**fields: Column) -> Column:
    """A struct whose field names no rule can strip, as happens to aliases beside a generator."""
    return F.named_struct(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def span(kind: Column | str, start: Column, end: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return named(kind=kind, start=start.cast("int"), end=end.cast("int"))


def _empty() -> Column:
    return F.array().cast(SPANS)


def ranked(spans: Column) -> Column:
    """Spans sorted by start, then longer first, then by their place in the input."""
    placed = F.transform(spans, lambda s, i: named(a=s["start"], b=s["start"] - s["end"], i=i, s=s))
    return F.transform(F.array_sort(placed), lambda x: x["s"])


def without_overlaps(spans: Column) -> Column:
    """Greedy choice from the left: earliest start, then longest, then first in the input. Null gives an empty array."""
    keep = lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(s))).otherwise(acc)
    return F.aggregate(ranked(F.coalesce(spans, _empty())), _empty(), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(keep(acc, s)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def excluding(spans: Column, reserved: Column) -> Column:
    """Spans that touch no character of a reserved span; one that does is dropped whole."""
    return F.filter(F.coalesce(spans, _empty()), lambda s: ~F.exists(F.coalesce(reserved, _empty()), lambda r: overlap(s, r)))


def union(*lists: Column) -> Column:
    """Lists of spans one after another; the order is the rank for ties."""
    return F.flatten(F.array(*(F.coalesce(x, _empty()) for x in lists)))


def priority(*lists: Column) -> Column:
    """Each list without overlaps, and without spans that touch one of an earlier list."""
    kept = without_overlaps(lists[0])
    for spans in lists[1:]:
        kept = union(kept, excluding(without_overlaps(spans), kept))
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def merged(spans: Column) -> Column:
    """Overlapping or touching spans as one; the kind of the first one stays."""
    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["kind"], last["start"], F.greatest(last["end"], s["end"]))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.concat(acc, F.array(s)))

    first = lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(add(acc, s))
    return F.aggregate(ranked(F.coalesce(spans, _empty())), _empty(), first)


def joined_fragments(text: Column, spans: Column) -> Column:
    """Person fragments trimmed of blanks and joined when they touch or only blanks lie between them."""
    def trimmed(s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        start = s["start"] + F.length(value) - F.length(F.ltrim(value))
        return span(s["kind"], start, start + F.length(F.trim(value)))

    clean = F.filter(F.transform(F.coalesce(spans, _empty()), trimmed), lambda s: s["end"] > s["start"])

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["kind"], last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((s["start"] <= last["end"]) | (F.trim(gap) == ""), longer).otherwise(F.concat(acc, F.array(s)))

    first = lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(add(acc, s))
    return F.aggregate(ranked(clean), _empty(), first)


def best_by_confidence(candidates: Column) -> Column:
    """Of ``struct<kind,start,end,confidence>``, the most confident first, skipping overlaps; in order of start."""
    placed = F.transform(candidates, lambda s, i: named(a=-s["confidence"], i=i, s=s))
    ordered = F.transform(F.array_sort(placed), lambda x: span(x["s"]["kind"], x["s"]["start"], x["s"]["end"]))
    keep = lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_sort(F.aggregate(ordered, _empty(), keep), lambda a, b: a["start"] - b["start"])


def total_length(spans: Column) -> Column:
    return F.aggregate(F.coalesce(spans, _empty()), F.lit(0), lambda acc, s: acc + s["end"] - s["start"])


def common_length(a: Column, b: Column) -> Column:
    """Sum over all pairs of one span of each list of the characters both cover."""
    shared = lambda s, r: F.greatest(F.lit(0), F.least(s["end"], r["end"]) - F.greatest(s["start"], r["start"]))
    return F.aggregate(F.coalesce(a, _empty()), F.lit(0), lambda acc, s: acc + F.aggregate(F.coalesce(b, _empty()), F.lit(0), lambda x, r: x + shared(s, r)))


def characters(text: Column) -> Column:
    """The text with four bytes a character, so that a slice of it costs its own length, wherever it lies."""
    return F.encode(text, "UTF-32")


def solid_length(chars: Column, start: Column, end: Column) -> Column:
    """Number of characters between two offsets of ``characters(text)`` that are not white space."""
    piece = F.decode(F.substring(chars, 4 * start + 1, 4 * F.greatest(end - start, F.lit(0))), "UTF-32")
    return F.length(F.regexp_replace(piece, r"(?U)\s+", ""))


def positions(text: Column, spans: Column) -> Column:
    """Distinct places of the characters covered that are not white space."""
    chars = characters(text)
    run = lambda s: F.filter(F.sequence(s["start"], s["end"] - 1), lambda i: solid_length(chars, i, i + 1) > 0)
    real = F.filter(F.coalesce(spans, _empty()), lambda s: s["end"] > s["start"])
    return F.array_distinct(F.flatten(F.transform(real, run)))


def covered(gold: Column, predicted: Column) -> Column:
    """Whether the places of ``gold`` all lie in ``predicted`` (arrays of places)."""
    return F.size(F.array_except(gold, predicted)) == 0


def values(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


def spellings(text: Column, spans: Column) -> Column:
    """The distinct spellings of person names."""
    return F.array_distinct(values(text, F.filter(spans, lambda s: s["kind"] == "person_name")))


def replaced(text: Column, spans: Column, replacements: Column) -> Column:
    """``text`` with each of the ordered spans replaced by the string at its place in ``replacements``."""
    n = F.size(spans)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    pieces = F.zip_with(gaps, replacements, lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    return F.when(n == 0, text).otherwise(F.array_join(pieces, ""))


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of all matches of a Java pattern, or of its first group when ``group`` is 1 and stands last in the match.

    Spark gives matches but no offsets; they come back from the gaps that ``split`` leaves between the matches. The
    pattern must not match the empty string. Null text gives null.
    """
    rx = F.lit(f"(?U){pattern}")
    found, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, f"(?U){pattern}", -1)
    inner = F.regexp_extract_all(text, rx, F.lit(group))
    triples = F.arrays_zip(found.alias("m"), inner.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    start = named(at=F.lit(0), out=_empty())

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["g"]) + F.length(x["m"])
        return named(at=end, out=F.concat(acc["out"], F.array(span(kind, end - F.length(x["v"]), end))))

    return F.aggregate(triples, start, step, lambda acc: acc["out"])
