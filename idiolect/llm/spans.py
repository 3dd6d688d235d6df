"""Spans of pattern matches with code-point offsets, by SQL functions alone.

A match is framed with a mark and the text split at it, so every second part is a match and the lengths of
the parts before it give its start. The mark is U+0001; one that a text has itself becomes U+0002 first,
which is as long and which no pattern matches either.

Everything is linear in the text but for a logarithm: running sums go through blocks (scan), overlaps are found
by one pass over sorted events, texts are cut up by blocks of characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
#: Characters before a match that context labelers see.
CONTEXT = 40
#: Values of a block of a running total, and characters of a block of a text.
BLOCK, CHARS = 256, 4_096
SPAN = "struct<kind:string,start:bigint,end:bigint,match:string,before:string>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once however often f has it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def scan(values: Column, f: Callable[[Column, Column], Column], first: Column) -> Column:
    """The running results of f over an array of longs. An array grows by copies, so it is done in blocks: their
    totals first, then within each."""

    def grown(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))))

    def blocks(vs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))

    def whole(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, first, f))
        return let(grown(totals, first), lambda starts: F.flatten(F.transform(bs, lambda b, k: F.slice(grown(b, F.get(starts, k)), F.lit(2), F.size(b)))))

    return let(values, lambda vs: F.when(F.size(vs) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks(vs), whole)))


def sums(values: Column) -> Column:
    return scan(values, lambda a, x: a + x, F.lit(0).cast("long"))


def maxima(values: Column) -> Column:
    return scan(values, lambda a, x: F.greatest(a, x), F.lit(-1).cast("long"))


def matches(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches, those kept that pass `keep`. hint: a cheap test that
    every text with a match passes; the others are not searched."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    empty = F.array().cast(f"array<{SPAN}>")

    def spans(ps: Column, ends: Column) -> Column:
        def span(i: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(ps, i).alias("match"), F.substring(F.get(ps, i - 1), -CONTEXT, CONTEXT).alias("before"))

        odd = F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2))
        if keep is not None:
            odd = F.filter(odd, lambda i: keep(F.get(ps, i)))
        return F.transform(odd, span).cast(f"array<{SPAN}>")

    found = let(parts, lambda ps: F.when(F.size(ps) < 3, empty).otherwise(let(sums(F.transform(ps, lambda p: F.length(p).cast("long"))), lambda ends: spans(ps, ends))))
    test = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(test, found).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def against(xs: Column, ys: Column, of_y: Callable[[Column], Column], of_x: Callable[[Column], Column], keep: Callable[[Column, Column], Column]) -> Column:
    """The xs that pass keep(x, greatest end of the ys whose event comes before x's), by events (place, order), in the
    order of the events. -1 where no y comes before."""
    tagged = F.transform(xs, lambda x, i: F.struct(of_x(x).alias("event"), F.lit(-1).cast("long").alias("end"), i.alias("i"), x.alias("x")))

    def kept(events: Column) -> Column:
        return let(maxima(F.transform(events, lambda e: e["end"])), lambda most: F.filter(events, lambda e, k: (e["i"] >= 0) & keep(e["x"], F.get(most, k))))

    def found(ts: Column) -> Column:
        others = F.transform(ys, lambda y: F.struct(of_y(y).alias("event"), y["end"].alias("end"), F.lit(-1).alias("i"), F.get(ts, F.lit(0))["x"].alias("x")))
        return let(F.array_sort(F.concat(ts, others)), kept)

    back = F.array_sort(F.transform(let(tagged, found), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back, lambda e: e["x"])


def event(place: Column, order: int) -> Column:
    return F.struct(place.alias("place"), F.lit(order).alias("order"))


def apart(xs: Column, ys: Column) -> Column:
    """The xs that overlap none of the ys, in their order."""

    def both(a: Column, b: Column) -> Column:
        found = against(a, b, lambda y: event(y["start"], 1), lambda x: event(x["end"], 0), lambda x, most: most <= x["start"])
        return F.when((F.size(a) == 0) | (F.size(b) == 0), a).otherwise(found)

    return let(xs, lambda a: let(ys, lambda b: both(a, b)))


def runs(spans: Column) -> Column:
    """array<struct<start,end>>: what the spans, sorted by start, cover, as maximal runs; touching ones are one."""

    def made(s: Column, most: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(most, i - 1)))

        def run(i: Column, k: Column, at: Column) -> Column:
            last = F.coalesce(F.get(at, k + 1), F.size(s)) - 1
            return F.struct(F.get(s, i)["start"].alias("start"), F.get(most, last).alias("end"))

        return let(fresh, lambda at: F.transform(at, lambda i, k: run(i, k, at)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return let(spans, lambda s: F.when(F.size(s) == 0, empty).otherwise(let(maxima(F.transform(s, lambda x: x["end"])), lambda most: made(s, most))))


def beyond(xs: Column, covered: Column) -> Column:
    """The xs that are not wholly within one of the runs `covered`, in their order."""

    def both(a: Column, b: Column) -> Column:
        found = against(a, b, lambda y: event(y["start"], 0), lambda x: event(x["start"], 1), lambda x, most: most < x["end"])
        return F.when((F.size(a) == 0) | (F.size(b) == 0), a).otherwise(found)

    return let(xs, lambda a: let(covered, lambda b: both(a, b)))


def replaced(text: Column, spans: Column, by: str) -> Column:
    """text with each of the spans, sorted by start, replaced; what overlaps or touches is replaced once."""

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            low, high = F.greatest(a - k * CHARS, F.lit(0)), F.least(b - k * CHARS, F.lit(CHARS))
            return F.substr(F.get(blocks, k), (low + 1).cast("int"), (high - low).cast("int"))

        numbers = F.sequence(F.floor(a / CHARS).cast("int"), F.floor((b - 1) / CHARS).cast("int"))
        return F.when(a < b, F.array_join(F.transform(numbers, part), "")).otherwise("")

    def pieces(blocks: Column, rs: Column, size: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(rs)), lambda i: cut(blocks, F.coalesce(F.get(rs, i - 1)["end"], F.lit(0).cast("long")), F.coalesce(F.get(rs, i)["start"], size)))
        return F.array_join(gaps, by)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))
    done = let(blocks, lambda bs: let(runs(spans), lambda rs: pieces(bs, rs, F.length(text).cast("long"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
