"""Column expressions on arrays of half-open spans, struct<start, end>, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _size(x: Column) -> Column:
    return x["end"] - x["start"]


def merged(spans: Column, gap: int = 0, length: Column | None = None) -> Column:
    """In order, clipped to 0 and length, empty ones dropped, those that overlap or stand at most gap apart joined."""
    low = lambda x: F.greatest(x["start"], F.lit(0))
    high = lambda x: x["end"] if length is None else F.least(x["end"], length.cast("int"))
    ordered = F.array_sort(F.filter(F.transform(spans, lambda x: span(low(x), high(x))), lambda x: x["end"] > x["start"]))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(span(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when(last.isNotNull() & (x["start"] <= last["end"] + gap), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, F.array().cast(SPANS), step)


def minus(left: Column, right: Column) -> Column:
    """What left covers and right does not. right: merged()."""

    def cut(acc: Column, r: Column) -> Column:
        before = lambda x: span(x["start"], F.least(x["end"], r["start"]))
        after = lambda x: span(F.greatest(x["start"], r["end"]), x["end"])
        met = lambda x: (x["start"] < r["end"]) & (x["end"] > r["start"])
        pieces = F.flatten(F.transform(acc, lambda x: F.when(met(x), F.array(before(x), after(x))).otherwise(F.array(span(x["start"], x["end"])))))
        return F.filter(pieces, lambda x: x["end"] > x["start"])

    return F.aggregate(right, left.cast(SPANS), cut)


def meet(left: Column, right: Column) -> Column:
    """What both cover, piece by piece."""
    both = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: span(F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])))))
    return F.filter(both, lambda x: x["end"] > x["start"])


def inside(spans: Column, at: Column) -> Column:
    """Whether a place is in a span."""
    return F.exists(spans, lambda x: (x["start"] <= at) & (at < x["end"]))


def covers(spans: Column, start: Column, end: Column) -> Column:
    """Whether one span holds all of [start, end)."""
    return F.exists(spans, lambda x: (x["start"] <= start) & (x["end"] >= end))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda x: (x["start"] < end) & (x["end"] > start))


def holder(spans: Column, at: Column) -> Column:
    """Which span, from 0, a place is in; -1 for none."""
    found = F.transform(spans, lambda x, i: F.when((x["start"] <= at) & (at < x["end"]), i))
    return F.coalesce(F.array_min(F.filter(found, lambda i: i.isNotNull())), F.lit(-1))


def same_context(spans: Column, end: Column, start: Column) -> Column:
    """Whether the last place before end and the place start are in the same span, or both in none."""
    return holder(spans, end - 1) == holder(spans, start)


def shifted(spans: Column, at: Column, delta: Column) -> Column:
    """After an edit at a place that changed the length by delta: spans behind it move, one around it grows."""
    move = lambda p: F.when(p >= at, p + delta).otherwise(p)
    return F.transform(spans, lambda x: span(F.when(x["start"] > at, x["start"] + delta).otherwise(x["start"]), move(x["end"])))


def size(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda s, x: s + _size(x))


def nearest(bands: Column, at: Column) -> Column:
    """The band that is nearest to a place, the first of equals."""
    gap = lambda x: F.greatest(x["start"] - at, at - x["end"] + 1, F.lit(0))
    order = F.array_min(F.transform(bands, lambda x, i: F.struct(gap(x).alias("gap"), i.alias("i"))))
    return F.when(F.size(bands) > 0, F.get(bands, order["i"]))


def longest_run(places: Column) -> Column:
    """The longest stretch of neighbouring places that follow each other without a gap. places: ascending ints."""
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, p: Column) -> Column:
        run = F.when(acc["last"] == p - 1, acc["run"] + 1).otherwise(1)
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(places, zero, step, lambda acc: acc["best"])
