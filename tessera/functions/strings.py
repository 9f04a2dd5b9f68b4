"""Small scalar functions: escaping, cutting, numbers, addresses, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What file names must not hold, and how long they are.
RESERVED, LONGEST_NAME = r'[\x00-\x1F\x7F<>:"/\\|?*]', 120


def html_escaped(text: Column) -> Column:
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text


def json_quoted(text: Column) -> Column:
    """A JSON string; null is null."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1))


def file_name(text: Column) -> Column:
    """Without signs that file systems reserve, dots and blanks at the ends, and no longer than they take; never empty."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), RESERVED, "_"), r"^[ .]+|[ .]+$", "")
    cut = F.regexp_replace(F.substring(plain, 1, LONGEST_NAME), r"[ .]+$", "")
    return F.when(cut == "", "untitled").otherwise(cut)


def cut(text: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis where some are missing."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def share(value: Column) -> Column:
    """A rate between 0 and 100; what is no number is 0."""
    return F.least(F.greatest(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.2f", share(value)), F.lit("%"))


def digest(text: Column) -> Column:
    """A number that tells whether a text has changed."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def url_rank(url: Column) -> Column:
    """How likely an address is a paper's file: 0 a PDF, 1 a download, 2 a page, 3 no web address."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(~low.rlike("^https?://[^/]+"), 3).when(low.rlike(r"[.]pdf(?:$|[?#])"), 0).when(low.rlike("/(?:pdf|download|fulltext)(?:/|$|[?#])"), 1).otherwise(2)


def changed(before: Column, after: Column) -> Column:
    """The stretch that differs between two texts: struct<start, end_before, end_after>, from their common head and tail. One null text is empty."""
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    n = F.least(F.length(a), F.length(b))
    zero = F.lit(0)
    # the longest common head and tail by halving: compared as prefixes, so no character is looked at alone
    steps = F.sequence(F.lit(0), F.lit(30))

    def grown(same) -> Column:
        return F.aggregate(steps, zero, lambda k, s: F.when((k + F.pow(F.lit(2), 30 - s) <= n) & same((k + F.pow(F.lit(2), 30 - s)).cast("int")), (k + F.pow(F.lit(2), 30 - s)).cast("int")).otherwise(k))

    head = grown(lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    tail = F.least(grown(lambda k: F.right(a, k) == F.right(b, k)), n - head)
    return F.struct(head.alias("start"), (F.length(a) - tail).alias("end_before"), (F.length(b) - tail).alias("end_after"))


#: A text with places from here on is not put together.
MOST_PLACES = 20_000


def from_inverted(index: Column) -> Column:
    """A text from its inverted index, map<word, array<place>>: of words at one place the first in the map, places below 0 passed over.
    Empty for no map, no place, or a place of 20,000 or more."""
    entries = F.coalesce(F.map_entries(index), F.array().cast("array<struct<key:string,value:array<int>>>"))
    pairs = F.flatten(F.transform(entries, lambda e, i: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p >= 0), lambda p: F.struct(p.cast("int").alias("p"), i.alias("i"), e["key"].alias("w")))))
    placed = F.array_sort(pairs)
    first = F.filter(placed, lambda x, i: (i == 0) | (F.get(placed, i - 1)["p"] != x["p"]))
    return F.when(F.coalesce(F.array_max(placed)["p"], F.lit(0)) >= MOST_PLACES, "").otherwise(F.array_join(F.transform(first, lambda x: x["w"]), " "))


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """A JSON template with {{name}} replaced by quoted values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), json_quoted(value))
    return out


def mapped(response: Column, paths: Mapping[str, str]) -> Column:
    """Fields of a JSON response by path, null where it has none."""
    return F.struct(*[F.get_json_object(response, p).alias(n) for n, p in paths.items()])


def defect(before: Column, after: Column) -> Column:
    """What is wrong with a rewritten text: empty, mask, head, tail, doubled, shorter, longer or nothing (null)."""
    a, b = F.length(F.trim(before)), F.length(F.trim(after))
    low = F.trim(after)
    return (
        F.when(b == 0, "empty")
        .when(low.rlike("[-]"), "mask")
        .when(low.rlike(r"^[,;:.!?，；：。！？、]"), "head")
        .when(~F.trim(before).rlike(r"[,;:，；：、]$") & low.rlike(r"[,;:，；：、]$"), "tail")
        .when(low.rlike(r"[,;:，；：、。]{2}"), "doubled")
        .when(b < 0.6 * a, "shorter")
        .when(b > 2 * a, "longer")
    )


def confidence(auc: Column, per_mille: Column, budget: float, measured: Column) -> Column:
    """high, medium or low: from how well a score tells the sides apart and how often it errs."""
    return F.when(~measured, "low").when((auc >= 0.9) & (per_mille <= budget), "high").when((auc >= 0.8) & (per_mille <= 2 * budget), "medium").otherwise("low")


def top_tally(items: Column, most: int = 3) -> Column:
    """The commonest items of an array as "a 3, b 1", ties in order of the items."""
    kinds = F.transform(F.array_distinct(items), lambda x: F.struct((-F.size(F.filter(items, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_join(F.transform(F.slice(F.array_sort(kinds), 1, most), lambda k: F.concat(k["x"], F.lit(" "), (-k["n"]).cast("string"))), ", ")


def alias(engine: Column, aliases: Mapping[str, str]) -> Column:
    """One name for each of several: lower case, trimmed, then as the table says."""
    low = F.lower(F.trim(engine))
    table = F.create_map(*map(F.lit, chain.from_iterable(aliases.items()))) if aliases else None
    return F.coalesce(F.try_element_at(table, low), low) if table is not None else low


def ranges(starts: Sequence[int], sizes: Sequence[int], start: int, end: int) -> list[tuple[int, int, int]]:
    """A submitted stretch as (paragraph, start, end) in each paragraph that it meets."""
    return [(k, max(start - s, 0), min(end - s, n)) for k, (s, n) in enumerate(zip(starts, sizes, strict=True)) if max(start, s) < min(end, s + n)]
