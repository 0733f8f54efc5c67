"""Column expressions that several operators use: binding, strings, replacing matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def truncate(c: Column, limit: int) -> Column:
    """The stripped text, cut to `limit` characters with a mark after them."""
    return let(strip(c), lambda t: F.when(F.length(t) > limit, F.concat(rstrip(F.substring(t, 1, limit)), F.lit(" …[truncated]"))).otherwise(t))


def truncate_ends(c: Column, head: int, tail: int) -> Column:
    """The stripped text with its middle elided, and a line that says how much is missing."""

    def cut(t: Column) -> Column:
        gone = F.length(t) - head - tail
        both = F.concat(rstrip(F.substring(t, 1, head)), F.lit("\n…["), gone.cast("string"), F.lit(" chars elided]…\n"), lstrip(F.substring(t, -tail, tail)))
        return F.when(gone > 0, both).otherwise(t)

    return let(strip(c), cut)


def elide_middle(c: Column, limit: int) -> Column:
    half = limit // 2
    both = F.concat(F.substring(c, 1, half), F.lit("\n\n…[middle of segment elided]…\n\n"), F.substring(c, -half, half))
    return F.when(F.length(c) > limit, both).otherwise(c)


def replace_matches(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Replace each leftmost non-overlapping match by new(match), which may return the match as it is."""

    def build(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.array_join(F.zip_with(gaps, F.transform(found, new), lambda gap, put: F.concat(gap, F.coalesce(put, F.lit("")))), "")

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, build(m)).otherwise(text))


def first_match(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def distinct_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
