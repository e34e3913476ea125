"""Reading requests by sets of words: what opens them, what joins their terms, what closes them.

A text is put between single spaces, and whole words are looked for in it; of several that it has, the first counts, and of those that
begin together the longest. What stands between them fills the slots. No rule depends on the order in which sets are written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiqua.functions import text


def spaced(c: Column) -> Column:
    """A text with single spaces, one before and one after it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text.blank(c), r"\s+", " ")), F.lit(" "))


def asked(c: Column) -> Column:
    """The same without the marks at its end."""
    return spaced(F.regexp_replace(F.trim(text.blank(c)), r"[?.!\s]+$", ""))


def place(c: Column, phrases: Iterable[str]) -> Column:
    """Where the first of the phrases stands in a spaced text: ``at`` (of the space before it) and ``less`` (minus its length); null if none does."""
    low = F.lower(c)
    found = F.array(*(F.struct(F.instr(low, F.lit(f" {p} ")).alias("at"), F.lit(-len(p)).alias("less")) for p in sorted(phrases)))
    return F.array_min(F.filter(found, lambda x: x["at"] > 0))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression is computed, and planned, as often as it is written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def after(c: Column, openers: Iterable[str], first: bool = False) -> Column:
    """What follows the opener, spaced; null without one. With ``first``, it must begin the text."""

    def rest(hit: Column) -> Column:
        return F.when(hit["at"] == 1 if first else hit["at"] > 0, F.substring(c, hit["at"] - hit["less"] + 1, F.length(c)))

    return bound(place(c, openers), rest)


def halves(c: Column, joints: Iterable[str]) -> Column:
    """``a`` and ``b`` on both sides of the joint, trimmed; null if there is none or a side is empty."""

    def cut(hit: Column) -> Column:
        a, b = F.trim(F.substring(c, F.lit(1), hit["at"])), F.trim(F.substring(c, hit["at"] - hit["less"] + 1, F.length(c)))
        return F.when((hit["at"] > 0) & (a != "") & (b != ""), F.struct(a.alias("a"), b.alias("b")))

    return bound(place(c, joints), cut)


def closed(c: Column, closers: Iterable[str]) -> Column:
    """A spaced text without the closer at its end; null without one."""
    ends = F.array(*(F.when(F.endswith(F.lower(c), F.lit(f" {p} ")), F.lit(len(p))) for p in sorted(closers)))
    return bound(F.array_max(ends), lambda n: F.substring(c, F.lit(1), F.length(c) - n - 1))


def pair(c: Column, openers: Iterable[str], joints: Iterable[str], closers: Iterable[str] = (), first: bool = False) -> Column:
    """``a`` and ``b`` of opener, a, joint, b (and closer, if any are named); null for other texts."""
    return bound(after(c, openers, first), lambda rest: bound(closed(rest, closers), lambda x: halves(x, joints)) if closers else halves(rest, joints))


def quoted(c: Column) -> Column:
    """A text as far as its quotes, if it begins with one; else up to the next quote."""
    without = lambda x: F.when(F.substring(x, 1, 1).isin("'", '"'), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
    return F.trim(F.substring_index(F.translate(bound(F.trim(c), without), '"', "'"), "'", 1))
