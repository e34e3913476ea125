"""Ratcliff-Obershelp similarity of words, and a join of words to the nearest of a list.

The similarity is 2 M / S: S characters in both, M of them in matched blocks (the longest common block first, then what is left
and right of it). A pair of at least a wanted ratio has at least M = ceil(ratio * S / 2) matched characters, and from that follows what
the pair must have in common before it is compared:

* lengths: neither is shorter than M;
* pairs of neighbouring characters: two matched blocks have an unmatched character between them, so there are at most S - 2 M + 1
  blocks, and 3 M - S - 1 common pairs or more; where that is none, M common characters;
* places: the same pair is moved by at most the unmatched characters of the longer word;
* letters: as a bag, both have M characters in common.

Words meet on prefixes: with elements in one order for all words (rare ones first, equal ones by place), the first of c matched
elements has c - 1 behind it in either word. So each word needs to show all but its last c - 1 elements, and the pair meets there on
an element whose places fit. Meetings are keyed by both lengths, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements are counted in so many buckets; the counts, which order them, are broadcast.
COUNTS = 1 << 16
#: Words of one key that a task meets with all others of it; a key of more is spread over tasks.
SPREAD = 2_000


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """2 * matched / all characters; 1 for two empty texts, null for a null. Of equally long blocks the first of ``a`` counts, then the first of ``b``.

    Blocks are found by a fold over stretches that are still open, each of both words; there are at most two more of them than matched
    characters. The work grows with the cube of the length, which suits words.
    """
    part = lambda i, j, k, n: F.struct(i.alias("i"), j.alias("j"), k.alias("k"), n.alias("n"))
    whole = lambda c: F.struct(c["i"].cast("int").alias("i"), c["j"].cast("int").alias("j"), c["k"].cast("int").alias("k"), c["n"].cast("int").alias("n"))
    state = lambda todo, matched: F.struct(todo.alias("todo"), matched.cast("int").alias("matched"))
    zero = F.lit(0)

    def longest(x: Column, y: Column) -> Column:
        """The longest common block of two stretches: its size, and minus its place in the first."""
        size_at = lambda s: F.aggregate(F.sequence(s + 1, F.length(x)), zero, lambda acc, e: F.when((acc == e - s - 1) & (F.position(F.substring(x, s + 1, e - s), y) > 0), e - s).otherwise(acc))
        return F.array_max(F.transform(F.sequence(zero, F.length(x) - 1), lambda s: F.struct(size_at(s).alias("size"), (-s).alias("less"))))

    def step(acc: Column, _: Column) -> Column:
        def opened(seg: Column) -> Column:
            rest = F.slice(acc["todo"], 1, F.size(acc["todo"]) - 1)
            x, y = F.substring(a, seg["i"] + 1, seg["j"] - seg["i"]), F.substring(b, seg["k"] + 1, seg["n"] - seg["k"])

            def found(block: Column) -> Column:
                size, at = block["size"], seg["i"] - block["less"]

                def placed(to: Column) -> Column:
                    left, right = part(seg["i"], at, seg["k"], to), part(at + size, seg["j"], to + size, seg["n"])
                    more = F.filter(F.array(whole(left), whole(right)), lambda s: (s["i"] < s["j"]) & (s["k"] < s["n"]))
                    return state(F.concat(rest, more), acc["matched"] + size)

                return F.when(size > 0, _bound(seg["k"] + F.position(F.substring(a, at + 1, size), y) - 1, placed)).otherwise(state(rest, acc["matched"]))

            return _bound(longest(x, y), found)

        return F.when(F.size(acc["todo"]) == 0, acc).otherwise(_bound(F.element_at(acc["todo"], -1), opened))

    first = F.filter(F.array(whole(part(zero, F.length(a), zero, F.length(b)))), lambda s: (s["j"] > 0) & (s["n"] > 0))
    total = F.length(a) + F.length(b)
    matched = F.aggregate(F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1), state(first, zero), step, lambda end: end["matched"])
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0).otherwise(2.0 * matched / F.greatest(total, F.lit(1)))


def common_letters(a: Column, b: Column) -> Column:
    """How many characters two words have in common, as bags."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    return F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def placed_common(a: Column, b: Column, width: int, shift: Column) -> Column:
    """How many runs of ``width`` characters of ``a`` are in ``b`` at most ``shift`` places away."""
    near = lambda i: F.substring(b, F.greatest(i - shift, F.lit(1)), F.least(i, shift + 1) + shift + width - 1)
    at = F.filter(F.sequence(F.lit(1), F.length(a) - width + 1), lambda i: F.contains(near(i), F.substring(a, i, F.lit(width))))
    return F.when(F.length(a) >= width, F.size(at)).otherwise(0)


def matched_least(n: Column, m: Column, least: float) -> Column:
    """Characters that words of ``n`` and ``m`` characters must match for a ratio of ``least``."""
    return F.ceil(F.lit(least / 2) * (n + m) - 1e-9).cast("int")


def common_least(n: Column, m: Column, least: float) -> Column:
    """Pairs of neighbouring characters that such words have in common; 0 or less if none need be."""
    return 3 * matched_least(n, m, least) - (n + m) - 1


def _elements(words: DataFrame) -> DataFrame:
    """``w, n, kind, e, at``: pairs of neighbours and single characters of each word, with their places."""
    size = F.length("w")
    made = lambda kind, width: F.when(size >= width, F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.struct(F.lit(kind).alias("kind"), F.substring(F.col("w"), i, F.lit(width)).alias("c"), i.alias("at")))).otherwise(F.array().cast("array<struct<kind:string,c:string,at:int>>"))
    rows = words.select("w", size.alias("n"), F.explode(F.concat(made("2", 2), made("1", 1))).alias("x"))
    return rows.select("w", "n", "x.kind", F.xxhash64("x.kind", "x.c").alias("e"), "x.at")


def _keyed(words: DataFrame, other_lengths: DataFrame, counts: DataFrame, least: float, side: str) -> DataFrame:
    """``w, key, at`` of a side's words: for each length of the other side that can be near enough, the prefix of the word's elements."""
    bucket = F.pmod("e", F.lit(COUNTS))
    ranked = _elements(words).withColumn("bucket", bucket).join(F.broadcast(counts), "bucket", "left")
    place = F.row_number().over(Window.partitionBy("w", "kind").orderBy(F.coalesce("texts", F.lit(0)), "e", "at"))
    ranked = ranked.withColumn("place", place)
    n, m = F.col("n"), F.col("m")
    enough, pairs = matched_least(n, m, least), common_least(n, m, least)
    near = ranked.join(F.broadcast(other_lengths.withColumnRenamed("n", "m")), (enough <= F.least(n, m)))  # lengths of words: a small table
    prefix = F.when(pairs > 0, F.when(F.col("kind") == "2", n - 1 - pairs + 1)).when(F.col("kind") == "1", n - enough + 1)
    a, b = (n, m) if side == "left" else (m, n)
    return near.filter(F.col("place") <= prefix).select("w", "at", F.struct("e", a.alias("n"), b.alias("m")).alias("key"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of different words (columns ``w``, distinct and not null) that may have a ratio of ``least`` or more."""
    both = left.union(right)
    counts = _elements(both).groupBy(F.pmod("e", F.lit(COUNTS)).alias("bucket")).agg(F.count("*").alias("texts"))
    lengths = lambda words: words.select(F.length("w").alias("n")).distinct()
    x, y = _keyed(left, lengths(right), counts, least, "left"), _keyed(right, lengths(left), counts, least, "right")
    # A key of many words on the left has these dealt to as many tasks as it needs; the right goes to each of them.
    hot = y.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > SPREAD).select("key", F.ceil(F.col("c") / SPREAD).cast("int").alias("parts"))
    x = x.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select("key", "salt", F.col("w").alias("a"), F.col("at").alias("at_a"))
    y = y.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("w"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"), F.col("w").alias("b"), F.col("at").alias("at_b"))
    n, m = F.col("key.n"), F.col("key.m")
    moved = F.abs(F.col("at_a") - F.col("at_b")) <= F.greatest(n, m) - matched_least(n, m, least)
    return x.join(y, ["key", "salt"]).filter(moved & (F.col("a") != F.col("b"))).select("a", "b").distinct()


def compared(pairs: DataFrame, least: float) -> DataFrame:
    """Of candidates ``a, b`` those that have enough in common, as bags of letters and, from either side, letter by letter and pair by
    pair at places that fit: the ones that are worth a comparison."""
    a, b, n, m = F.col("a"), F.col("b"), F.length("a"), F.length("b")
    enough, pairs_enough = matched_least(n, m, least), common_least(n, m, least)
    shift = F.greatest(n, m) - enough
    fits = lambda x, y: (placed_common(x, y, 1, shift) >= enough) & (placed_common(x, y, 2, shift) >= pairs_enough)
    return pairs.filter(common_letters(a, b) >= enough).filter(fits(a, b)).filter(fits(b, a))


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """All pairs ``a, b, ratio`` of words of both sides with a ratio of ``least`` or more (above 0); nulls are in no pair.

    ``left`` and ``right`` have a column ``w``; repeated words count once. Two empty words are equal; an empty one is like no other.
    """
    if not 0 < least <= 1:
        raise ValueError("the least ratio is above 0, at most 1")
    left, right = (x.select("w").filter("w IS NOT NULL").distinct() for x in (left, right))
    same = left.join(right, "w").select(F.col("w").alias("a"), F.col("w").alias("b"), F.lit(1.0).alias("ratio"))
    return same.unionByName(compared(candidates(left, right, least), least).withColumn("ratio", ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= least))


def nearest(left: DataFrame, left_col: str, words: DataFrame, word_col: str, least: float = 0.8) -> DataFrame:
    """``left`` with the most similar word (``nearest``) and its ``ratio``, where that is ``least`` or more; ties take the first in order."""
    found = similar(left.select(F.col(left_col).alias("w")), words.select(F.col(word_col).alias("w")), least)
    best = found.groupBy(F.col("a").alias("_a")).agg(F.min_by(F.struct("b", "ratio"), F.struct(-F.col("ratio"), F.col("b"))).alias("_best"))
    return left.join(best, F.col(left_col) == F.col("_a"), "left").select(*left.columns, F.col("_best.b").alias("nearest"), F.col("_best.ratio").alias("ratio"))
