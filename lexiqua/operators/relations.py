"""How texts relate: pairs by weighted similarity, and equal, including, overlapping or distinct terms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiqua.functions import sets, text
from lexiqua.sources.scratch import written

#: Thresholds of the tiers.
EQUAL_OVERLAP, INCLUDES, OVERLAPS = 0.85, 0.6, 0.25
KINDS = ("nouns", "predicates", "participles", "connectives")


#: Rows of one key that a task pairs with all others of it; keys of more, and of more than this part of all rows, are spread.
SPREAD_ROWS, SPREAD_PART = 2_000, 1e-5
#: Words are counted in so many buckets of hashes; the counts, which order a text's words from rare to frequent, are broadcast.
COUNTS = 1 << 16
#: Least percentages that a search for the most similar pairs tries, one after another.
FALLING = (90.0, 75.0, 60.0, 45.0, 30.0)


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of two tables ``id, k`` the pairs ``a, b`` of an id of either that have a key in common, once for each key: ``a, b, k``.

    Keys of many ids on the right are few by their part of all rows, so they are broadcast; their ids there are dealt to as many tasks as
    they have times ``SPREAD_ROWS``, and those on the left go to each. What the pairs number is what the result holds.
    """
    counts = right.groupBy("k").agg(F.count("*").alias("n"))
    total = right.count()
    hot = F.broadcast(counts.filter(F.col("n") > max(SPREAD_ROWS, total * SPREAD_PART)).select(F.col("k").alias("_k"), F.ceil(F.col("n") / SPREAD_ROWS).cast("int").alias("_s")))
    marked = lambda keyed: keyed.join(hot, F.col("k") == F.col("_k"), "left").select("id", "k", F.coalesce("_s", F.lit(1)).alias("s"))
    x = marked(left).select(F.col("id").alias("a"), "k", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
    y = marked(right).select(F.col("id").alias("b"), "k", F.pmod(F.xxhash64("id"), F.col("s")).cast("int").alias("salt"))
    return x.join(y, ["k", "salt"]).select("a", "b", "k")


def met_pairs(keyed: DataFrame) -> DataFrame:
    """Of ``id, k`` the pairs ``a < b`` of ids that have a key in common, once for each key: ``a, b, k``; see ``met``."""
    return met(keyed, keyed).filter("a < b")


def ranked(words: DataFrame, within: list[str]) -> DataFrame:
    """``words`` (``k`` and the columns ``within``) with ``place``: 1 for a group's rarest word. All texts put words in the same order."""
    bucket = F.pmod(F.xxhash64("k"), F.lit(COUNTS))
    counts = words.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    ordered = words.withColumn("_bucket", bucket).join(F.broadcast(counts), "_bucket")
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("_n", "k"))).drop("_bucket")


def _empty_keys(profile: Column, least: float) -> Column:
    """Keys on which texts meet that are alike by what both lack: each least set of kinds whose weights reach ``least`` and that a text has none of."""
    weights = dict(zip(KINDS, sets.WEIGHTS, strict=True))
    enough = [set(s) for n in range(1, len(KINDS) + 1) for s in combinations(KINDS, n) if sum(weights[k] for k in s) * 100 >= least - 1e-9]
    keys = []
    for s in (s for s in enough if not any(t < s for t in enough)):
        none = F.lit(True)
        for kind in sorted(s):
            none = none & (F.size(profile[kind]) == 0)
        keys.append(F.when(none, F.lit("none of " + " ".join(sorted(s)))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


def profiles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, p``: each text's words by kind, written once for all that compare them."""
    return written(df.select(F.col(id_col).alias("id"), sets.profile(F.col(text_col)).alias("p")), "profiles")


def _prefixes(known: DataFrame, least: float) -> DataFrame:
    """``id, k`` of the words on which texts meet that are ``least`` percent alike.

    Kinds that both texts lack count as alike. With the weight W of these, one of the other kinds has a Jaccard similarity of (least - W)
    / (1 - W) or more, so the pair shares one of the rarest words of that kind, as many as leave too few others. What one text alone lacks
    bounds W from above.
    """
    weights = dict(zip(KINDS, sets.WEIGHTS, strict=True))
    lacks = sum((F.when(F.size(F.col("p")[kind]) == 0, w).otherwise(0.0) for kind, w in weights.items()), F.lit(0.0))
    part = F.greatest(F.lit(0.0), F.try_divide(F.lit(least / 100) - lacks, F.lit(1.0) - lacks))

    def of(kind: str) -> Column:
        return F.transform(F.col("p")[kind], lambda w: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), w).alias("k"), F.size(F.col("p")[kind]).alias("d")))

    words = known.select("id", part.alias("part"), F.explode(F.concat(*map(of, KINDS))).alias("x")).select("id", "part", "x.*")
    common = F.greatest(F.lit(1), F.ceil(F.col("part") * F.col("d") - 1e-9))
    rare = ranked(words, ["id", "kind"]).filter(F.col("place") <= F.col("d") - common + 1).select("id", "k")
    return rare.unionByName(known.select("id", F.explode(_empty_keys(F.col("p"), least)).alias("k")))


def _similar(known: DataFrame, least: float) -> DataFrame:
    """``a, b, percent, shared`` of profiles that are ``least`` percent alike."""
    keyed = written(_prefixes(known, least), "prefixes")
    pairs = met_pairs(keyed).select("a", "b").distinct()
    side = lambda s: known.select(F.col("id").alias(s), F.col("p").alias(f"p{s}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("percent", sets.percent_similarity(F.col("pa"), F.col("pb"))).filter(F.col("percent") >= least)
    return scored.select("a", "b", "percent", F.array_sort(F.array_intersect("pa.nouns", "pb.nouns")).alias("shared"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, least: float = 20.0) -> DataFrame:
    """Pairs ``a < b`` of at least ``least`` percent similarity: ``a, b, percent, shared`` (nouns in both).

    Two empty sets are alike. Pairs meet on a rare word of a kind, and on what both lack only where that alone reaches ``least``, so each
    such meeting is a row of the result. Texts are profiled once; what pairs meet on is shuffled, not all pairs of texts.
    """
    if least <= 0:
        raise ValueError("pairs of 0 percent aren't joined")
    return _similar(profiles(df, id_col, text_col), least)


def best_pairs(pairs: DataFrame, most: int = 50) -> DataFrame:
    """The most similar pairs (``a, b, percent, shared``) with their first six shared terms, ranked; ties by names."""
    rank = F.row_number().over(Window.orderBy(F.desc("percent"), "a", "b"))
    best = pairs.orderBy(F.desc("percent"), "a", "b").limit(most)
    return best.withColumn("rank", rank).withColumn("shared", F.slice("shared", 1, 6))


def top_pairs(df: DataFrame, id_col: str, text_col: str, most: int = 50, least: float = 20.0) -> DataFrame:
    """The ``most`` most similar pairs of at least ``least`` percent, as ``best_pairs`` gives them.

    Pairs are searched from ``FALLING`` percentages down: a high one lets few words meet. Once a search has found ``most`` pairs, no pair below
    its percentage can be among them, so lower ones, and the many pairs that meet there, are never made.
    """
    known = profiles(df, id_col, text_col)
    for at in [*(x for x in FALLING if x > least), least]:
        found = written(_similar(known, at), "pairs")
        if at == least or found.count() >= most:
            return best_pairs(found, most)
    raise AssertionError("the last percentage ends the search")


def exemplified_pairs(df: DataFrame, id_col: str, text_col: str, most: int = 20) -> DataFrame:
    """Pairs that share nouns, by how many of their first six shared nouns a sentence of either has, then by all shared:
    ``a, b, examples, shared, rank``, the first ``most``.

    Pairs of many shared nouns are searched first: of two texts with c nouns in common each shows all but its c - 1 most frequent ones.
    Once ``most`` pairs with six examples are found, pairs with fewer shared nouns can't be among them; else c is halved.
    """
    known = written(df.select(F.col(id_col).alias("id"), F.array_distinct(text.nouns(F.col(text_col))).alias("nouns"), F.lower(text.blank(F.col(text_col))).alias("t")), "nouns")
    words = written(ranked(known.select("id", F.size("nouns").alias("d"), F.explode("nouns").alias("k")), ["id"]), "ranked")
    c = max(1, (words.agg(F.max("d")).first()[0] or 1) // 2)
    while True:
        pairs = met_pairs(words.filter(F.col("place") <= F.col("d") - c + 1).select("id", "k")).select("a", "b").distinct()
        nouns = lambda s: known.select(F.col("id").alias(s), F.col("nouns").alias(f"n{s}"))
        many = pairs.join(nouns("a"), "a").join(nouns("b"), "b").select("a", "b", F.array_sort(F.array_intersect("na", "nb")).alias("n")).filter(F.size("n") >= c)
        many = many.select("a", "b", F.slice("n", 1, 6).alias("n"), F.size("n").cast("long").alias("shared"))
        told = lambda s: known.select(F.col("id").alias(s), F.col("t").alias(f"t{s}"))
        examples = F.size(F.filter("n", lambda x: F.contains("ta", x) | F.contains("tb", x)))
        found = written(many.join(told("a"), "a").join(told("b"), "b").select("a", "b", examples.alias("examples"), "shared"), "examples")
        if c == 1 or found.filter("examples = 6").count() >= most:
            break
        c //= 2
    best = found.filter("examples > 0").orderBy(F.desc("examples"), F.desc("shared"), "a", "b").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("examples"), F.desc("shared"), "a", "b")))


def shared_noun_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``a < b`` with a noun in common and how many: an equi-join on nouns, those of many texts spread over tasks."""
    met = met_pairs(df.select(F.col(id_col).alias("id"), F.explode(text.nouns(F.col(text_col))).alias("k")))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def relation(a: Column, b: Column) -> Column:
    """The relation of two token arrays (repeats kept): the first tier that holds."""
    a_covers, b_covers = sets.inclusion(a, b), sets.inclusion(b, a)
    both_sets = (F.size(a) > 0) & (F.size(b) > 0)
    return (
        F.when(sets.overlap_coefficient(a, b) > EQUAL_OVERLAP, "equal").when((a_covers >= INCLUDES) & (b_covers >= INCLUDES), "equal").when(a_covers >= INCLUDES, "a_includes_b").when(b_covers >= INCLUDES, "b_includes_a")
        .when(both_sets & (sets.jaccard(a, b) >= OVERLAPS), "overlap").otherwise("distinct")
    )


def relations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``a < b`` that are not distinct, with their relation. Texts without words are distinct from all.

    Words stand in one order for all texts, rare ones first, and texts meet in two ways. Overlapping texts have ``OVERLAPS`` of either's
    distinct words in common, so both show a prefix of theirs, and prefixes meet. A text that another includes (``INCLUDES`` of its
    words, repeats counted), or the smaller of two with nearly equal words, shows the few rare words before which too much would be
    missing, and meets all words of the other. Words of many texts are dealt to several tasks.
    """
    rows = written(df.select(F.col(id_col).alias("id"), text.tokenize(F.col(text_col)).alias("t")), "tokens")
    counts = rows.select("id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("d"), F.explode("t").alias("k")).groupBy("id", "n", "d", "k").agg(F.count("*").alias("m"))
    words = ranked(counts, ["id"])
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    words = written(words.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0))), "words")
    overlapping = words.filter(F.col("place") <= F.col("d") - F.greatest(F.lit(1), F.ceil(OVERLAPS * F.col("d") - 1e-9)) + 1).select("id", "k")
    included = words.filter((F.col("ahead") <= (1 - INCLUDES) * F.col("n") + 1e-9) | (F.col("place") <= F.col("d") - F.floor(EQUAL_OVERLAP * F.col("d") + 1e-9))).select("id", "k")
    either = met(included, words.select("id", "k")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = met_pairs(overlapping).select("a", "b").union(either).distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(rows.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", relation(F.col("ta"), F.col("tb")).alias("relation")).filter("relation <> 'distinct'")


def best_of_entries(a: DataFrame, b: DataFrame, key: str, tokens: str) -> DataFrame:
    """Entries of two sides with a common ``key`` (a term, or a pair of terms), each against each: the best scores of any pair.

    ``key, overlap`` (of the smaller set), ``a_covers, b_covers`` (the part of the other's tokens that it has), ``jaccard``.
    The entries of one term are few; pairs are made inside a key only.
    """
    ta, tb = F.col("_a"), F.col("_b")
    met = a.select(key, F.col(tokens).alias("_a")).join(b.select(key, F.col(tokens).alias("_b")), key)
    full = (F.size(ta) > 0) & (F.size(tb) > 0)
    best = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    return met.groupBy(key).agg(best(sets.overlap_coefficient(ta, tb)).alias("overlap"), best(sets.inclusion(ta, tb)).alias("a_covers"), best(sets.inclusion(tb, ta)).alias("b_covers"), best(F.when(full, sets.jaccard(ta, tb)).otherwise(0.0)).alias("jaccard"))


def tiered_relation(best: DataFrame) -> DataFrame:
    """``best`` of ``best_of_entries`` with ``relation``, ``score`` and ``reason``."""
    shown = lambda c: F.format_string("%.2f", c)
    of = lambda relation, score, reason: F.struct(F.lit(relation).alias("relation"), score.alias("score"), reason.alias("reason"))
    tier = (
        F.when(F.col("overlap") > EQUAL_OVERLAP, of("equal", F.lit(None).cast("double"), F.lit("high token overlap")))
        .when((F.col("a_covers") >= INCLUDES) & (F.col("b_covers") >= INCLUDES), of("equal", F.lit(None).cast("double"), F.concat(F.lit("both include the other: "), shown(F.col("a_covers")), F.lit("/"), shown(F.col("b_covers")))))
        .when(F.col("a_covers") >= INCLUDES, of("a_includes_b", F.col("a_covers"), F.concat(F.lit("a covers "), shown(F.col("a_covers")), F.lit(" of b"))))
        .when(F.col("b_covers") >= INCLUDES, of("b_includes_a", F.col("b_covers"), F.concat(F.lit("b covers "), shown(F.col("b_covers")), F.lit(" of a"))))
        .when(F.col("jaccard") >= OVERLAPS, of("overlap", F.col("jaccard"), F.concat(F.lit("Jaccard "), shown(F.col("jaccard")))))
        .otherwise(of("distinct", F.lit(None).cast("double"), F.lit("low overlap and no inclusion")))
    )
    return best.withColumn("_t", tier).select(*best.columns, "_t.relation", "_t.score", "_t.reason")
