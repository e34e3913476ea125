"""Lookups: siblings, cascades by priority, coverage, co-occurrence, unknown words, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiqua.functions import text

#: Words that may go into a plan as literals, and rows that may be broadcast.
LITERAL_WORDS, BROADCAST_ROWS = 5_000, 1_000_000
#: Groups of more rows than this, and than this part of all rows, are joined by a broadcast: 100 000 of them at most.
HOT_ROWS, HOT_PART = 10_000, 1e-5


def siblings(df: DataFrame, group: str, key: str, most: int = 10) -> DataFrame:
    """Each row's first other keys of its group, in order; rows without a group go, null keys are no siblings.

    Of each group only the first ``most`` + 1 keys are needed for all its rows. A window with a limit keeps so many of them in each task
    before it shuffles, so a group of any size sends a short list. The lists of large groups are broadcast, others joined.
    """
    keys = df.select(F.col(group).alias("_g"), F.col(key).alias("_k")).filter("_g IS NOT NULL").groupBy("_g", "_k").agg(F.count("*").alias("_n"))
    total = keys.groupBy("_g").agg(F.sum("_n").alias("_rows"))
    first = first_of(keys.filter("_k IS NOT NULL").select("_g", "_k"), ["_g"], [F.asc("_k")], most + 1)
    lists = total.join(first.groupBy("_g").agg(F.array_sort(F.collect_list("_k")).alias("_keys")), "_g", "left")
    all_rows = df.count()
    hot = F.col("_rows") > max(HOT_ROWS, all_rows * HOT_PART)
    large = F.broadcast(lists.filter(hot).select("_g", "_keys"))
    rest = df.join(large.select("_g"), F.col(group) == F.col("_g"), "left_anti").join(lists.filter(~hot).select("_g", "_keys"), F.col(group) == F.col("_g"))
    joined = df.join(large, F.col(group) == F.col("_g")).unionByName(rest)
    others = F.filter(F.coalesce("_keys", F.array()), lambda x: ~x.eqNullSafe(F.col(key)))
    return joined.withColumn("siblings", F.slice(others, 1, most)).drop("_g", "_keys")


def cascade(df: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """``df`` with ``found`` and ``source``: the value (column ``value`` by ``key``) of the first source that has the key."""
    tagged = None
    for at, (name, table) in enumerate(sources):
        part = table.select(F.col(key).alias("_k"), F.col("value").cast("string").alias("value"), F.lit(name).alias("source"), F.lit(at).alias("at"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy("_k").agg(F.min_by(F.struct("value", "source"), F.struct("at", "value")).alias("b"))
    return df.join(best, F.col(key) == F.col("_k"), "left").select(*df.columns, F.col("b.value").alias("found"), F.col("b.source").alias("source"))


def best_file(pairs: DataFrame) -> DataFrame:
    """Of ``file, priority, term`` the file with most distinct terms (a low priority number wins ties) and its count."""
    counts = pairs.groupBy("file", "priority").agg(F.count_distinct("term").alias("terms"))
    return counts.orderBy(F.desc("terms"), "priority", "file").limit(1)


def cooccurring(df: DataFrame, text_col: str, terms: list[str], most: int = 5) -> DataFrame:
    """For each term the words most often in texts with it (longer than three letters, no stopwords), first in order on ties."""
    words = F.filter(text.words(F.col(text_col)), lambda w: (F.length(w) > 3) & ~w.isin(*text.STOPWORDS))
    asked = F.array(*[F.lit(t) for t in terms])
    held = df.select(words.alias("w")).withColumn("term", F.explode(F.filter(asked, lambda t: F.array_contains("w", t))))
    counts = held.select("term", F.explode("w").alias("word")).filter("word <> term").groupBy("term", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


def known_part(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """The part of a text's tokens that the vocabulary (``word``) has, a row for each row of ``df``; 1 for a text without tokens.

    A vocabulary of up to ``LITERAL_WORDS`` words goes into the plan as a hash set and texts are judged in their rows. A larger one
    is joined to each row's distinct tokens: broadcast by its count, else shuffled.
    """
    tokens = text.tokenize(F.col(text_col))
    words = vocabulary.select("word").filter("word IS NOT NULL").distinct()
    known = [r[0] for r in words.limit(LITERAL_WORDS + 1).collect()]
    share = lambda has, n: F.when(n == 0, 1.0).otherwise(has / F.greatest(n, F.lit(1)))
    if len(known) <= LITERAL_WORDS:
        has = F.size(F.filter("_t", lambda t: t.isin(*known))) if known else F.lit(0)
        return df.select(id_col, tokens.alias("_t")).select(id_col, share(has, F.size("_t")).alias("known_part"))
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("no")).alias("_id"), tokens.alias("_t")).select("_id", F.explode_outer("_t").alias("t"))
    counts = rows.groupBy("_id", "t").agg(F.count("t").alias("n"))
    listed = words.select(F.col("word").alias("t"), F.lit(True).alias("known"))
    joined = counts.join(F.broadcast(listed) if words.count() <= BROADCAST_ROWS else listed, "t", "left")
    sums = joined.groupBy("_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("has"))
    return sums.select(F.col("_id.id").alias(id_col), share(F.col("has"), F.col("all")).alias("known_part"))


def occurrences(df: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """How often each term is part of the texts, whatever characters it has, and the grand total (a null term)."""
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), text.occurrences(F.col(text_col), t).alias("n")) for t in terms])).alias("c")
    return df.select(one).select("c.*").rollup("term").agg(F.sum("n").alias("n"))


def bridges(pairs: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """``pairs`` (``a, b, shared``) with ``bridge``: a shared term whose entry in the thesaurus (``word, subject``) names both, else the
    first shared term of at most 12 letters, else the first word of the thesaurus that names both. Names meet in lower case."""
    edges = thesaurus.select("word", F.lower("subject").alias("subject")).distinct()
    keyed = pairs.select("a", "b", "shared", F.lower("a").alias("_x"), F.lower("b").alias("_y"))
    both = keyed.select("a", "b", "_x", "_y").distinct().join(edges.withColumnRenamed("subject", "_x"), "_x").join(edges.withColumnRenamed("subject", "_y"), ["_y", "word"])
    named = both.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.array_sort(F.collect_set("word")).alias("_words"))
    met = F.get(F.filter("shared", lambda t: F.array_contains(F.coalesce("_words", F.array().cast("array<string>")), t)), F.lit(0))
    joined = pairs.join(named, F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")), "left")
    return joined.withColumn("bridge", F.coalesce(met, F.get(F.filter("shared", lambda t: F.length(t) <= 12), F.lit(0)), F.get("_words", F.lit(0)))).drop("_a", "_b", "_words")


def track_word(relationships: DataFrame, word: str) -> DataFrame:
    """Code relationships (``ord, term, description, related_terms, example``) after an inquiry for a word: unless some entry is it or
    relates to it, it joins the related terms of the first entry whose description or example holds it."""
    w = F.lit(word)
    none = F.array().cast("array<string>")
    marked = relationships.withColumn("_knows", (F.col("term") == w) | F.array_contains(F.coalesce("related_terms", none), w)).withColumn("_holds", F.contains(F.coalesce("description", F.lit("")), w) | F.contains(F.coalesce("example", F.lit("")), w))
    told = marked.agg(F.coalesce(F.bool_or("_knows"), F.lit(False)).alias("_known"), F.min(F.when(F.col("_holds"), F.col("ord"))).alias("_first"))
    joined = marked.crossJoin(F.broadcast(told))  # one row
    here = ~F.col("_known") & (F.col("ord") == F.col("_first"))
    return joined.withColumn("related_terms", F.when(F.coalesce(here, F.lit(False)), F.array_append(F.coalesce("related_terms", none), w)).otherwise(F.col("related_terms"))).select(*relationships.columns)


def by_normal_key(entries: DataFrame, key: str) -> DataFrame:
    """The first entry (``file, ord, key``) whose key is the wanted one once both are plain words."""
    same = text.normalize_key(F.col("key")) == text.normalize_key(F.lit(key))
    return entries.filter(same).orderBy("file", "ord").limit(1)


def first_of(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group in an order (siblings, history, evidence, clarifiers: each with its own number)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= most)
