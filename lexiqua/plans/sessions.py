"""Sessions: scored taxa kept as a table, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.functions import text
from lexiqua.operators import match
from lexiqua.operators.spread import numbered

ITEM = ["kingdom", "phylum", "family", "order", "variable", "type", "value"]


def analyze(spark: SparkSession, prompts: DataFrame, entries: DataFrame) -> DataFrame:
    """Prompts (``prompt_id, prompt``) to taxa: ``prompt_id, frag, keyword, `` and ``ITEM``.

    Entries are scanned once for all prompts, however many these are; see ``match.matches``.
    """
    frags = prompts.select("prompt_id", F.posexplode(text.fragments(F.col("prompt"))).alias("frag", "fragment"))
    words = match.keywords(frags, ["prompt_id", "frag"], "fragment")
    taxa = match.taxonomy(match.matches(entries, words.select("keyword")))
    return match.told_by(words, taxa).select("prompt_id", "frag", "keyword", *ITEM)


def create(session_id: str, taxa: DataFrame) -> DataFrame:
    """A session's items with their score and ``explored``, ranked by score; equal scores in order of their columns."""
    scored = taxa.select(F.lit(session_id).alias("session_id"), *ITEM, match.score().alias("score"), F.lit(False).alias("explored"))
    return numbered(scored, [], [(-F.col("score")).alias("_less"), *map(F.col, ITEM)], "rank").withColumn("rank", F.col("rank").cast("int"))


def save(items: DataFrame, folder: str) -> None:
    items.write.mode("overwrite").partitionBy("session_id").json(folder)


def load(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    return spark.read.json(folder).filter(F.col("session_id") == session_id)


def top(items: DataFrame, n: int = 5) -> DataFrame:
    return items.orderBy("rank").limit(n)


def mark_explored(items: DataFrame, variable: str) -> DataFrame:
    return items.withColumn("explored", F.col("explored") | (F.col("variable") == variable))


def alerts(items: DataFrame, threshold: int = 5) -> DataFrame:
    return items.filter((F.col("score") >= threshold) & ~F.col("explored"))


def _anchor(items: DataFrame, variable: str) -> DataFrame:
    """The item for a variable: an exact one, else one that holds it; the best ranked."""
    tier = F.when(F.col("variable") == variable, 1).when(F.contains("variable", F.lit(variable)), 2)
    return items.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", "rank").limit(1)


def below(items: DataFrame, variable: str, level: str = "family", limit: int = 20) -> DataFrame:
    """Other items of the variable's family, phylum or kingdom, best first."""
    anchor = _anchor(items, variable).select(F.col(level).alias("_level"), F.col("variable").alias("_own"))
    return items.join(F.broadcast(anchor), (F.col(level) == F.col("_level")) & (F.col("variable") != F.col("_own"))).drop("_level", "_own").orderBy("rank").limit(limit)


def chain(items: DataFrame, variable: str, steps: int = 5) -> DataFrame:
    """From a variable on to others: of its family, else its phylum, else those that hold its name; last first."""
    anchor = _anchor(items, variable).select(F.col("family").alias("_f"), F.col("phylum").alias("_p"), F.col("variable").alias("_v"))
    tier = F.when(F.col("family") == F.col("_f"), 1).when(F.col("phylum") == F.col("_p"), 2).when(F.contains("variable", F.col("_v")), 3)
    reached = items.crossJoin(F.broadcast(anchor)).withColumn("tier", tier).filter("tier IS NOT NULL AND variable <> _v")
    best = Window.orderBy("tier", "rank")
    return reached.withColumn("step", F.row_number().over(best)).filter(F.col("step") <= steps).orderBy(F.desc("step")).drop("_f", "_p", "_v")


def lineage(items: DataFrame, variable: str) -> DataFrame:
    return items.filter(F.col("variable") == variable).orderBy("rank").limit(1).select(*ITEM)


def selected(items: DataFrame, steps: int) -> DataFrame:
    """The deepest items, one for each variable, at most ``max(3, 2 * steps)``: ``pos`` from 0.

    Ranks are by score and ``ITEM``, so these order the items as ranks do; only the deepest ones come together in one task.
    """
    deep = items.drop("rank").withColumn("depth", match.depth())
    order = [F.desc("depth"), F.desc("score"), *ITEM]
    first = F.row_number().over(Window.partitionBy("variable").orderBy(*order))
    one = deep.withColumn("_n", first).filter("_n = 1").drop("_n").orderBy(*order).limit(max(3, 2 * steps))
    return one.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def cosine_index(step: Column, steps: int, n: Column) -> Column:
    """Where a cosine walk over ``n`` places is at a step; halves round to even."""
    return F.bround((F.cos(2 * F.pi() * step / steps) + 1) / 2 * (n - 1)).cast("long")


def conjecture(items: DataFrame, steps: int = 4) -> DataFrame:
    """A walk over the selected items: ``step, variable, text``."""
    some = selected(items, steps)
    n = some.agg(F.count("*").alias("n"))
    walk = items.sparkSession.range(steps).crossJoin(F.broadcast(n)).filter("n > 0").select(F.col("id").alias("step"), cosine_index(F.col("id"), steps, F.col("n")).alias("pos"))
    told = F.concat(F.col("variable"), F.lit(" ("), F.col("family"), F.lit("): "), text.truncated(F.col("value"), 140))
    return walk.join(some, "pos").select("step", "variable", told.alias("text"))


def conjecture_paragraph(items: DataFrame, steps: int = 4) -> DataFrame:
    """The walk of ``conjecture`` as one text, a sentence for each step."""
    told = conjecture(items, steps).agg(F.array_sort(F.collect_list(F.struct("step", "text"))).alias("t"))
    return told.select(F.array_join(F.transform("t", lambda x: text.end_sentence(x["text"])), " ").alias("paragraph"))


def chain_text(items: DataFrame, variable: str, steps: int = 5) -> DataFrame:
    """The steps of ``chain``, each told as where it leads: ``step, variable, text``."""
    told = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": "), F.col("variable"), F.lit(" ("), F.col("family"), F.lit(", "), F.col("phylum"), F.lit(") — "), F.col("type"), F.lit(": "), text.truncated(F.col("value"), 180))
    return chain(items, variable, steps).select("step", "variable", told.alias("text"))


def expand(items: DataFrame, variable: str) -> DataFrame:
    """All items of a variable; of those that hold its name, where none is it."""
    tier = F.when(F.col("variable") == variable, 1).when(F.contains("variable", F.lit(variable)), 2)
    tiered = items.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = tiered.agg(F.min("tier").alias("_best"))
    return tiered.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("tier", "_best").orderBy("rank")
