"""Answers to prompts: taxa in order, variations of their telling, and a response with topic, main taxon, clarifiers and related ones.

Taxa are those of ``analysis``, many prompts at a time; whatever is chosen is chosen within a prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.functions import formulas, text
from lexiqua.operators import match
from lexiqua.operators.reports import CODE_BIAS
from lexiqua.operators.spread import numbered
from lexiqua.plans.sessions import ITEM, cosine_index

#: The order in which taxa were found, which decides ties.
FOUND = ["frag", "kw", "phylum", "variable", "type", "value"]
# How a step tells a taxon, in turn.
TEMPLATES = ["{head} — {variable}{via} — => {type}: {value}", "{variable}{via} — leads to {type}: {value}", "{head}: {variable}{via} -> {type}: {value}", "{variable} ({head}) — {type}: {value}"]
SINGLE = ["{variable} — {type}: {value}", "{head} — {variable} — {type}: {value}", "{variable} via {context} — {type}: {value}", "{variable} — {type}: {value}"]


def analysis(spark: SparkSession, prompts: DataFrame, entries: DataFrame) -> DataFrame:
    """Prompts (``prompt_id, prompt``) to taxa with ``frag, fragment, kw`` (the keyword's rank), ``keyword``, ``ITEM``, ``key, gloss, synonyms`` and ``score``.

    As in ``sessions.analyze``, entries are scanned once for all prompts.
    """
    frags = prompts.select("prompt_id", F.posexplode(text.fragments(F.col("prompt"))).alias("frag", "fragment"))
    words = match.keywords(frags, ["prompt_id", "frag", "fragment"], "fragment").select("prompt_id", "frag", "fragment", F.col("rank").alias("kw"), "keyword")
    taxa = match.taxonomy(match.matches(entries, words.select("keyword")), True)
    return match.told_by(words, taxa).select("prompt_id", "frag", "fragment", "kw", "keyword", *ITEM, "key", "gloss", "synonyms").withColumn("score", match.score())


def representatives(taxa: DataFrame) -> DataFrame:
    """The first taxon of each variable of a prompt."""
    first = F.row_number().over(Window.partitionBy("prompt_id", "variable").orderBy(*FOUND))
    return taxa.filter("variable <> ''").withColumn("_n", first).filter("_n = 1").drop("_n")


def anchored(taxa: DataFrame, chosen: DataFrame, level: str) -> DataFrame:
    """Of ``chosen`` taxa those that have the phylum, kingdom or family of the prompt's best; all, where none has."""
    top = taxa.groupBy(F.col("prompt_id").alias("_p")).agg(F.min_by(level, F.struct(-F.col("score"), *FOUND)).alias("_level"))
    joined = chosen.join(F.broadcast(top), F.col("prompt_id") == F.col("_p")).withColumn("_same", F.col(level) == F.col("_level"))
    some = joined.groupBy(F.col("prompt_id").alias("_of")).agg(F.max("_same").alias("_some"))
    return joined.join(F.broadcast(some), F.col("prompt_id") == F.col("_of")).filter("_same OR NOT _some").drop("_p", "_of", "_level", "_same", "_some")


def best_of_fragments(taxa: DataFrame) -> DataFrame:
    """The best taxon of each fragment; the first found on ties."""
    best = F.row_number().over(Window.partitionBy("prompt_id", "frag").orderBy(F.desc("score"), *FOUND))
    return taxa.withColumn("_n", best).filter("_n = 1").drop("_n")


def snippet(c: Column, most: int) -> Column:
    """At most ``most`` characters, three dots at the end where it was longer, without a space before them."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def _first_sentence(c: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(c, "\n", 1), ".", 1))


def _told(template: str, parts: dict[str, Column]) -> Column:
    pieces = []
    for piece in template.replace("}", "{").split("{"):
        pieces.append(parts.get(piece, F.lit(piece)))
    return F.concat(*pieces)


def _walk(chosen: DataFrame, steps: int, shifted: bool, reverse: bool) -> DataFrame:
    """Each prompt's chosen taxa by score, visited ``steps`` times by a cosine, shifted by the step or not: ``step, n`` beside the taxon."""
    n = chosen.groupBy(F.col("prompt_id").alias("_p")).agg(F.count("*").alias("n"))
    order = [(-F.col("score")).alias("_less"), *map(F.col, FOUND)]
    placed = numbered(chosen, ["prompt_id"], order, "_at").withColumn("_at", F.col("_at") - 1).join(F.broadcast(n), F.col("prompt_id") == F.col("_p")).drop("_p")
    if reverse:
        placed = placed.withColumn("_at", F.col("n") - 1 - F.col("_at"))
    visited = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: F.struct(s.alias("step"), F.pmod(cosine_index(s, steps, F.col("n")) + (s if shifted else F.lit(0)), F.col("n")).alias("at")))
    return placed.withColumn("_v", F.explode(F.filter(visited, lambda v: v["at"] == F.col("_at")))).withColumn("step", F.col("_v.step")).drop("_v", "_at")


def variations(taxa: DataFrame, steps: int = 6, kind: str = "conditional", anchor: str | None = "phylum", reverse: bool = False) -> DataFrame:
    """``prompt_id, step, variable, text``: a prompt's taxa told ``steps`` times, each with its head line.

    ``conditional`` tells a taxon in short, in one of four ways in turn; ``poetic`` in a sentence that ends with its value; ``plain``
    gives up to six taxa of the variable, best first. Only the first is kept near the best taxon (``anchor``) and shifts its walk.
    """
    chosen = representatives(taxa)
    if kind == "conditional" and anchor:
        chosen = anchored(taxa, chosen, anchor)
    visited = _walk(chosen, steps, kind == "conditional", reverse)
    order = _first_sentence(F.col("order"))
    if kind == "conditional":
        heads = F.filter(F.array(F.when(F.col("family") != "general", F.col("family")), F.when((F.col("phylum") != F.col("family")) & (F.col("phylum") != ""), F.col("phylum"))), lambda x: x.isNotNull())
        head = F.when(F.size(heads) > 0, F.array_join(heads, ", ")).otherwise(F.col("kingdom"))
        context = F.when(order != "", order).when(_first_sentence(F.col("fragment")) != "", _first_sentence(F.col("fragment"))).otherwise(F.col("keyword"))
        value = snippet(F.trim(F.translate("value", "\n", " ")), 200)
        parts = {"head": head, "variable": F.col("variable"), "via": F.concat(F.lit(" via "), context), "context": context, "type": F.col("type"), "value": value}
        turn = lambda forms: F.element_at(F.array(*(_told(f, parts) for f in forms)), (F.col("step") % len(forms) + 1).cast("int"))
        told = F.when(F.col("n") == 1, turn(SINGLE)).otherwise(turn(TEMPLATES))
    elif kind == "poetic":
        place = F.when(F.col("phylum") != "", F.concat(F.lit("Plunging into the "), F.col("kingdom"), F.lit(" of "), F.col("phylum"))).otherwise(F.concat(F.lit("Plunging into the "), F.col("kingdom")))
        end = F.when(F.col("value") != "", F.concat(F.lit("and pins the answer as the "), F.col("type"), F.lit(": "), snippet(F.col("value"), 220))).otherwise(F.concat(F.lit("and points toward the "), F.col("type"), F.lit(" as the final pin")))
        through = F.when(order != "", F.concat(F.lit("winds through "), snippet(order, 140)))
        told = F.concat(F.concat_ws(", ", place, F.concat(F.lit("a "), F.col("family"), F.lit(" named "), F.col("variable")), through, end), F.lit("."))
    else:
        rank = F.row_number().over(Window.partitionBy("prompt_id", "variable").orderBy(F.desc("score"), *FOUND))
        line = F.concat(F.lit("In "), F.col("kingdom"), F.lit(" ("), F.col("phylum"), F.lit("), "), F.col("variable"), F.lit(", a "), F.col("family"), F.lit(": "), F.col("value"), F.lit(" (from: '"), F.col("fragment"), F.lit("')"))
        # Lines are made for the visited variables alone; all taxa of a prompt may be many.
        told_of = visited.select(F.col("prompt_id").alias("_vp"), F.col("variable").alias("_vv")).distinct()
        some = taxa.join(F.broadcast(told_of), (F.col("prompt_id") == F.col("_vp")) & (F.col("variable") == F.col("_vv")), "left_semi")
        lines = some.withColumn("_r", rank).filter("_r <= 6").groupBy(F.col("prompt_id").alias("_p"), F.col("variable").alias("_var")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("_lines"))
        visited = visited.join(lines, (F.col("prompt_id") == F.col("_p")) & (F.col("variable") == F.col("_var")))
        told = F.col("_lines")
    line = F.concat(F.lit("Variation "), (F.col("step") + 1).cast("string"), F.lit(f"/{steps} — "), F.col("variable"), F.lit("\n\n"), told)
    return visited.select("prompt_id", "step", "variable", line.alias("text"))


def respond(taxa: DataFrame, steps: int = 4) -> DataFrame:
    """One row for each prompt with matches: ``prompt_id, topic`` (the file of the highest score, code files counted less), ``main``
    (its best taxon), ``clarifiers`` (its matched entries' first senses) and ``n_clarifiers``, ``related`` (variations in the main taxon's family) and ``response``."""
    scores = taxa.groupBy("prompt_id", "phylum").agg(F.sum("score").alias("_sum"))
    biased = F.col("_sum") * F.when(F.col("phylum").startswith("code"), CODE_BIAS).otherwise(1.0)
    topic = scores.groupBy(F.col("prompt_id").alias("_t")).agg(F.min_by("phylum", F.struct(-biased, "phylum")).alias("topic"))
    placed = taxa.join(F.broadcast(topic), (F.col("prompt_id") == F.col("_t")) & (F.col("phylum") == F.col("topic"))).drop("_t")
    main = placed.groupBy("prompt_id", "topic").agg(F.min_by(F.struct(*ITEM), F.struct(-F.col("score"), *FOUND)).alias("main"))
    told = F.concat(F.col("key"), F.lit(": "), F.when(F.col("gloss") != "", F.col("gloss")).otherwise("(no gloss)"), F.when(F.size("synonyms") > 0, F.concat(F.lit(" (synonyms: "), F.array_join("synonyms", ", "), F.lit(")"))).otherwise(""))
    entries = representatives(placed).select(F.col("prompt_id").alias("_c"), F.struct(*FOUND, told.alias("told")).alias("_e"))
    told_in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["told"])
    listed = entries.groupBy("_c").agg(told_in_order("_e").alias("clarifiers"), F.count("*").alias("n_clarifiers"))
    # The response tells a few, which a window with a limit keeps in each task; the whole list is made only where it is asked for.
    number = F.row_number().over(Window.partitionBy("_c").orderBy("_e"))
    few = entries.withColumn("_n", number).filter("_n <= 4").groupBy(F.col("_c").alias("_few")).agg(told_in_order("_e").alias("_clarifiers"))
    kin = taxa.join(F.broadcast(main.select(F.col("prompt_id").alias("_m"), F.col("main.family").alias("_family"))), (F.col("prompt_id") == F.col("_m")) & (F.col("family") == F.col("_family"))).drop("_m", "_family")
    related = variations(kin, steps, anchor="family").groupBy(F.col("prompt_id").alias("_r")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("step", "text"))), lambda x: x["text"])).alias("related"))
    joined = main.join(listed, F.col("prompt_id") == F.col("_c")).join(few, F.col("prompt_id") == F.col("_few")).join(related, F.col("prompt_id") == F.col("_r"), "left")
    value = snippet(F.trim("main.value"), 400)
    value = F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, F.lit(2), F.length(value)))
    response = F.concat_ws(
        "\n\n", F.concat(F.lit("Focusing on "), F.col("main.kingdom"), F.lit(" → "), F.col("main.phylum"), F.lit(" → "), F.col("main.family"), F.lit(",")), F.concat(F.lit("the concept '"), F.col("main.variable"), F.lit("' resolves to "), F.col("main.type"), F.lit(".")),
        F.nullif(value, F.lit("")), F.concat(F.lit("Clarifiers: "), F.array_join("_clarifiers", "; ")), F.when(F.size("related") > 0, F.lit("Related perspectives:")), F.when(F.size("related") > 0, F.array_join(F.slice("related", 1, 4), "\n\n")),
    )
    return joined.select("prompt_id", "topic", "main", "clarifiers", F.col("n_clarifiers").cast("int").alias("n_clarifiers"), "related", response.alias("response"))


def computed(answers: DataFrame, values: dict[str, str]) -> DataFrame:
    """``respond``'s rows with ``computed``: the value of the main taxon where it is a formula of the catalogue, of its file's domain, whose
    arguments all have ``values`` (SQL text); null elsewhere."""
    found = F.when(F.lit(False), F.lit(None).cast("double"))
    for f in formulas.every():
        if f.solved and not f.over_rows and not f.takes_functions and f.args and set(f.args) <= set(values):
            same = (F.col("main.phylum") == f.domain) & (F.col("main.variable") == "".join(c for c in f.name.lower() if c.isalnum()))
            found = found.when(same, formulas.evaluated(f.domain, f.name, values)["value"])
    return answers.withColumn("computed", found)


def novelty_cover(fragments: Column, most: int = 4) -> Column:
    """Of an array of fragments those that add words, the richest first: the first, then any with a word that none before has."""
    rich = F.sort_array(F.transform(fragments, lambda f, i: F.struct((-F.size(F.array_distinct(text.tokenize(f)))).alias("less"), i.alias("i"), f.alias("f"), F.array_distinct(text.tokenize(f)).alias("w"))))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def fold(a: Column, x: Column) -> Column:
        new = (F.size(a["kept"]) < most) & ((F.size(a["kept"]) == 0) | (F.size(F.array_except(x["w"], a["seen"])) > 0))
        return F.struct(F.when(new, F.concat(a["kept"], F.array(x["f"]))).otherwise(a["kept"]).alias("kept"), F.when(new, F.array_union(a["seen"], x["w"])).otherwise(a["seen"]).alias("seen"))

    return F.aggregate(rich, start, fold, lambda a: a["kept"])
