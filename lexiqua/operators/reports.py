"""Reports: coverage of a period, a comparison of two subjects, support by predicate, phrases of a dictionary, systems of equations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiqua.functions import polynomials, sets, text
from lexiqua.operators import intervals

#: Percent from which subjects are strongly or moderately alike, and the part of a predicate that covers it.
STRONG, MODERATE, COVERS = 60, 30, 0.35
CODE_BIAS = 0.7
#: Texts of equation systems whose solutions a task remembers.
KEPT_SYSTEMS = 10_000


def period_coverage(spans: DataFrame, start: int, end: int, most: int = 10) -> DataFrame:
    """Lines on the spans (``key, start, end``) that meet a period, by overlap, then shortness."""
    share = intervals.overlap_fraction(F.col("start"), F.col("end"), F.lit(start), F.lit(end))
    met = spans.withColumn("overlap", share).filter("overlap > 0")
    best = met.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overlap"), F.col("end") - F.col("start"), "key"))).filter(F.col("rank") <= most)
    return best.select("rank", F.format_string("%s: %d to %d (%.1f%%)", "key", F.col("start"), F.col("end"), F.col("overlap") * 100).alias("line"))


def _bound(value: Column, build) -> Column:
    """``build`` of a value that is computed once, however often it is used: Catalyst repeats an expression in each place."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def comparison(a: Column, b: Column) -> Column:
    """``percent, shared, only_a, only_b, verdict`` of two texts."""

    def build(p: Column) -> Column:
        pa, pb = p["a"], p["b"]
        words = lambda c: F.array_sort(c)
        told = F.struct(sets.percent_similarity(pa, pb).alias("percent"), words(F.array_intersect(pa["nouns"], pb["nouns"])).alias("shared"), words(F.array_except(pa["nouns"], pb["nouns"])).alias("only_a"), words(F.array_except(pb["nouns"], pa["nouns"])).alias("only_b"))
        verdict = lambda percent: F.when(percent >= STRONG, "strong").when(percent >= MODERATE, "moderate").otherwise("weak")
        return _bound(told, lambda t: F.struct(t["percent"].alias("percent"), t["shared"].alias("shared"), t["only_a"].alias("only_a"), t["only_b"].alias("only_b"), verdict(t["percent"]).alias("verdict")))

    return _bound(F.struct(sets.profile(a).alias("a"), sets.profile(b).alias("b")), build)


def two_subject_report(name_a: Column, name_b: Column, a: Column, b: Column) -> Column:
    """How two subjects are alike, where they differ, and what follows, as a paragraph."""
    listed = lambda words: F.when(F.size(words) > 0, text.listed(F.slice(words, 1, 6))).otherwise(F.lit("nothing"))
    means = {"strong": "strongly related", "moderate": "moderately related", "weak": "weakly related"}

    def told(c: Column) -> Column:
        return F.concat(
            name_a, F.lit(" and "), name_b, F.lit(" are "), F.round(F.round(c["percent"], 6)).cast("int").cast("string"), F.lit("% alike. Both concern "), listed(c["shared"]), F.lit(". Only "), name_a, F.lit(" concerns "), listed(c["only_a"]),
            F.lit("; only "), name_b, F.lit(" concerns "), listed(c["only_b"]), F.lit(". They are "), F.element_at(F.create_map(*(F.lit(x) for kv in means.items() for x in kv)), c["verdict"]), F.lit("."),
        )

    return _bound(comparison(a, b), told)


# Words that negate, verbs and the like that say nothing of a predicate.
NEGATIONS = ["not", "n't", "no", "never", "cannot", "without"]
EMPTY_VERBS = "do does did move moves moved be is are have has by with using use".split()


def _predicate_words(predicate: str) -> list[str]:
    """What a predicate says, or all its words where that is nothing."""
    words = predicate.lower().split()
    return [w for w in words if w not in EMPTY_VERBS] or words


def _holds_any(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for w in parts:
        found = found | F.contains(F.lower(c), F.lit(w))
    return found


def evidence(fragments: DataFrame, predicate: str) -> DataFrame:
    """Of ``term, ord, fragment`` what speaks for a predicate in each term's fragments, and what negates it: ``term, has, supporting, unsupporting``.

    A term has the predicate if one of its words is a word of the fragments, without a last e or with an s, too.
    """
    core = _predicate_words(predicate)
    forms = list(dict.fromkeys(x for w in core for x in (w, w.rstrip("e"), w + "s")))
    held = F.arrays_overlap(text.words(F.col("fragment")), F.array(*map(F.lit, forms)))
    gather = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "fragment")))), lambda x: x["fragment"])
    against = _holds_any(F.col("fragment"), NEGATIONS) & _holds_any(F.col("fragment"), predicate.lower().split())
    return fragments.groupBy("term").agg(F.coalesce(F.bool_or(held), F.lit(False)).alias("has"), gather(_holds_any(F.col("fragment"), core)).alias("supporting"), gather(against).alias("unsupporting"))


def predicate_answer(found: DataFrame, a: str, b: str, predicate: str) -> DataFrame:
    """One row: ``response`` on whether two terms both have a predicate, with up to two fragments each, and ``evidence`` of both."""
    pick = lambda t, c: F.first(F.when(F.col("term") == t, F.col(c)), ignorenulls=True)
    kind = "struct<has:boolean,supporting:array<string>,unsupporting:array<string>>"
    side = lambda t: F.struct(F.coalesce(pick(t, "has"), F.lit(False)).alias("has"), F.coalesce(pick(t, "supporting"), F.array()).alias("supporting"), F.coalesce(pick(t, "unsupporting"), F.array()).alias("unsupporting")).cast(kind)
    name = lambda t: F.lit(t[:1].upper() + t[1:])
    some = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 2), "; ")).otherwise("(no direct supporting fragments)")
    both = found.agg(side(a).alias("a"), side(b).alias("b"))
    shown = F.when(F.size("a.supporting") + F.size("b.supporting") > 0, F.concat(F.lit(" Supporting: "), name(a), F.lit(": "), some(F.col("a.supporting")), F.lit("; "), name(b), F.lit(": "), some(F.col("b.supporting")), F.lit("."))).otherwise("")
    answer = F.when(F.col("a.has") & F.col("b.has"), F.concat(name(a), F.lit(" and "), name(b), F.lit(f" both clearly {predicate}."), shown)).otherwise(F.concat(name(a), F.lit(" and "), name(b), F.lit(f" do not clearly both {predicate}.")))
    return both.select(answer.alias("response"), F.struct("a", "b").alias("evidence"))


def shared_token_appraisal(fragments: DataFrame, a: str, b: str, predicate: str) -> DataFrame:
    """Of the words that two terms' fragments (``term, ord, fragment``) share, but their own names: ``token, n_a, n_b, equality, status, sentence``.

    A word is supportive where only fragments for the predicate hold it, unsupportive where only negated ones do, mixed where
    both do, else neutral. Fragments of both terms are read once.
    """
    own = [w for t in (a, b) for w in t.lower().split()]
    rows = fragments.filter(F.col("term").isin(a, b)).select("term", F.lower("fragment").alias("f"), _holds_any(F.col("fragment"), _predicate_words(predicate)).alias("s"), (_holds_any(F.col("fragment"), NEGATIONS) & _holds_any(F.col("fragment"), predicate.lower().split())).alias("u"))
    tokens = rows.select("term", F.explode(F.array_distinct(text.tokenize(F.col("f")))).alias("token")).filter((F.length("token") > 2) & ~F.col("token").isin(*own)).distinct().groupBy("token").count().filter("count = 2").select("token")
    held = rows.join(tokens, F.contains("f", "token"))
    times = ((F.length("f") - F.length(F.replace("f", F.col("token"), F.lit("")))) / F.length("token")).cast("long")
    count = lambda t: F.coalesce(F.sum(F.when(F.col("term") == t, times)), F.lit(0)).cast("long")
    told = held.groupBy("token").agg(count(a).alias("n_a"), count(b).alias("n_b"), F.bool_or("s").alias("_s"), F.bool_or("u").alias("_u"))
    status = F.when(F.col("_s") & F.col("_u"), "mixed").when(F.col("_s"), "supportive").when(F.col("_u"), "unsupportive").otherwise("neutral")
    equality = F.when(F.col("n_a") == F.col("n_b"), "equal").when(F.col("n_a") > F.col("n_b"), f"more_in_{a}").otherwise(f"more_in_{b}")
    means = {"supportive": "which supports similarity", "unsupportive": "but it is negated in one of them at least", "mixed": "with evidence for and against", "neutral": "without evidence for or against"}
    told = told.withColumn("status", status).withColumn("equality", equality)
    how = F.when(F.col("n_a") == F.col("n_b"), F.concat(F.lit(" They do so equally often ("), F.col("n_a").cast("string"), F.lit(" times).")))
    how = how.otherwise(F.concat(F.lit(" It is more frequent in "), F.when(F.col("n_a") > F.col("n_b"), a).otherwise(b), F.lit(" ("), F.greatest("n_a", "n_b").cast("string"), F.lit(" against "), F.least("n_a", "n_b").cast("string"), F.lit(").")))
    sentence = F.concat(F.lit(f"Both {a} and {b} mention '"), F.col("token"), F.lit("', "), F.element_at(F.create_map(*(F.lit(x) for kv in means.items() for x in kv)), F.col("status")), F.lit("."), how)
    return told.select("token", "n_a", "n_b", "equality", "status", sentence.alias("sentence"))


def detailed_comparison(fragments: DataFrame, a: str, b: str, predicate: str) -> DataFrame:
    """One row on two terms: ``response`` and ``evidence`` on the predicate, ``shared`` (the appraised words), ``numbers`` (those that each
    side's fragments name, in order) and ``narrative``."""
    answer = predicate_answer(evidence(fragments, predicate), a, b, predicate)
    tokens = shared_token_appraisal(fragments, a, b, predicate).agg(F.array_sort(F.collect_list(F.struct("token", "n_a", "n_b", "equality", "status", "sentence"))).alias("shared"))
    found = lambda t: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("term") == t, F.struct("ord", "n")))), lambda x: x["n"]))
    numbers = fragments.select("term", "ord", F.regexp_extract_all("fragment", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)).alias("n")).agg(F.struct(found(a).alias("a"), found(b).alias("b")).alias("numbers"))
    joined = answer.crossJoin(F.broadcast(tokens)).crossJoin(F.broadcast(numbers))  # one row each
    words = F.transform("shared", lambda x: x["token"])
    told = F.when(F.size("shared") > 0, F.concat(F.lit(" Shared words: "), text.listed(words), F.lit("."))).otherwise("")
    return joined.withColumn("narrative", F.concat("response", told))


def equality_answer(a: Column, b: Column, relation: Column, score: Column, reason: Column) -> Column:
    """The answer to a question whether two terms are alike, from their relation."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    shown = F.concat(F.lit(" (score "), F.format_string("%.2f", score), F.lit(")."))
    return (
        F.when(relation == "equal", F.concat(F.lit("Yes: "), quoted(a), F.lit(" and "), quoted(b), F.lit(" are equivalent. ("), reason, F.lit(")")))
        .when(relation == "a_includes_b", F.concat(quoted(a), F.lit(" broadly includes "), quoted(b), shown)).when(relation == "b_includes_a", F.concat(quoted(b), F.lit(" broadly includes "), quoted(a), shown))
        .when(relation == "overlap", F.concat(quoted(a), F.lit(" and "), quoted(b), F.lit(" overlap"), shown)).otherwise(F.concat(quoted(a), F.lit(" and "), quoted(b), F.lit(" appear distinct. ("), reason, F.lit(")")))
    )


def definitions_for(prompts: DataFrame, knowledge: DataFrame) -> DataFrame:
    """``prompt_id, answer``: a line for each term that a prompt (``prompt_id, prompt``) wants defined, from ``term, definitions``.

    Terms meet by their normal key; the first term in order wins where several have one. A prompt that asks for none has no row.
    """
    from lexiqua.functions import prompts as asked

    wanted = prompts.select("prompt_id", F.posexplode(asked.definition_terms(F.col("prompt"))).alias("at", "subject"))
    keyed = knowledge.filter(F.size("definitions") > 0).groupBy(text.normalize_key(F.col("term")).alias("_key")).agg(F.min_by(F.get("definitions", F.lit(0)), "term").alias("told"))
    line = F.concat(text.capitalize_first(F.col("subject")), F.lit(": "), F.when(F.col("told").isNull(), "(no definition found)").otherwise(text.clean_definition(F.col("told"))))
    joined = wanted.withColumn("_want", text.normalize_key(F.col("subject"))).join(keyed, F.col("_want") == F.col("_key"), "left").withColumn("line", line)
    return joined.groupBy("prompt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("answer"))


#: Equations by name, the form that each is known by, and other spellings.
EQUATIONS = [
    ("First Law of Thermodynamics", r"\bDelta\s*U\s*=\s*Q\s*-\s*W\b", ["ΔU = Q - W", "delta U = Q - W"]),
    ("Ideal Gas Law", r"\bP\s*V\s*=\s*n\s*R\s*T\b", ["PV = nRT"]),
    ("Newton's Second Law", r"\bF\s*=\s*m\s*a\b", ["F = ma"]),
    ("Ohm's Law", r"\bV\s*=\s*I\s*R\b", ["V = IR"]),
    ("Second Law of Thermodynamics (entropy)", r"\bDelta\s*S\s*\x{2265}\s*0\b", ["ΔS >= 0", "delta S >= 0"]),
    ("Energy-Mass Equivalence", r"\bE\s*=\s*m\s*c\^2\b", ["E = mc^2"]),
]


def equation_names(c: Column) -> Column:
    """The names of the equations that a text holds, by their form or another spelling, in order of the list."""
    t = text.blank(c)
    named = []
    for name, pattern, spellings in EQUATIONS:
        held = t.rlike(pattern)
        for x in spellings:
            held = held | F.contains(t, F.lit(x))
        named.append(F.when(held, F.lit(name)))
    return F.filter(F.array(*named), lambda n: n.isNotNull())


def best_topic(scores: DataFrame) -> DataFrame:
    """Of ``file, score`` the file with the highest score, code files counted less; the first name on ties."""
    biased = F.col("score") * F.when(F.col("file").startswith("code"), CODE_BIAS).otherwise(1.0)
    return scores.orderBy(F.desc(biased), "file").limit(1)


def token_support(df: DataFrame, side_col: str, text_col: str, tokens: list[str]) -> DataFrame:
    """How often tokens are part of each side's texts (``a``, ``b``), and which side has more."""
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), text.occurrences(F.col(text_col), t).alias("n")) for t in tokens])).alias("t")
    side = lambda s: F.coalesce(F.sum(F.when(F.col(side_col) == s, F.col("t.n"))), F.lit(0)).cast("long")
    counts = df.select(side_col, one).groupBy(F.col("t.token").alias("token")).agg(side("a").alias("a"), side("b").alias("b"))
    return counts.withColumn("label", F.when(F.col("a") == F.col("b"), "equal").when(F.col("a") > F.col("b"), "more in a").otherwise("more in b"))


def predicate_coverage(entries: DataFrame, gloss_col: str, predicate: list[str]) -> DataFrame:
    """The largest part of a predicate's words in any entry, and whether that covers it."""
    words = F.array(*[F.lit(w.lower()) for w in dict.fromkeys(predicate)])
    share = F.size(F.array_intersect(words, text.tokenize(F.col(gloss_col)))) / F.lit(len(set(predicate)))
    return entries.agg(F.coalesce(F.max(share), F.lit(0.0)).alias("coverage")).withColumn("covered", F.col("coverage") >= COVERS)


def phrases(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, longest: int = 4) -> DataFrame:
    """Dictionary phrases (``term``) in each text, chosen greedily from the left, the longest first: ``pos, phrase, head, modifiers``.

    All spans join the dictionary; the choice is a fold over a text's hits in order.
    """
    tokens = df.select(F.col(id_col).alias("id"), text.words(F.col(text_col)).alias("w"))
    span = lambda n: F.transform(text.ngrams(F.col("w"), n), lambda p, i: F.struct(i.alias("pos"), F.lit(n).alias("n"), p.alias("phrase")))
    hits = tokens.select("id", F.explode(F.concat(*map(span, range(1, longest + 1)))).alias("s")).join(terms.select(F.lower("term").alias("_t")).distinct(), F.col("s.phrase") == F.col("_t"), "left_semi")
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("s.pos").alias("pos"), (-F.col("s.n")).alias("less"), F.col("s.phrase").alias("phrase")))).alias("h"))
    kind = "array<struct<pos:int,less:int,phrase:string>>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("kept"))

    def fold(a: Column, h: Column) -> Column:
        fits = (h["pos"] >= a["next"]) & ~F.exists(a["kept"], lambda k: k["phrase"] == h["phrase"])
        return F.struct(F.when(fits, h["pos"] - h["less"]).otherwise(a["next"]).alias("next"), F.when(fits, F.concat(a["kept"], F.array(h))).otherwise(a["kept"]).alias("kept"))

    kept = listed.select("id", F.explode(F.aggregate("h", start, fold)["kept"]).alias("k"))
    words = F.split("k.phrase", " ")
    return kept.select(F.col("id").alias(id_col), F.col("k.pos").alias("pos"), F.col("k.phrase").alias("phrase"), F.element_at(words, -1).alias("head"), F.slice(words, F.lit(1), F.size(words) - 1).alias("modifiers"))


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for frame in frames:
        out = []
        for i, a, b in zip(frame["id"], frame["a"], frame["b"]):
            m = np.array([list(r) for r in a], float)
            try:
                out.append((i, np.linalg.solve(m, np.array(b, float)).tolist() if m.ndim == 2 and m.shape[0] == m.shape[1] else None))
            except np.linalg.LinAlgError:
                out.append((i, None))
        yield pd.DataFrame(out, columns=["id", "x"])


def solve_linear(systems: DataFrame) -> DataFrame:
    """``id, a, b`` (rows of coefficients, right sides) to ``id, x``; null where there is no one solution."""
    return systems.select("id", "a", "b").mapInPandas(_solve, systems.select("id").schema.add("x", T.ArrayType(T.DoubleType())))


def solve_systems(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, solutions, reason`` of texts of polynomial equations with commas between, linear ones among them.

    ``solutions`` are all real ones, a map by unknown each, sorted by the values of the unknowns in order of their names; empty if there is
    none. Where they can't be listed they are null, and ``reason`` says why: no equation, not a polynomial, not finitely many
    solutions, too many unknowns, too large. Every equation of a text is read. Rows are dealt to tasks in their order, and
    a text that many rows have is solved once in each task.
    """

    def solved(said: object) -> tuple[list | None, str | None]:
        if not isinstance(said, str):
            return None, "no equation"
        try:
            return polynomials.solve(said), None
        except polynomials.Unsolved as e:
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = lru_cache(maxsize=KEPT_SYSTEMS)(solved)
        for frame in frames:
            out = [once(said) for said in frame["_said"]]
            yield pd.DataFrame({id_col: frame[id_col], "solutions": [x for x, _ in out], "reason": [r for _, r in out]})

    schema = df.select(id_col).schema.add("solutions", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))).add("reason", T.StringType())
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    told = df.select(id_col, F.col(text_col).alias("_said"))
    # Dealt in order of rows, as a small file is one task however long its systems take.
    dealt = told.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, "_at").sortWithinPartitions("_at")
    return dealt.drop("_at").mapInPandas(run, schema)


def solve_equations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, solution`` (a map by unknown) of texts of equations with commas between, however many; null where ``solve_systems`` finds
    not exactly one solution."""
    found = solve_systems(df, id_col, text_col)
    return found.select(id_col, F.when(F.size("solutions") == 1, F.get("solutions", F.lit(0))).alias("solution"))


def next_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias("next_id"))


def all_passed(checks: DataFrame, passed_col: str) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and(passed_col), F.lit(True)).alias("passed"))
