"""What a prompt asks: master keys, terms, phrases, math in words, patch intents. Ordered rules, first match decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiqua.functions import fragments, slots, text

# Word endings, markers, keywords.
PARTICIPLE_ENDS = (
    "ing ed en nt d t n ne wn pt st ft ld lt rt rd rn rk rm mp nd sk sp th zz ss sh ch ph gh wh ng nk ct xt"
).split()
#: Words at the end of a text that are judged before all others are.
LAST_WORDS = 16
EXAMPLE_MARKERS = [" e.g.", " e.g ", " for example", " such as", " including:", " including ", " (e.g.", " (for example"]
MATH_KEYWORDS = [
    "how many", "how much", "calculate", "compute", "solve", "find", "what is", "evaluate", "convert", "mph", "km/h", "meters", "feet", "miles", "kilograms", "pounds", "liters", "gallons",
    "celsius", "fahrenheit", "distance", "speed", "time", "rate", "total", "sum", "product", "average", "percent", "area", "volume", "angle", "temperature", "weight", "mass",
]
PRECEDENCE = {"**": 4, "^": 4, "*": 3, "/": 3, "//": 3, "%": 3, "+": 2, "-": 2}
CUES = [" is ", " are ", " means ", " refers to ", " defined as ", " is called ", " can be "]

#: What opens a question after one term.
ONE = {"what is", "what's", "what are", "define", "describe", "definition of", "description of"}
#: What opens a question after two, and what joins them.
CONTRAST, BESIDE = {"difference between", "differences between", "compare", "contrast"}, {"and", "to", "with", "from", "versus", "vs"}
HOW, DIFFERS = {"how does", "how do"}, {"differ from", "differs from"}
ALIKE = {"the same", "equivalent", "equal", "related", "synonyms", "alike"}
#: How short the answer should be; no part of a term.
MANNER = r"(?i)\s+(?:in\s+(?:\d+\s+words|one\s+(?:sentence|paragraph)|short)|briefly)[.?]?$"
#: Arithmetic in words. Between two values: signs; before one: what is made of it (``#``).
RATIOS, RATIO_JOINTS = {"ratio of", "ratio", "gain of", "gain"}, {"to", "over", "per", "/", ":"}
SIGNS = {"divided by": "({})/({})", "per": "({})/({})", "/": "({})/({})", "multiplied by": "({})*({})", "times": "({})*({})", "*": "({})*({})", "increased by": "({}) + ({})", "decreased by": "({}) - ({})"}
PARTS = {"half of": "(1/2)*({})", "third of": "(1/3)*({})", "quarter of": "(1/4)*({})"}
POWERS = {"square root of": "({})**0.5", "square of": "({})**2"}
EQUATION = r"^\s*(.+?)\s*(?::=|=|\bequals\b|≡)\s*(.+?)\s*$"
#: Two numbers or names with a colon between them are a ratio.
COLON = r"^\s*([A-Za-z0-9_.]+)\s*:\s*([A-Za-z0-9_.]+)\s*$"
#: Verbs that ask to change a text, what joins its old and new form, and arrows that stand for both.
CHANGES = {"grep": {"replace it with", "replace with", "replace"}, "replace": {"with"}, "change": {"to", "into"}, "rename": {"to", "into", "as"}}
ARROWS = {"->", "=>"}


def without_trailing_participles(c: Column) -> Column:
    """White space as single spaces, and the words at the end that look like participles gone.

    The last ``LAST_WORDS`` words are judged first; all of them only where these are participles alone.
    """
    looks = lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", "").rlike(rf"(?i)(?:{'|'.join(PARTICIPLE_ENDS)})$")
    other = lambda words: F.array_position(F.transform(words, looks), False)

    def cut(words: Column) -> Column:
        some, every = other(F.slice(F.reverse(words), 1, LAST_WORDS)), other(F.reverse(words))
        left = lambda at: F.when(at == 0, "").otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - at + 1, F.lit(0)).cast("int")), " "))
        return slots.bound(F.when(some > 0, some).otherwise(every), left)

    return slots.bound(F.filter(F.split(text.blank(c), r"\s+"), lambda w: w != ""), cut)


def without_examples(c: Column) -> Column:
    """The text before its first example marker."""
    at = F.array_min(F.filter(F.array(*[F.instr(c, F.lit(m)) for m in EXAMPLE_MARKERS]), lambda i: i > 0))
    return F.when(at.isNull(), c).otherwise(F.regexp_replace(F.substring(c, F.lit(1), at - 1), r"^[ ,;:()]+|[ ,;:()]+$", ""))


def master_key(c: Column) -> Column:
    """The key after "what is" or "what does ... mean", lower-cased and without an article; null where neither is asked."""
    t = F.lower(text.blank(c))
    found = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"^what is ([a-z0-9_\- ]+)[?.]?", r"^what does ([a-z0-9_\- ]+) mean[?.]?")))
    return F.regexp_replace(F.trim(found), r"^(?:a|an|the)\s+", "")


def term(c: Column) -> Column:
    """A term as it is asked for: no manner, no marks, no article, at most four words, each in lower case and singular."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), MANNER, ""), r"[^A-Za-z0-9\s'-]", "")
    words = F.filter(F.split(F.lower(F.regexp_replace(F.trim(plain), r"(?i)^(?:a|an|the)\s+", "")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 4), text.singularize), " ")


def asked_terms(c: Column) -> Column:
    """The terms that a question is after: two that it compares, else the one that it asks for; null if it is neither."""

    def read(t: Column) -> Column:
        two = F.coalesce(slots.pair(t, CONTRAST, BESIDE), slots.pair(t, HOW, DIFFERS), slots.pair(t, {"are"}, {"and"}, ALIKE))
        one = F.nullif(F.trim(slots.after(t, ONE)), F.lit(""))
        named = lambda x: F.when(x["two"].isNotNull(), F.array(term(x["two"]["a"]), term(x["two"]["b"]))).when(x["one"].isNotNull(), F.array(term(x["one"])))
        return slots.bound(F.struct(two.alias("two"), one.alias("one")), named)

    return F.filter(slots.bound(slots.asked(c), read), lambda x: x != "")


def candidate_terms(c: Column) -> Column:
    """Where no question form fits: all spans of four words to one in singular, each once, but those with a question word or of pronouns alone."""
    words = text.words(c)
    asks = "what which who whom whose when where why how".split()
    pronouns = "i me my mine myself you your yours he him his she her hers it its we us our ours they them their theirs this that these those".split()

    def spans(n: int) -> Column:
        return F.transform(F.filter(text.ngrams(words, n), lambda p: ~F.arrays_overlap(F.split(p, " "), F.array(*map(F.lit, asks))) & F.exists(F.split(p, " "), lambda w: ~w.isin(*pronouns) & w.rlike("^[a-z]+$"))), lambda p: F.array_join(F.transform(F.split(p, " "), text.singularize), " "))

    return F.array_distinct(F.concat(*map(spans, (4, 3, 2, 1))))


def is_math(c: Column) -> Column:
    t, found = F.lower(text.blank(c)), F.lit(False)
    for k in MATH_KEYWORDS:
        found = found | t.contains(k)
    return t.rlike("[0-9]") & (found | t.rlike(r"[-+*/=^]"))


def precedence(c: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for op, n in PRECEDENCE.items():
        found = found.when(c == op, n)
    return found.otherwise(0)


def phrase(c: Column) -> Column:
    """Arithmetic in words: ``kind`` (equation, expr, range, compare, none) and ``expr``; an equation's right side is cleaned as a fragment."""
    said = text.blank(c)
    low = F.lower(said)
    told = lambda kind, expr: F.struct(kind.alias("kind"), expr.alias("expr"))
    equation = told(F.lit("equation"), F.concat(F.regexp_extract(said, EQUATION, 1), F.lit(" = "), fragments.normalize_fragment(F.regexp_extract(said, EQUATION, 2))))
    ratio = told(F.lit("expr"), F.concat(F.lit("("), F.regexp_extract(low, COLON, 1), F.lit(")/("), F.regexp_extract(low, COLON, 2), F.lit(")")))

    last, first = (lambda x: F.element_at(F.split(x, " "), -1)), (lambda x: F.get(F.split(x, " "), F.lit(0)))
    value = lambda x: F.when(x.rlike("^[a-z0-9_.]+$"), x)

    def made(pattern: str, *values: Column) -> Column:
        """The pattern with its values; null if one is."""
        fine, pieces = F.lit(True), pattern.split("{}")
        for v in values:
            fine = fine & v.isNotNull()
        return F.when(fine, told(F.lit("expr"), F.concat(F.lit(pieces[0]), *(x for v, p in zip(values, pieces[1:]) for x in (v, F.lit(p))))))

    def between(sides: Column, pattern: str) -> Column:
        return slots.bound(sides, lambda s: slots.bound(F.struct(value(last(s["a"])).alias("a"), value(first(s["b"])).alias("b")), lambda x: made(pattern, x["a"], x["b"])))

    def before(t: Column, word: str, pattern: str, whole: bool) -> Column:
        return slots.bound(F.nullif(F.trim(slots.after(t, {word})), F.lit("")), lambda x: made(pattern, x if whole else value(first(x))))

    def read(t: Column) -> Column:
        ranged = slots.bound(int_to_int(t), lambda x: F.when(x["kind"] != "none", told(x["kind"], F.concat(x["a"], F.lit(".."), x["b"]))))
        signed = [between(slots.halves(t, {word}), pattern) for word, pattern in SIGNS.items()]
        parts = [before(t, word, pattern, True) for word, pattern in PARTS.items()] + [before(t, word, pattern, False) for word, pattern in POWERS.items()]
        return F.coalesce(between(slots.pair(t, RATIOS, RATIO_JOINTS), "({})/({})"), ranged, *signed, *parts, told(F.lit("none"), F.lit(None).cast("string")))

    return F.when(said.rlike(EQUATION), equation).when(low.rlike(COLON), ratio).otherwise(slots.bound(slots.spaced(low), read))


def int_to_int(c: Column) -> Column:
    """``kind`` (range, compare or none) and the bounds ``a`` and ``b`` of "a to b": the words beside it, without brackets."""
    bare = lambda x: F.when(F.translate(x, "()", "").rlike("^[A-Za-z0-9_+-]+$"), F.translate(x, "()", ""))
    sides = lambda s: F.struct(bare(F.element_at(F.split(s["a"], " "), -1)).alias("a"), bare(F.get(F.split(s["b"], " "), F.lit(0))).alias("b"))

    def read(x: Column) -> Column:
        fits = x["a"].isNotNull() & x["b"].isNotNull()
        kind = F.when(~F.coalesce(fits, F.lit(False)), "none").when(F.contains(F.lower(text.blank(c)), F.lit("compare")), "compare").otherwise("range")
        return F.struct(kind.alias("kind"), F.when(fits, x["a"]).alias("a"), F.when(fits, x["b"]).alias("b"))

    return slots.bound(slots.bound(slots.halves(slots.spaced(c), {"to"}), sides), read)


def patch_intent(c: Column) -> Column:
    """``old, new`` and flags of a request to change a text; null where it asks for none."""
    p = F.trim(text.blank(c))
    asks = F.lower(p).rlike("patch|replace|change")
    named = lambda word: p.rlike(rf"(?i)\b(?:{word})\b")
    after = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))

    told = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    both = lambda sides: slots.bound(sides, lambda x: F.when(x.isNotNull(), told(slots.quoted(x["a"]), slots.quoted(x["b"]))))

    def closed_quote(x: Column, joints: set[str]) -> Column:
        """Of a text that begins with a quote, and ``x["end"]`` of it: what it holds, and what follows the joint behind it."""
        behind = slots.after(slots.spaced(F.substring(x["inner"], x["end"] + 1, F.length(x["inner"]))), joints)
        return slots.bound(behind, lambda b: F.when(b.isNotNull(), told(F.trim(F.substring(x["inner"], F.lit(1), x["end"] - 1)), slots.quoted(b))))

    def changed(t: Column, verb: str, joints: set[str]) -> Column:
        def read(rest: Column) -> Column:
            mark, inner = F.substring(rest, 1, 1), F.substring(rest, F.lit(2), F.length(rest))
            parted = F.struct(inner.alias("inner"), F.when(mark.isin("'", '"'), F.position(mark, inner)).otherwise(0).alias("end"))
            return slots.bound(parted, lambda x: F.when(x["end"] > 0, closed_quote(x, joints)).otherwise(both(slots.halves(slots.spaced(rest), joints))))

        return slots.bound(F.trim(slots.after(t, {verb})), read)

    def read(t: Column) -> Column:
        pointed = slots.bound(slots.halves(t, ARROWS), lambda x: F.when(x.isNotNull(), told(F.element_at(F.split(x["a"], " "), -1), x["b"])))
        return F.coalesce(*(changed(t, verb, joints) for verb, joints in CHANGES.items()), pointed, both(slots.halves(t, {"to", "into"})))

    def flagged(change: Column) -> Column:
        flags = F.struct(
            change["old"].alias("old"), change["new"].alias("new"), named("apply|write|inplace|commit").alias("apply"), named("dry[- ]?run|preview").alias("dry_run"), named("regex").alias("regex"),
            after(r"(?i)\blayer\s*[:=]?\s*(\w+)").alias("layer"), after(r"([\w\-./\\]+\.json)").alias("path"),
        )
        return F.when(asks & change.isNotNull(), flags)

    return slots.bound(slots.bound(slots.spaced(p), read), flagged)


def is_comparison(c: Column) -> Column:
    """Whether a prompt asks to compare: it says so, joins two terms in a question with are or do, or asks which of two."""
    t = F.lower(text.blank(c))
    says = t.rlike(r"\b(?:difference between|differ from|compare|versus|vs)\b")
    joined = t.rlike(r"\b(?:are|do)\s") & t.rlike(r"\b(?:and|versus|vs)\b|,") & (F.size(candidate_terms(c)) > 1)
    return says | joined | t.rlike(r"\bwhich\b") & t.rlike(r"\bor\b")


#: What stands between the terms of a question that begins with "is", or with "do".
RELATED = {"the same as", "equal to", "equal", "equivalent to", "a type of", "a kind of", "a form of", "part of", "included in", "a subset of", "analogous to", "greater than", "larger than", "more than", "less than", "smaller than"}
COVERING = {"include", "contain", "cover", "mean", "imply", "subsume"}
WHICH = {f"which is {size}:" for size in ("bigger", "larger", "greater", "smaller", "less")}


def compared_terms(c: Column) -> Column:
    """``a`` and ``b`` of a question after equality; null where it is none."""
    bare = lambda x: F.regexp_replace(x, r"^[ ?.,]+|[ ?.,]+$", "")

    def read(t: Column) -> Column:
        begins = lambda openers, joints, closers=(): slots.pair(t, openers, joints, closers, first=True)
        return F.coalesce(
            begins({"is"}, RELATED), begins({"do", "does"}, COVERING), begins({"are"}, {"and"}, ALIKE), begins({"are"}, {"related to"}), begins({"what is the difference between", "what's the difference between"}, {"and"}),
            begins(HOW, DIFFERS), begins(WHICH, {"or"}), begins({"compare"}, {"and", "to"}),
        )

    return slots.bound(slots.bound(F.lower(slots.asked(c)), read), lambda x: F.when(x.isNotNull(), F.struct(bare(x["a"]).alias("a"), bare(x["b"]).alias("b"))))


#: What asks for definitions, before the terms; all but the first ask so only after a verb or at the beginning.
DEFINE, DEFINITION, ASKING = {"define"}, {"definition", "definitions", "definition of", "definitions of"}, ("give", "what is", "what's", "definition", "definitions")


def definition_terms(c: Column) -> Column:
    """The terms that a prompt wants defined, in order; empty where it wants none."""

    def read(t: Column) -> Column:
        asks = F.lit(False)
        for word in ASKING:
            asks = asks | F.startswith(F.lower(t), F.lit(f" {word} "))
        return F.coalesce(slots.after(t, DEFINE, first=True), F.when(asks, slots.after(t, DEFINITION)))

    listed = lambda rest: F.filter(F.transform(F.split(F.regexp_replace(F.trim(rest), MANNER, ""), r"\s*,\s*|\s+(?:and|or)\s+"), term), lambda w: w != "")
    return slots.bound(slots.bound(slots.asked(c), read), lambda rest: F.when(rest.isNotNull(), listed(rest)).otherwise(F.array().cast("array<string>")))


def fragment_score(c: Column, subjects: list[str]) -> Column:
    """How well a fragment defines: an end mark, its length, cue words, and words of the subject."""
    t = F.lower(text.blank(c))
    words = text.words(c)
    score = F.when(c.rlike(r"[.!?]\s*$"), 1.0).otherwise(0.0) + F.least(F.size(words) / F.lit(20.0), F.lit(2.0))
    for cue in CUES:
        score = score + F.when(t.contains(cue), 2.0).otherwise(0.0)
    return score + F.size(F.array_intersect(words, F.array(*[F.lit(s.lower()) for s in subjects]))) * 1.5


def source_score(candidate: Column, prompt: str, in_domain: Column, priority: Column, n_sources: int) -> Column:
    """A definition's score: its domain is named, its length, any of the prompt's words in it, its source's place."""
    low, found = F.lower(candidate), F.lit(False)
    for w in prompt.lower().split():
        found = found | low.contains(w)
    return F.when(in_domain, 10).otherwise(0) + F.least(F.floor(F.length(low) / 50), F.lit(2)) + F.when(found, 2).otherwise(0) + (F.lit(n_sources) - priority)


def article(c: Column) -> Column:
    return F.when(F.lower(c).rlike("^[aeiou]"), "an").otherwise("a")


def definition_sentence(name: Column, gloss: Column, formula: Column) -> Column:
    """A name, its gloss as a sentence and, where there is one, its formula."""
    core = F.regexp_replace(F.trim(text.blank(gloss)), r"[.\s]+$", "")
    told = F.concat(text.capitalize_first(name), F.lit(" is "), article(core), F.lit(" "), core, F.lit("."))
    return F.when(text.blank(formula) == "", told).otherwise(F.concat(told, F.lit(" Its formula is "), formula, F.lit(".")))

def definition_style(name: Column, core: Column, details: Column, formula: Column) -> Column:
    """A name, what it is, its details (an array) as a clause, and its formula: "x is a core that a, b, and c. The formula is f."

    A core has an article of its own or gets one; without a core the name is a concept.
    """
    said = F.trim(text.blank(core))
    said = F.when(said == "", "concept").otherwise(said)
    told = F.when(said.rlike(r"(?i)^(?:a|an|the)\s"), said).otherwise(F.concat(article(said), F.lit(" "), said))
    parts = F.filter(F.transform(F.coalesce(details, F.array().cast("array<string>")), lambda d: F.trim(d)), lambda d: d != "")
    n = F.size(parts)
    clause = F.when(n == 0, "").when(n == 1, F.concat(F.lit(" that "), F.get(parts, F.lit(0)))).otherwise(F.concat(F.lit(" that "), F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(parts, F.lit(-1))))
    return F.concat(name, F.lit(" is "), told, clause, F.lit("."), F.when(text.blank(formula) == "", "").otherwise(F.concat(F.lit(" The formula is "), formula, F.lit("."))))
