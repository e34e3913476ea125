"""Text functions as Columns: normalising, tokenising, fragments, keywords, word classes, cleaning, truncation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOPWORDS = "the and or is a an of in on for to with by as at from that which who whom where when why how be been are was were it its this these those but if then so".split()
SUBJECT_STOPWORDS = "the a an of and in on for with to by is are that this as from be or it its".split()
NOISE_WORDS = "http https www wiki wikipedia org com net edu gov".split()
SEPARATOR_WORDS = "which that who where when because although while".split()
CONNECTIVES = "and or but however while although because since therefore thus hence whereas meanwhile furthermore moreover despite in addition consequently accordingly nevertheless henceforth".split()
PREDICATE_ENDS = "ion ment ing ize ise".split()
PREDICATE_WORDS = "compute calculate measure solve".split()
CODE_WORDS = ["def ", "class ", "import ", "lambda", "return", "for ", "while ", "if "]
MATH_WORDS = "integral derivative sum product equation solve".split()
VERBS = "is are was were be has have does do flows runs falls sits stands sprays stalk stalks spray run jump walk swim".split()
SUBJECT_VERBS = "is are was were sprays stalks runs flows".split()
INTERROGATIVES = "what is are the a an of does do how who where when".split()
WORD = r"[\p{L}\p{N}_]+"


def _in(c: Column, words: list[str]) -> Column:
    return c.isin(*words)


def blank(c: Column) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(c, F.lit(""))


def _trimmed(c: Column) -> Column:
    return F.trim(c)


def normalize(c: Column) -> Column:
    """Lower case, and only ``[a-z0-9]`` of it."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(f"({WORD})"), F.lit(1))


def tokenize(c: Column) -> Column:
    """Normalised words in order, with repeats, without stopwords and empty ones."""
    kept = F.filter(words(c), lambda t: ~_in(t, STOPWORDS))
    return F.filter(F.transform(kept, normalize), lambda t: t != "")


def keyword_tokens(c: Column) -> Column:
    return F.filter(words(c), lambda t: ~_in(t, STOPWORDS) & (F.length(t) > 2))


def fragments(c: Column) -> Column:
    """Sentences, cut again at ``, ; :`` and at separator words, which are fragments themselves."""
    marked = F.regexp_replace(F.trim(blank(c)), r"[.?!]\s+", "\u0001")
    marked = F.regexp_replace(marked, r"\b(" + "|".join(SEPARATOR_WORDS) + r")\b", "\u0001$1\u0001")
    parts = F.split(F.regexp_replace(marked, "[,;:]", "\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def is_noise(c: Column) -> Column:
    t = F.lower(blank(c))
    return (t == "") | t.contains("http") | t.contains("www") | _in(t, NOISE_WORDS) | (F.length(t) > 25) | t.rlike("^[0-9]+$")


def looks_like_code_or_math(c: Column) -> Column:
    t = F.lower(blank(c))
    found = t.rlike(r"[-+*/^=<>%]")
    for w in (*CODE_WORDS, *MATH_WORDS):
        found = found | t.contains(w)
    return found


def _distinct_letters(c: Column) -> Column:
    """The distinct words of letters. What is asked of them are sets, so each is judged once, however often it stands in the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-zA-Z_]+)"), F.lit(1)))


def _noise_letters(t: Column) -> Column:
    """``is_noise`` of a word of letters, which isn't empty and holds no digit."""
    return t.contains("http") | t.contains("www") | _in(t, NOISE_WORDS) | (F.length(t) > 25)


def _is_content(t: Column) -> Column:
    return (F.length(t) > 2) & ~_in(t, SUBJECT_STOPWORDS) & ~_noise_letters(t)


def _is_predicate(t: Column) -> Column:
    ends = t.endswith(PREDICATE_ENDS[0])
    for end in PREDICATE_ENDS[1:]:
        ends = ends | t.endswith(end)
    return ends | _in(t, PREDICATE_WORDS)


def word_classes(c: Column) -> Column:
    """``nouns, predicates, participles, connectives`` of a text, each a sorted set; the text is cut once, its words are judged once."""
    kind = lambda t: F.when(_is_content(t), F.when(_is_predicate(t), "p").otherwise("n")).otherwise("")
    judged = F.transform(F.array_sort(_distinct_letters(c)), lambda t: F.struct(t.alias("w"), kind(t).alias("k"), (t.endswith("ing") & (F.length(t) > 4) & ~_noise_letters(t)).alias("i")))
    # A one-row array carries the judged words into all four sets, so they are computed once.
    pick = lambda j, keep: F.transform(F.filter(j, keep), lambda x: x["w"])
    sets = F.transform(F.array(judged), lambda j: F.struct(pick(j, lambda x: x["k"] == "n").alias("nouns"), pick(j, lambda x: x["k"] == "p").alias("predicates"), pick(j, lambda x: x["i"]).alias("participles"), pick(j, lambda x: _in(x["w"], CONNECTIVES)).alias("connectives")))
    return F.get(sets, F.lit(0))


def nouns(c: Column) -> Column:
    return F.array_sort(F.filter(_distinct_letters(c), lambda t: _is_content(t) & ~_is_predicate(t)))


def predicates(c: Column) -> Column:
    return F.array_sort(F.filter(_distinct_letters(c), lambda t: _is_content(t) & _is_predicate(t)))


def participles(c: Column) -> Column:
    return F.array_sort(F.filter(_distinct_letters(c), lambda t: ~_noise_letters(t) & t.endswith("ing") & (F.length(t) > 4)))


def connectives(c: Column) -> Column:
    return F.array_sort(F.filter(_distinct_letters(c), lambda t: _in(t, CONNECTIVES)))


def clean_definition(c: Column) -> Column:
    """Without URLs, host words and bracketed remarks; white space collapsed."""
    t = F.regexp_replace(blank(c), r"https?://\S+|www\.\S+|\S*(?:\.org|/wiki)\S*", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:https?|www|wiki|wikipedia|org|com|net)\b|\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def capitalize_first(c: Column) -> Column:
    """The first ASCII letter, wherever it is, in upper case."""
    at = F.regexp_instr(c, F.lit("[a-zA-Z]"))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.upper(F.substring(c, at, F.lit(1))), F.substring(c, at + 1, F.length(c)))).otherwise(c)


def end_sentence(c: Column) -> Column:
    t = F.rtrim(c)
    return F.when(t == "", t).when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def sentences(c: Column) -> Column:
    """Each line's sentences, trimmed, ended and capitalised."""
    parts = F.split(F.regexp_replace(blank(c), r"([.!?])\s+", "$1\u0001"), "[\u0001\n]")
    kept = F.filter(F.transform(parts, _trimmed), lambda s: s != "")
    return F.transform(kept, lambda s: capitalize_first(end_sentence(s)))


def with_periods(c: Column) -> Column:
    return F.array_join(sentences(c), " ")


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots where it was longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def sentences_with_any(c: Column, terms: list[str], most: int) -> Column:
    """The first distinct sentences that hold a term, each cut at 400 characters."""
    held = F.filter(F.filter(F.transform(F.split(F.regexp_replace(blank(c), r"([.!?])\s+", "$1\u0001"), "[\u0001\n]"), _trimmed), lambda s: s != ""), lambda s: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(s), t)))
    return F.slice(F.array_distinct(F.transform(held, lambda s: truncated(s, 400))), 1, most)


def occurrences(c: Column, term: str) -> Column:
    """How often a term is part of a text, in any case; the term stands for itself, whatever characters it has."""
    return F.regexp_count(F.lower(blank(c)), F.lit(re.escape(term.lower()))) if term else F.lit(0)


def sentences_with(c: Column, word: str, most: int = 1) -> Column:
    """The first distinct sentences that hold one term, each capitalised and ended."""
    return F.transform(sentences_with_any(c, [word], most), lambda s: capitalize_first(end_sentence(s)))


def related_to(c: Column, terms: list[str]) -> Column:
    """Whether any of the terms is in the text as a whole word, in any case."""
    found = F.lit(False)
    for t in terms:
        found = found | blank(c).rlike(rf"(?i)(?<!\w){re.escape(t)}(?!\w)")
    return found


def without_leading_term(c: Column, name: Column) -> Column:
    """A name that begins the text twice stands there once."""
    low, n = F.lower(F.ltrim(blank(c))), F.lower(F.trim(name))
    twice = F.concat(n, F.lit(" "), n)
    rest = F.substring(F.ltrim(blank(c)), F.length(twice) + 1, F.length(c))
    again = F.startswith(low, twice) & ~rest.rlike(r"^\w") & (n != "")
    return F.when(again, F.concat(F.trim(name), rest)).otherwise(c)


def value_text(definition: Column, values: Column) -> Column:
    """An entry's value as text: its definition, else all its values (an array) with spaces between."""
    return F.coalesce(definition, F.array_join(values, " "), F.lit(""))


def is_good_definition(c: Column, term: Column) -> Column:
    """Four characters or more, and neither a part of the term nor a text around it."""
    d, t = F.lower(F.trim(blank(c))), F.lower(blank(term))
    return (F.length(d) >= 4) & ((t == "") | ~(F.contains(t, d) | F.contains(d, t)))


def verbs(c: Column) -> Column:
    """The plain verbs of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(rf"\b({'|'.join(VERBS)})\b"), F.lit(1))


def subjects(c: Column) -> Column:
    """What stands before a verb of being or doing: up to 40 letters and spaces."""
    return F.transform(F.regexp_extract_all(blank(c), F.lit(rf"(\b[ A-Za-z]{{3,40}}?\b)\s+(?:{'|'.join(SUBJECT_VERBS)})\b"), F.lit(1)), _trimmed)


def plural_variants(c: Column) -> Column:
    """The words of a term with their singulars, and with their last letters s gone."""
    own = words(c)
    return F.array_sort(F.array_union(F.array_union(own, F.transform(own, singularize)), F.transform(own, lambda w: F.regexp_replace(w, "s+$", ""))))


def longest(c: Column, most: int = 4) -> Column:
    """The longest of an array's words, then in order of the alphabet."""
    by = F.array_sort(F.transform(c, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(by, lambda x: x["w"]), 1, most)


def listed(c: Column) -> Column:
    """An array as words: ``a, b and c``."""
    n = F.size(c)
    return F.when(n < 2, F.array_join(c, "")).otherwise(F.concat(F.array_join(F.slice(c, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(c, -1)))


def first_chunk_containing(c: Column, term: str) -> Column:
    held = F.filter(F.transform(F.split(blank(c), "[\n.]"), _trimmed), lambda s: F.contains(F.lower(s), F.lit(term.lower())))
    return truncated(F.get(held, F.lit(0)), 240)


def normalize_key(c: Column) -> Column:
    """A key as plain words: separators as spaces, " of " as one space, question words dropped."""
    spaced = F.regexp_replace(F.lower(F.regexp_replace(blank(c), "[_-]", " ")), " of ", " ")
    return F.array_join(F.filter(F.split(spaced, r"\s+"), lambda w: (w != "") & ~_in(w, INTERROGATIVES)), " ")


def singularize(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(c.endswith("ies"), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y"))).when(c.endswith("es"), F.substring(c, F.lit(1), n - 2)).when(c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), n - 1)).otherwise(c)
    )


def key_word_set(c: Column) -> Column:
    own = F.filter(F.split(normalize_key(c), " "), lambda w: w != "")
    return F.array_sort(F.array_union(own, F.transform(own, singularize)))


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Punct}]+$", "")


def signed_integers(c: Column) -> Column:
    """Whole numbers with their sign; null where one is beyond 64 bits."""
    return F.transform(F.regexp_extract_all(blank(c), F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.try_cast("long"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by spaces."""
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, spans).otherwise(F.array().cast("array<string>"))
