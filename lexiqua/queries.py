"""The engine's queries over the supplied tables, each with DuckDB SQL for the same result where SQL has one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.functions import dates, formulas, fuzzy, mathexpr, prompts, sets, text
from lexiqua.operators import intervals, lookup, match, relations
from lexiqua.operators.spread import spread
from lexiqua.plans import sessions
from lexiqua.streaming import conversation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# SQL for the text functions.
_STOP, _SUBJECT_STOP = _list(text.STOPWORDS), _list(text.SUBJECT_STOPWORDS)


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def _normal(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


def _tokens(c: str) -> str:
    return f"list_filter(list_transform(list_filter({_words(c)}, lambda x: x NOT IN ({_STOP})), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '')"


def _noise(x: str) -> str:
    return f"({x} = '' OR contains({x}, 'http') OR contains({x}, 'www') OR {x} IN ({_list(text.NOISE_WORDS)}) OR length({x}) > 25 OR regexp_matches({x}, '^[0-9]+$'))"


def _letters(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-zA-Z_]+')"


_PREDICATE = f"(regexp_matches(x, '({'|'.join(text.PREDICATE_ENDS)})$') OR x IN ({_list(text.PREDICATE_WORDS)}))"


def _content(c: str, more: str) -> str:
    return f"list_sort(list_distinct(list_filter({_letters(c)}, lambda x: x NOT IN ({_SUBJECT_STOP}) AND length(x) > 2 AND NOT {_noise('x')} AND {more})))"


def _profile(c: str, suffix: str = "") -> str:
    return (
        f"{_content(c, 'NOT ' + _PREDICATE)} AS nouns{suffix}, {_content(c, _PREDICATE)} AS predicates{suffix}, "
        f"list_sort(list_distinct(list_filter({_letters(c)}, lambda x: NOT {_noise('x')} AND ends_with(x, 'ing') AND length(x) > 4))) AS participles{suffix}, list_sort(list_distinct(list_filter({_letters(c)}, lambda x: x IN ({_list(text.CONNECTIVES)})))) AS connectives{suffix}"
    )


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN CAST(1 AS DOUBLE) ELSE len(list_intersect({a}, {b})) / CAST(greatest({union}, 1) AS DOUBLE) END"


_PERCENT = "(" + " + ".join(f"({_jaccard('a.' + k, 'b.' + k)}) * CAST({w} AS DOUBLE)" for k, w in zip(("nouns", "predicates", "participles", "connectives"), sets.WEIGHTS, strict=True)) + ") * 100"


# Text


@query(
    f"""WITH k AS (SELECT doc_id, list_filter({_words('text')}, lambda x: x NOT IN ({_STOP}) AND length(x) > 2) AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS keyword, unnest(range(len(ws))) AS pos FROM k), c AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS pos FROM t GROUP BY 1, 2),
r AS (SELECT doc_id, keyword, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c) SELECT * FROM r WHERE rank <= 6"""
)
def kw_top6(spark, sf_dir):
    return match.keywords(_t(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"SELECT doc_id, CAST(length({_normal('text')}) AS INT) AS n_normal, md5({_normal('text')}) AS normal_md5 FROM documents")
def str1_normalize(spark, sf_dir):
    n = text.normalize(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(n).alias("n_normal"), F.md5(n).alias("normal_md5"))


@query(f"WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t")
def str2_token_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    rf"""WITH f AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(trim(coalesce(text, '')), '[.?!]\s+', chr(1), 'g'), '\b({'|'.join(text.SEPARATOR_WORDS)})\b', chr(1) || '\1' || chr(1), 'g'), '[,;:' || chr(1) || ']'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS f FROM conversations)
SELECT conv_id, turn, CAST(len(f) AS INT) AS n_fragments, md5(array_to_string(f, '|')) AS fragments_md5 FROM f"""
)
def str3_fragments(spark, sf_dir):
    f = _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.fragments(F.col("text")).alias("f"))
    return f.select("conv_id", "turn", F.size("f").alias("n_fragments"), F.md5(F.array_join("f", "|")).alias("fragments_md5"))


@query(
    f"""SELECT conv_id, turn, CAST(len(list_filter({_words('text')}, lambda x: {_noise('x')})) AS INT) AS n_noise,
(regexp_matches(lower(coalesce(text, '')), '[-+*/^=<>%]') OR {' OR '.join(f"contains(lower(coalesce(text, '')), '{w}')" for w in (*text.CODE_WORDS, *text.MATH_WORDS))}) AS code_or_math FROM conversations"""
)
def str5_6_noise_and_code(spark, sf_dir):
    c = F.col("text")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(text.words(c), text.is_noise)).alias("n_noise"), text.looks_like_code_or_math(c).alias("code_or_math"))


@query(
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+|\S*(?:\.org|/wiki)\S*', ' ', 'g'), '(?i)\b(?:https?|www|wiki|wikipedia|org|com|net)\b|\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, md5(c) AS clean_md5, regexp_extract(c, '[a-zA-Z]') AS first_letter FROM c"""
)
def str7_clean_definition(spark, sf_dir):
    c = text.clean_definition(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.regexp_extract(c, "[a-zA-Z]", 0).alias("first_letter"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '[' || chr(1) || chr(10) || ']'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations),
e AS (SELECT conv_id, turn, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END) AS s FROM s),
c AS (SELECT conv_id, turn, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '[a-zA-Z]') THEN regexp_extract(x, '^[^a-zA-Z]*') || upper(substring(x, length(regexp_extract(x, '^[^a-zA-Z]*')) + 1, 1)) || substring(x, length(regexp_extract(x, '^[^a-zA-Z]*')) + 2) ELSE x END) AS s FROM e)
SELECT conv_id, turn, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, ' ')) AS text_md5 FROM c"""
)
def str8_9_sentences(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, " ")).alias("text_md5"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '[' || chr(1) || chr(10) || ']'), lambda x: trim(x)), lambda x: x <> '' AND (contains(lower(x), 'tion') OR contains(lower(x), 'mente'))) AS s FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_transform(s, lambda x: CASE WHEN length(x) > 400 THEN left(x, 397) || '...' ELSE x END))) AS INT) AS n, CASE WHEN length(s[1]) > 400 THEN left(s[1], 397) || '...' ELSE s[1] END AS first FROM s"""
)
def str12_sentences_with_terms(spark, sf_dir):
    s = text.sentences_with_any(F.col("text"), ["tion", "mente"], 1_000_000)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.get(s, F.lit(0)).alias("first"))


_SINGULAR = "CASE WHEN ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN ends_with(x, 'es') THEN left(x, length(x) - 2) WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END"


@query(
    rf"""WITH k AS (SELECT p_partkey, p_name || '_of Types-' || p_type || 's' AS k FROM part),
w AS (SELECT p_partkey, list_filter(string_split_regex(replace(lower(regexp_replace(k, '[_-]', ' ', 'g')), ' of ', ' '), '\s+'), lambda x: x <> '' AND x NOT IN ({_list(text.INTERROGATIVES)})) AS w FROM k)
SELECT p_partkey, array_to_string(w, ' ') AS normal_key, array_to_string(list_sort(list_distinct(list_concat(w, list_transform(w, lambda x: {_SINGULAR})))), ' ') AS word_set FROM w"""
)
def str15_17_keys(spark, sf_dir):
    k = F.concat(F.col("p_name"), F.lit("_of Types-"), F.col("p_type"), F.lit("s"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.normalize_key(k).alias("normal_key"), F.array_join(text.key_word_set(k), " ").alias("word_set"))


@query(f"WITH p AS (SELECT doc_id, {_profile('text')} FROM documents) SELECT doc_id, CAST(len(nouns) AS INT) AS n_nouns, md5(array_to_string(nouns, ' ')) AS nouns_md5, array_to_string(predicates, ' ') AS predicates, array_to_string(participles, ' ') AS participles, array_to_string(connectives, ' ') AS connectives FROM p")
def str27_28_profile(spark, sf_dir):
    p = sets.profile(F.col("text"))
    d = _t(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    joined = [F.array_join(F.col("p")[k], " ").alias(k) for k in ("predicates", "participles", "connectives")]
    return d.select("doc_id", F.size("p.nouns").alias("n_nouns"), F.md5(F.array_join("p.nouns", " ")).alias("nouns_md5"), *joined)


@query(r"SELECT event_id, list_transform(regexp_extract_all(props || ' -12 x7', '-?\d+'), lambda x: CAST(x AS BIGINT)) AS numbers FROM events")
def str34_integers(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.signed_integers(F.concat(F.col("props"), F.lit(" -12 x7"))).alias("numbers"))


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 237) || '...' ELSE text END AS short FROM documents")
def str40_truncated(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 240).alias("short"))


# Prompts

_PLAIN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, md5(regexp_replace({_PLAIN}, '(?i)(?:(?:^| )[^ ]*(?:{'|'.join(prompts.PARTICIPLE_ENDS)})[.,;:]*)+$', '')) AS stripped_md5 FROM documents")
def str19_participles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(prompts.without_trailing_participles(F.col("text"))).alias("stripped_md5"))


_MARKED = "p_name || ', ' || CASE p_partkey % 4 WHEN 0 THEN 'red (e.g. this)' WHEN 1 THEN 'blue; such as that' WHEN 2 THEN 'for example x e.g. y' ELSE 'plain' END"
_CUTS = "list_min(list_filter([" + ", ".join(f"instr(t, '{m}')" for m in prompts.EXAMPLE_MARKERS) + "], lambda i: i > 0))"


@query(rf"WITH m AS (SELECT p_partkey, {_MARKED} AS t FROM part) SELECT p_partkey, CASE WHEN {_CUTS} IS NULL THEN t ELSE regexp_replace(substring(t, 1, {_CUTS} - 1), '^[ ,;:()]+|[ ,;:()]+$', '', 'g') END AS cut FROM m")
def str20_examples(spark, sf_dir):
    ends = F.array(*map(F.lit, ("red (e.g. this)", "blue; such as that", "for example x e.g. y", "plain")))
    marked = F.concat(F.col("p_name"), F.lit(", "), F.element_at(ends, (F.col("p_partkey") % 4 + 1).cast("int")))
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.without_examples(marked).alias("cut"))


_QUESTIONS = [
    ("What is the difference between the {a} and {b}?", 2), ("Define a {a} in 10 words.", 1), ("how does {a} differ from {b}?", 2), ("Give me a brief definition of the {a}?", 1), ("what's {a}", 1), ("Are {a} and {b} equivalent?", 2),
    ("describe {a} in one sentence?", 1), ("compare {a} and {b}", 2), ("What are {a}!", 1), ("the difference between a {a} and {b}", 2), ("{a} {b}", 0),
]


@query(f"SELECT p_partkey, p_name AS key, CASE [{', '.join(str(n) for _, n in _QUESTIONS)}][p_partkey % {len(_QUESTIONS)} + 1] WHEN 2 THEN p_name || ',' || lower(p_type) WHEN 1 THEN p_name END AS terms FROM part")
def str23_24_questions(spark, sf_dir):
    form = F.element_at(F.array(*(F.lit(q) for q, _ in _QUESTIONS)), (F.col("p_partkey") % len(_QUESTIONS) + 1).cast("int"))
    asked = F.replace(F.replace(form, F.lit("{a}"), F.col("p_name")), F.lit("{b}"), F.col("p_type"))
    even = F.col("p_partkey") % 2 == 0
    key = F.concat(F.when(even, "What is a ").otherwise("What does the "), F.col("p_name"), F.when(even, "?").otherwise(" mean?"))
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.master_key(key).alias("key"), F.array_join(prompts.asked_terms(asked), ",").alias("terms"))


@query("SELECT p_partkey, p_name || ' sold|' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 2) || ' sold|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || '|sold' AS spans FROM part")
def str24_candidate_terms(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(prompts.candidate_terms(F.concat("p_name", F.lit(" sold"))), "|").alias("spans"))


_PHRASED = [
    "ratio of {a} to {b}", "{a} to {b}", "compare {a} to {b}", "{a} divided by {b}", "{a} times {b}", "half of {b}", "square root of {a}", "{a} increased by {b}", "{a} = {b}x", "nothing",
    "gain of {a} to {b}", "gain {a} over {b}", "{a} per {b}", "{a} : {b}", "{a} decreased by {b}", "a quarter of {a}", "square of {b}", "from ({a}) to ({b})", "y equals {a}({b}+1", "one third of x",
]
_PHRASE_SQL = [
    "expr:({a})/({b})", "range:{a}..{b}", "compare:{a}..{b}", "expr:({a})/({b})", "expr:({a})*({b})", "expr:(1/2)*({b})", "expr:({a})**0.5", "expr:({a}) + ({b})", "equation:{a} = {b}*x", "none:",
    "expr:({a})/({b})", "expr:({a})/({b})", "expr:({a})/({b})", "expr:({a})/({b})", "expr:({a}) - ({b})", "expr:(1/4)*({a})", "expr:({b})**2", "range:{a}..{b}", "equation:y = {a}*({b}+1)", "expr:(1/3)*(x)",
]


def _filled(forms: list[str], kind: str) -> str:
    a, b = (f"' || CAST({c} AS {kind}) || '" for c in ("p_partkey", "p_size"))
    return f"CASE p_partkey % {len(forms)} " + " ".join(f"WHEN {i} THEN '" + f.replace("{a}", a).replace("{b}", b) + "'" for i, f in enumerate(forms)) + " END"


@query(f"SELECT p_partkey, {_filled(_PHRASE_SQL, 'VARCHAR')} AS meaning FROM part")
def str30_31_phrases(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("said", F.expr(_filled(_PHRASED, "STRING"))).withColumn("p", prompts.phrase(F.col("said")))
    return p.select("p_partkey", F.concat(F.col("p.kind"), F.lit(":"), F.coalesce("p.expr", F.lit(""))).alias("meaning"))


_KEYWORDS = " OR ".join(f"contains(lower(text), '{k}')" for k in prompts.MATH_KEYWORDS)


@query(f"SELECT doc_id, regexp_matches(coalesce(text, ''), '[0-9]') AND (regexp_matches(text, '[-+*/=^]') OR {_KEYWORDS}) AS is_math FROM documents")
def str32_is_math(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", prompts.is_math(F.col("text")).alias("is_math"))


#: A request, its new text, and whether it says to write, to try, that it is a pattern, its layer and its file.
_CHANGES = [
    ("replace '{a}' with '{b}' in layer {n} and apply", "{b}", True, False, False, "{n}", None), ("replace '{a}' with '{b}'", "{b}", False, False, False, None, None), ("grep '{a}' and replace it with '{b}'", "{b}", False, False, False, None, None),
    ("change {a} into '{b}' as a dry run", "{b}", False, True, False, None, None), ("Change '{a}' to '{b}' in place.json, regex", "{b}", False, False, True, None, "place.json"), ("patch: rename '{a}' as '{b}' layer: {n}", "{b}", False, False, False, "{n}", None),
    ("patch {n} -> {b}", "{b}", False, False, False, None, None), ("patch {n} => {b} now", "{b} now", False, False, False, None, None), ("change it", None, None, None, None, None, None), ("move {a} to {b}", None, None, None, None, None, None),
]


def _change(at: int) -> str:
    def one(x: str | bool | None) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("{a}", "' || p_name || '").replace("{b}", "' || p_type || '").replace("{n}", "' || CAST(p_size AS VARCHAR) || '") + "'"

    return f"CASE p_partkey % {len(_CHANGES)} " + " ".join(f"WHEN {i} THEN {one(c[at])}" for i, c in enumerate(_CHANGES)) + " END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % {len(_CHANGES)} IN (6, 7) THEN CAST(p_size AS VARCHAR) WHEN p_partkey % {len(_CHANGES)} < 6 THEN p_name END AS old, {_change(1)} AS new, {_change(2)} AS apply, {_change(3)} AS dry_run, {_change(4)} AS regex, {_change(5)} AS layer, {_change(6)} AS path FROM part")
def str38_patch_intent(spark, sf_dir):
    form = F.element_at(F.array(*(F.lit(c[0]) for c in _CHANGES)), (F.col("p_partkey") % len(_CHANGES) + 1).cast("int"))
    said = F.replace(F.replace(F.replace(form, F.lit("{a}"), F.col("p_name")), F.lit("{b}"), F.col("p_type")), F.lit("{n}"), F.col("p_size").cast("string"))
    i = prompts.patch_intent(said)
    return _t(spark, sf_dir, "part").select("p_partkey", *(i[c].alias(c) for c in ("old", "new", "apply", "dry_run", "regex", "layer", "path")))


_CUE_SQL = " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{c}') THEN 2 ELSE 0 END" for c in prompts.CUES)


@query(
    rf"""WITH s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[.!?]\s*$') THEN CAST(1 AS DOUBLE) ELSE 0 END + least(len({_words('text')}) / CAST(20 AS DOUBLE), 2) + {_CUE_SQL} + len(list_intersect({_words('text')}, ['la', 'the', 'une'])) * CAST(1.5 AS DOUBLE) AS score FROM conversations)
SELECT conv_id, turn, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) <= 2"""
)
def win9_best_fragments(spark, sf_dir):
    scored = _t(spark, sf_dir, "conversations").withColumn("score", prompts.fragment_score(F.col("text"), ["la", "the", "une"]))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))
    return scored.withColumn("rank", rank).filter("rank <= 2").select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, CAST(CASE WHEN p_type = 'ECONOMY' THEN 10 ELSE 0 END + least(length(p_name || ' ' || p_type) // 50, 2) + CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'gear') THEN 2 ELSE 0 END + 3 - p_size % 3 AS BIGINT) AS score FROM part")
def win8_source_score(spark, sf_dir):
    s = prompts.source_score(F.concat_ws(" ", "p_name", "p_type"), "red gear", F.col("p_type") == "ECONOMY", F.col("p_size") % 3, 3)
    return _t(spark, sf_dir, "part").select("p_partkey", s.cast("long").alias("score"))


# Matching and ranking

_PROMPT = "red widget, which shines; economy brand and bolt = small gear"
_WORDS = ["red", "widget", "economy", "brand", "bolt", "small", "gear"]


def _entries(spark, sf_dir):
    sense = F.struct(F.concat_ws(" ", "p_name", F.lit("is"), "p_type", F.lit("ion of size ="), F.col("p_size").cast("string")).alias("gloss"), F.array("p_brand").alias("synonyms"))
    return _t(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit(".json")).alias("file"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("key"), F.array(sense).alias("senses"))


_MATCHES = f"""kw AS (SELECT unnest([{_list(_WORDS)}]) AS keyword),
e AS (SELECT p_partkey, lower(p_type) AS phylum, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS key, p_name || ' is ' || p_type || ' ion of size = ' || CAST(p_size AS VARCHAR) AS gloss, p_brand AS synonym FROM part),
m AS (SELECT keyword, e.*, 'key' AS field FROM kw, e WHERE contains({_normal('key')}, keyword)
 UNION ALL SELECT keyword, e.*, 'synonym' FROM kw, e WHERE NOT contains({_normal('key')}, keyword) AND contains({_normal('synonym')}, keyword)
 UNION ALL SELECT keyword, e.*, 'gloss' FROM kw, e WHERE NOT contains({_normal('key')}, keyword) AND contains({_normal('gloss')}, keyword))"""
_FAMILY = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(gloss), '{m}')''' for m in marks)} THEN '{name}'" for name, marks in match.FAMILIES) + " ELSE 'general' END"
_TAXA = _MATCHES + rf""",
x AS (SELECT keyword, 'other' AS kingdom, phylum, {_FAMILY} AS family, CASE WHEN regexp_matches(gloss, '{match.EQUATION}') THEN regexp_extract(gloss, '{match.EQUATION}', 1) ELSE gloss END AS "order", {_normal('key')} AS variable, CASE WHEN field = 'key' THEN 'entry' ELSE field END AS type, CASE WHEN field = 'synonym' THEN synonym ELSE gloss END AS value FROM m),
s AS (SELECT *, CAST(CASE WHEN family <> 'general' THEN 3 ELSE 0 END + CASE type WHEN 'gloss' THEN 2 WHEN 'synonym' THEN 1 ELSE 0 END + least(3, length(value) // 50) + CASE WHEN length(variable) > 3 THEN 1 ELSE 0 END AS BIGINT) AS score FROM x)"""


@query(f"WITH {_MATCHES} SELECT keyword, phylum || '.json' AS file, key, field FROM m")
def join1_matches(spark, sf_dir):
    return match.matches(_entries(spark, sf_dir), _WORDS).select("keyword", "file", "key", "field")


@query(f'WITH {_TAXA} SELECT keyword, kingdom, phylum, family, "order", variable, type, value, score FROM s')
def tax1_taxonomy(spark, sf_dir):
    taxa = match.taxonomy(match.matches(_entries(spark, sf_dir), _WORDS))
    return taxa.withColumn("score", match.score())


@query(f"SELECT doc_id, {_FAMILY.replace('gloss', 'coalesce(text, {})').format(*[repr('')] * 40)} AS family, CASE WHEN length(trim(coalesce(text, ''))) > 200 THEN left(trim(coalesce(text, '')), 200) || '...' ELSE trim(coalesce(text, '')) END AS snippet FROM documents")
def prj2_3_family_and_snippet(spark, sf_dir):
    c = F.trim(text.blank(F.col("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", match.family(F.col("text")).alias("family"), F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c).alias("snippet"))


_RANKED = _TAXA + ', r AS (SELECT DISTINCT kingdom, phylum, family, "order", variable, type, value, score FROM s), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, kingdom, phylum, family, "order", variable, type, value) AS rank FROM r)'


def _session(spark, sf_dir):
    taxa = sessions.analyze(spark, spark.createDataFrame([(1, _PROMPT)], "prompt_id int, prompt string"), _entries(spark, sf_dir))
    return sessions.create("s1", taxa.select(*sessions.ITEM).distinct())


@query(f'WITH {_RANKED} SELECT kingdom, phylum, family, "order", variable, type, value, score, rank FROM ranked')
def ses1_session(spark, sf_dir):
    return _session(spark, sf_dir).select(*sessions.ITEM, "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RANKED} SELECT variable, score, rank FROM ranked WHERE rank <= 6")
def top1_best_six(spark, sf_dir):
    return sessions.top(_session(spark, sf_dir), 6).select("variable", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RANKED} SELECT variable, type, score FROM ranked WHERE score >= 6")
def flt4_alerts(spark, sf_dir):
    return sessions.alerts(_session(spark, sf_dir), 6).select("variable", "type", "score")


@query(f"WITH {_RANKED} SELECT variable, type, rank FROM ranked WHERE family = (SELECT family FROM ranked WHERE contains(variable, 'redwidget') ORDER BY rank LIMIT 1) AND variable <> (SELECT variable FROM ranked WHERE contains(variable, 'redwidget') ORDER BY rank LIMIT 1) ORDER BY rank LIMIT 20")
def flt5_below(spark, sf_dir):
    return sessions.below(_session(spark, sf_dir), "redwidget").select("variable", "type", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_RANKED}, a AS (SELECT * FROM ranked WHERE contains(variable, 'bolt') ORDER BY rank LIMIT 1),
t AS (SELECT ranked.*, CASE WHEN ranked.family = a.family THEN 1 WHEN ranked.phylum = a.phylum THEN 2 WHEN contains(ranked.variable, a.variable) THEN 3 END AS tier, a.variable AS own FROM ranked, a)
SELECT variable, type, CAST(row_number() OVER (ORDER BY tier, rank) AS INT) AS step FROM t WHERE tier IS NOT NULL AND variable <> own QUALIFY step <= 5"""
)
def ses3_chain(spark, sf_dir):
    return sessions.chain(_session(spark, sf_dir), "bolt").select("variable", "type", "step")


@query(
    f"""WITH {_RANKED}, d AS (SELECT *, CASE WHEN family <> 'general' THEN 3 ELSE 0 END + least(10, length("order") // 50) + least(10, length(value) // 80) AS depth FROM ranked),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY variable ORDER BY depth DESC, score DESC, rank) = 1),
p AS (SELECT *, row_number() OVER (ORDER BY depth DESC, score DESC, rank) - 1 AS pos FROM o QUALIFY pos < 8),
w AS (SELECT i AS step, CAST(round_even((cos(2 * pi() * i / 4) + 1) / 2 * ((SELECT count(*) FROM p) - 1), 0) AS BIGINT) AS pos FROM range(4) r(i))
SELECT step, variable, variable || ' (' || family || '): ' || CASE WHEN length(value) > 140 THEN left(value, 137) || '...' ELSE value END AS text FROM w JOIN p USING (pos)"""
)
def ses4_conjecture(spark, sf_dir):
    return sessions.conjecture(_session(spark, sf_dir), 4)


@query(f"WITH {_TAXA} SELECT phylum AS file, count(*) AS matches, CAST(sum(score) AS BIGINT) AS score FROM s GROUP BY 1")
def agg3_file_scores(spark, sf_dir):
    taxa = match.taxonomy(match.matches(_entries(spark, sf_dir), _WORDS)).withColumn("score", match.score())
    return taxa.groupBy(F.col("phylum").alias("file")).agg(F.count("*").alias("matches"), F.sum("score").alias("score"))


@query("SELECT i AS step, CAST(round_even((cos(2 * pi() * i / 12) + 1) / 2 * ((SELECT count(*) FROM nation) - 1), 0) AS BIGINT) AS pos FROM range(12) r(i)")
def win6_cosine_walk(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").agg(F.count("*").alias("n"))
    return spark.range(12).join(F.broadcast(n)).select(F.col("id").alias("step"), sessions.cosine_index(F.col("id"), 12, F.col("n")).alias("pos"))


@query("SELECT from_x + (to_x - from_x) * i / 10.0 AS x, (from_x + (to_x - from_x) * i / 10.0) * (from_x + (to_x - from_x) * i / 10.0) AS y FROM (SELECT CAST(min(r_regionkey) AS DOUBLE) AS from_x, CAST(max(r_regionkey) AS DOUBLE) AS to_x FROM region), range(11) r(i)")
def win12_graph_points(spark, sf_dir):
    ends = _t(spark, sf_dir, "region").agg(F.min("r_regionkey").cast("double").alias("a"), F.max("r_regionkey").cast("double").alias("b"))
    return ends.select(F.explode(mathexpr.curve("x * x", "x", F.col("a"), F.col("b"), 11)).alias("p")).select("p.x", "p.y")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'license')")
def flt2_search(spark, sf_dir):
    from lexiqua.sources import notes

    return notes.search(_t(spark, sf_dir, "documents"), "License", ["source", "lang", "text"]).select("doc_id", "source")


@query("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1")
def agg2_tag_counts(spark, sf_dir):
    from lexiqua.sources import notes

    return notes.tag_counts(_t(spark, sf_dir, "events").select(F.array("event_type").alias("tags")))


# Sets and relations


@query(f"WITH p AS (SELECT item_id, {_profile('text')} FROM benchmark), s AS (SELECT a.item_id AS a, b.item_id AS b, {_PERCENT} AS percent, array_to_string(list_sort(list_intersect(a.nouns, b.nouns)), ' ') AS shared FROM p a JOIN p b ON a.item_id < b.item_id) SELECT a, b, round(percent, 6) AS percent, shared FROM s WHERE percent >= 20")
def join3_similar_pairs(spark, sf_dir):
    return relations.similar_pairs(_t(spark, sf_dir, "benchmark"), "item_id", "text").select("a", "b", F.round("percent", 6).alias("percent"), F.array_join("shared", " ").alias("shared"))


@query(f"WITH p AS (SELECT item_id, unnest({_content('text', 'NOT ' + _PREDICATE)}) AS noun FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM p a JOIN p b ON a.noun = b.noun AND a.item_id < b.item_id GROUP BY 1, 2")
def join4_shared_nouns(spark, sf_dir):
    return relations.shared_noun_pairs(_t(spark, sf_dir, "benchmark"), "item_id", "text")


_INCLUDED = "len(list_filter({n}, lambda x: list_contains({b}, x))) / CAST(greatest(len({n}), 1) AS DOUBLE)"


@query(
    f"""WITH t AS (SELECT item_id, {_tokens('text')} AS t FROM benchmark UNION ALL SELECT item_id + 100000 * k, {_tokens('text[1 : length(text) // k]')} FROM benchmark, range(1, 4) r(k)), p AS (SELECT a.item_id AS a, b.item_id AS b, a.t AS ta, b.t AS tb FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) > 0),
m AS (SELECT a, b, len(list_intersect(ta, tb)) / CAST(greatest(least(len(list_distinct(ta)), len(list_distinct(tb))), 1) AS DOUBLE) AS coefficient, {_INCLUDED.format(n='tb', b='ta')} AS ab, {_INCLUDED.format(n='ta', b='tb')} AS ba, {_jaccard('ta', 'tb')} AS j FROM p)
SELECT a, b, CASE WHEN coefficient > 0.85 OR ab >= 0.6 AND ba >= 0.6 THEN 'equal' WHEN ab >= 0.6 THEN 'a_includes_b' WHEN ba >= 0.6 THEN 'b_includes_a' ELSE 'overlap' END AS relation FROM m WHERE coefficient > 0.85 OR ab >= 0.6 OR ba >= 0.6 OR j >= 0.25"""
)
def rel1_relations(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    parts = [b.select((F.col("item_id") + 100_000 * k).alias("item_id"), F.substring("text", F.lit(1), F.floor(F.length("text") / k).cast("int")).alias("text")) for k in (1, 2, 3)]
    return relations.relations(reduce(lambda x, y: x.unionByName(y), parts, b.select("item_id", "text")), "item_id", "text")


@query(f"WITH p AS (SELECT item_id, {_content('text', 'NOT ' + _PREDICATE)} AS nouns FROM benchmark) SELECT a.item_id, array_to_string(list_sort(list_intersect(a.nouns, b.nouns)), ' ') AS shared, CAST(len(list_filter(a.nouns, lambda x: NOT list_contains(b.nouns, x))) AS INT) AS only_here FROM p a JOIN p b ON b.item_id = a.item_id + 1")
def set1_shared_and_unique(spark, sf_dir):
    p = _t(spark, sf_dir, "benchmark").select("item_id", text.nouns(F.col("text")).alias("nouns"))
    return p.join(p.select((F.col("item_id") - 1).alias("item_id"), F.col("nouns").alias("next")), "item_id").select("item_id", F.array_join(F.array_sort(F.array_intersect("nouns", "next")), " ").alias("shared"), F.size(F.array_except("nouns", "next")).alias("only_here"))


@query(f"WITH v AS (SELECT DISTINCT unnest({_tokens('text')}) AS t FROM benchmark), d AS (SELECT doc_id, {_tokens('text')} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS t FROM d), k AS (SELECT doc_id, count(*) AS a, count(v.t) AS h FROM u LEFT JOIN v USING (t) GROUP BY 1) SELECT d.doc_id, CASE WHEN k.a IS NULL THEN CAST(1 AS DOUBLE) ELSE round(h / CAST(a AS DOUBLE), 9) END AS known_part FROM d LEFT JOIN k USING (doc_id)")
def agg10_known_part(spark, sf_dir):
    words = _t(spark, sf_dir, "benchmark").select(F.explode(text.tokenize(F.col("text"))).alias("word"))
    return lookup.known_part(_t(spark, sf_dir, "documents"), "doc_id", "text", words).withColumn("known_part", F.round("known_part", 9))


_TERMS = ["tion", "onth", "que", "ento"]


@query(f"WITH d AS (SELECT list_filter({_words('text')}, lambda x: length(x) > 3 AND x NOT IN ({_STOP})) AS w FROM documents), h AS (SELECT term, w FROM d, (SELECT unnest([{_list(_TERMS)}]) AS term) WHERE list_contains(w, term)), c AS (SELECT term, word, count(*) AS n FROM (SELECT term, unnest(w) AS word FROM h) WHERE word <> term GROUP BY 1, 2) SELECT term, word, n, CAST(row_number() OVER (PARTITION BY term ORDER BY n DESC, word) AS INT) AS rank FROM c QUALIFY rank <= 5")
def agg7_cooccurring(spark, sf_dir):
    return lookup.cooccurring(_t(spark, sf_dir, "documents"), "text", _TERMS)


@query("SELECT term, CAST(sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term)) AS BIGINT) AS n FROM documents, (SELECT unnest(['" + "', '".join(_TERMS) + "']) AS term) GROUP BY ROLLUP (term)")
def agg8_occurrences(spark, sf_dir):
    return lookup.occurrences(_t(spark, sf_dir, "documents"), "text", _TERMS)


# Lookups


@query("WITH k AS (SELECT n_regionkey, n_name, (SELECT list_sort(list(b.n_name)) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_name <> a.n_name) AS s FROM nation a) SELECT n_name, r_name, array_to_string(s[1:10], ',') AS siblings FROM k JOIN region ON r_regionkey = n_regionkey")
def join8_siblings(spark, sf_dir):
    n = lookup.siblings(_t(spark, sf_dir, "nation"), "n_regionkey", "n_name")
    return n.join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.array_join("siblings", ",").alias("siblings"))


@query("WITH s AS (SELECT s_nationkey AS k, CAST(count(*) AS VARCHAR) AS v FROM supplier GROUP BY 1 HAVING count(*) > 1), c AS (SELECT c_nationkey AS k, CAST(count(*) AS VARCHAR) AS v FROM customer GROUP BY 1) SELECT n_nationkey, coalesce(s.v, c.v) AS found, CASE WHEN s.v IS NOT NULL THEN 'supplier' WHEN c.v IS NOT NULL THEN 'customer' END AS source FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey")
def join9_cascade(spark, sf_dir):
    counted = lambda table, key: _t(spark, sf_dir, table).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias("value"))
    return lookup.cascade(_t(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", [("supplier", counted("supplier", "s_nationkey").filter("value > 1")), ("customer", counted("customer", "c_nationkey"))])


@query()
def join10_fuzzy(spark, sf_dir):
    words = spark.createDataFrame([("red widgets",), ("smal rings",), ("blue bolts",), ("hot gears",)], "word string")
    return fuzzy.nearest(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", words, "word")


@query("SELECT l_returnflag AS file, ascii(l_returnflag) AS priority, count(DISTINCT l_partkey) AS terms FROM lineitem GROUP BY 1, 2 ORDER BY terms DESC, priority LIMIT 1")
def agg6_best_file(spark, sf_dir):
    return lookup.best_file(_t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.ascii("l_returnflag").alias("priority"), F.col("l_partkey").alias("term")))


# Intervals

_DAY = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"
_SPANS = f'sp AS (SELECT l_orderkey, CAST(min({_DAY}) AS BIGINT) AS s, CAST(max({_DAY}) AS BIGINT) AS e FROM lineitem GROUP BY 1), q AS (SELECT i AS period, i * 91 AS s, i * 91 + 90 AS e FROM range(28) r(i))'
_OVERLAP = "(least(sp.e, q.e) - greatest(sp.s, q.s) + 1) / CAST(greatest(sp.e, q.e) - least(sp.s, q.s) + 1 AS DOUBLE)"


#: Items of orders in one task: these alone are what its memory grows with.
_ITEM_ROWS = 1_000_000


def _spans(spark, sf_dir):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01")).cast("long")
    items = spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), _ITEM_ROWS, "l_orderkey")
    return items.groupBy("l_orderkey").agg(F.min(day).alias("start"), F.max(day).alias("end"))


def _periods(spark):
    return spark.range(28).select(F.col("id").alias("period"), (F.col("id") * 91).alias("start"), (F.col("id") * 91 + 90).alias("end"))


@query(f"WITH {_SPANS} SELECT l_orderkey, s AS start, e AS \"end\" FROM sp WHERE 1900 BETWEEN s AND e")
def flt3_stabbing(spark, sf_dir):
    return intervals.stabbed(_spans(spark, sf_dir), 1900)


@query(f"WITH {_SPANS}, o AS (SELECT period, l_orderkey, {_OVERLAP} AS overlap, sp.e - sp.s AS span FROM sp JOIN q ON sp.s <= q.e AND q.s <= sp.e) SELECT period, l_orderkey, round(overlap, 9) AS overlap, CAST(row_number() OVER (PARTITION BY period ORDER BY overlap DESC, span, l_orderkey) AS INT) AS rank FROM o QUALIFY rank <= 10")
def join5_interval_overlap(spark, sf_dir):
    met = intervals.overlap_join(_spans(spark, sf_dir), F.broadcast(_periods(spark)), 91)
    scored = met.withColumn("overlap", intervals.overlap_fraction(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")))
    rank = F.row_number().over(Window.partitionBy("b_period").orderBy(F.desc("overlap"), F.col("end") - F.col("start"), "l_orderkey"))
    return scored.withColumn("rank", rank).filter("rank <= 10").select(F.col("b_period").alias("period"), "l_orderkey", F.round("overlap", 9).alias("overlap"), "rank")


@query(f"WITH {_SPANS}, o AS (SELECT l_orderkey, period, {_OVERLAP} AS overlap FROM sp JOIN q ON sp.s <= q.e AND q.s <= sp.e) SELECT l_orderkey, period, round(overlap, 9) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY overlap DESC, period) = 1")
def join6_best_overlap(spark, sf_dir):
    met = intervals.overlap_join(_spans(spark, sf_dir), F.broadcast(_periods(spark)), 91)
    return intervals.best_overlap(met, ["l_orderkey"], ["b_period"]).select("l_orderkey", F.col("b_period").alias("period"), F.round("overlap", 9).alias("overlap"))


@query(r"""SELECT event_id, list_min(y) AS start, list_max(y) AS "end" FROM (SELECT event_id, list_transform(regexp_extract_all(props || '-1918', '-?\d{1,4}'), lambda x: CAST(x AS INT)) AS y FROM events)""")
def rel2_year_range(spark, sf_dir):
    r = intervals.year_range(F.concat(F.col("props"), F.lit("-1918")))
    return _t(spark, sf_dir, "events").select("event_id", r["start"].alias("start"), r["end"].alias("end"))


# Dates

_D = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, CAST({_D} AS VARCHAR) AS parsed, strftime({_D}, '%Y-%m-%d') AS formatted, dayname({_D}) AS weekday FROM orders")
def dt1_2_5_parse_and_name(spark, sf_dir):
    d = F.to_date("o_orderdate")
    written = F.element_at(F.array(*(F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    parsed = dates.parse_date(written)
    return _t(spark, sf_dir, "orders").select("o_orderkey", parsed.cast("string").alias("parsed"), dates.format_date(parsed).alias("formatted"), dates.weekday_name(parsed).alias("weekday"))


_N = "CAST(o_orderkey % 61 - 30 AS INT)"


@query(
    f"""SELECT o_orderkey, CAST({_D} + {_N} AS VARCHAR) AS plus_days, CAST(date_diff('day', DATE '1996-02-29', {_D}) AS INT) AS diff, CAST(CAST({_D} + to_months({_N}) AS DATE) AS VARCHAR) AS plus_months,
CAST(CASE WHEN {_N} = 0 THEN {_D} ELSE list_filter(list_transform(range(1, 2 * abs({_N}) + 4), lambda i: {_D} + CAST(i * sign({_N}) AS INT)), lambda x: isodow(x) < 6)[abs({_N})] END AS VARCHAR) AS plus_business_days FROM orders"""
)
def dt3_4_6_7_arithmetic(spark, sf_dir):
    d, n = F.to_date("o_orderdate"), (F.col("o_orderkey") % 61 - 30).cast("int")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.date_add(d, n).cast("string").alias("plus_days"), F.datediff(d, F.lit("1996-02-29")).alias("diff"), dates.add_months(d, n).cast("string").alias("plus_months"), dates.add_business_days(d, n).cast("string").alias("plus_business_days"))


@query(
    f"""WITH h AS (SELECT o_orderkey, greatest({_D}, DATE '1996-02-29') AS a, least({_D}, DATE '1996-02-29') AS b, {_D} < DATE '1996-02-29' AS neg FROM orders),
p AS (SELECT *, day(a) < day(b) AS borrow, month(a) - month(b) - CASE WHEN day(a) < day(b) THEN 1 ELSE 0 END AS m FROM h)
SELECT o_orderkey, CAST(CASE WHEN neg THEN -1 ELSE 1 END * (year(a) - year(b) - CASE WHEN m < 0 THEN 1 ELSE 0 END) AS INT) AS years, CAST(CASE WHEN m < 0 THEN m + 12 ELSE m END AS INT) AS months, CAST(day(a) - day(b) + CASE WHEN borrow THEN day(date_trunc('month', a) - INTERVAL 1 DAY) ELSE 0 END AS INT) AS days FROM p"""
)
def dt8_diff_parts(spark, sf_dir):
    p = dates.diff_parts(F.to_date("o_orderdate"), F.lit("1996-02-29").cast("date"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", p["years"].alias("years"), p["months"].alias("months"), p["days"].alias("days"))


# Mathematics

_EXPRESSION = "-(price * (1 - discount)^2) % 7 + quantity // 3 + sqrt(tax)"


@query("SELECT l_orderkey, l_linenumber, round(-(l_extendedprice * pow(1 - l_discount, 2)) - 7 * floor(-(l_extendedprice * pow(1 - l_discount, 2)) / 7) + floor(l_quantity / 3) + sqrt(l_tax), 6) AS value FROM lineitem")
def mth1_expression(spark, sf_dir):
    value = mathexpr.compile_expression(_EXPRESSION, {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "quantity": F.col("l_quantity"), "tax": F.col("l_tax")})
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"))


@query("SELECT p_partkey, round(p_size * CAST(1609.344 AS DOUBLE) / 1000, 9) AS km, round((p_size * (CAST(5 AS DOUBLE) / 9) + CAST(459.67 AS DOUBLE) * 5 / 9 - CAST(273.15 AS DOUBLE)), 6) AS celsius FROM part")
def mth3_units(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(mathexpr.convert(size, "mile", "km"), 9).alias("km"), F.round(mathexpr.convert(size, "degF", "degC"), 6).alias("celsius"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, round(l_quantity * CAST(0.45359237 AS DOUBLE), 6) AS kilos FROM lineitem")
def mth4_steps(spark, sf_dir):
    steps = [{"expression": "price * (1 - discount)", "assign": "net"}, {"expression": "net * (1 + tax)", "assign": "gross"}, {"expression": "quantity", "assign": "kilos", "from_unit": "lb", "to_unit": "kg"}]
    known = mathexpr.solve_steps({"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "quantity": F.col("l_quantity")}, steps)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(known[k], 6).alias(k) for k in ("net", "gross", "kilos")))


@query("SELECT p_partkey, CAST(p_size * (p_size + 1) AS DOUBLE) / 2 AS s FROM part")
def mth8_triangular(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", mathexpr.triangular(F.col("p_size")).alias("s"))


@query(
    """WITH m AS (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2), mo AS (SELECT l_returnflag, l_quantity AS mode FROM m QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY c DESC, l_quantity) = 1),
a AS (SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, max(l_quantity) - min(l_quantity) AS range, (max(l_quantity) + min(l_quantity)) / 2 AS midrange, round(var_pop(l_quantity), 6) AS var_population, round(var_samp(l_quantity), 6) AS var_sample, round(stddev_pop(l_quantity), 6) AS sd_population, round(stddev_samp(l_quantity), 6) AS sd_sample,
 round(covar_pop(l_quantity, l_discount), 6) AS covariance, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(sum(l_quantity * l_discount), 3) AS expected FROM lineitem GROUP BY 1) SELECT a.*, mode FROM a JOIN mo USING (l_returnflag)"""
)
def agg17_statistics(spark, sf_dir):
    def of(name: str, domain: str = "statistics", **args: str) -> Column:
        return F.expr(re.sub(r"\b(" + "|".join(args) + r")\b(?!\()", lambda m: args[m[1]], formulas.formula(domain, name, True).body))

    v, xy = {"value": "l_quantity"}, {"x": "l_quantity", "y": "l_discount"}
    line = {"x": "l_quantity", "y": "l_extendedprice"}
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(of("mean", **v), 6).alias("mean"), of("median", **v).alias("median"), of("mode", **v).alias("mode"), of("range", **v).alias("range"), of("midrange", **v).alias("midrange"),
        F.round(of("variance_population", **v), 6).alias("var_population"), F.round(of("variance_sample", **v), 6).alias("var_sample"), F.round(of("standard_deviation_population", **v), 6).alias("sd_population"), F.round(of("standard_deviation_sample", **v), 6).alias("sd_sample"),
        F.round(of("covariance", **xy), 6).alias("covariance"), F.round(of("correlation", **line), 6).alias("correlation"), F.round(of("linear_regression_slope", **line), 4).alias("slope"), F.round(of("linear_regression_intercept", **line), 4).alias("intercept"),
        F.round(of("expected_return", "finance", p="l_quantity", r="l_discount"), 3).alias("expected"),
    )


#: SQL text for the arguments of a formula, by their place.
_ARGS = ["(l_quantity)", "(l_discount + 0.01D)", "(l_tax + 0.02D)", "(l_extendedprice / 1000D)", "(cast(l_linenumber AS double))", "(l_quantity / 7D)"]


def plain(f: formulas.Formula) -> bool:
    """A formula of numbers over one row whose SQL both engines have."""
    return f.solved and not f.over_rows and not f.takes_functions and not re.search(r"->|\[|\.re\b|\.im\b|\bcomb\(|erf\(|factorial\(|named_struct|^array\(array|sequence|\bCASE\b|coords", f.body)


def _forms(domain: str) -> list[tuple[str, str]]:
    """Formulas of a domain as (name, Spark SQL of one number); of an array its first element."""
    out = []
    for name, forms in formulas.catalogue(domain).items():
        for f in filter(plain, forms):
            sql = f.sql({a: _ARGS[i % len(_ARGS)] for i, a in enumerate(f.args)})
            truth = re.search(r"[<>]| = ", f.body) is not None
            out.append((name, f"element_at({sql}, 1)" if f.body.startswith("array(") else f"cast({sql} AS int)" if truth else sql))
    return out


def _duck(sql: str) -> str:
    """DuckDB's text of an expression."""
    while m := re.search(r"try_divide\(|element_at\(|(?<![\w.])array\(", sql):
        depth, i, cut_at, name = 1, m.end(), [], m[0][:-1]
        start = i
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                cut_at.append(i)
            i += 1
        parts = [sql[a:b] for a, b in zip([start, *(x + 1 for x in cut_at)], [*cut_at, i - 1])]
        new = f"(CAST({parts[0]} AS DOUBLE) / nullif({parts[1]}, 0))" if name == "try_divide" else f"({parts[0]})[1]" if name == "element_at" else "[" + ", ".join(parts) + "]"
        sql = sql[: m.start()] + new + sql[i:]
    sql = re.sub(r"(\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", sql)
    return re.sub(r"\be\(\)", "exp(CAST(1 AS DOUBLE))", sql)


def _number(x: str) -> str:
    """A formula's value as the nearest single-precision number, as engines differ in the last bits; what is none, or beyond them, is null."""
    x = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({x}) < CAST('1e30' AS DOUBLE) THEN CAST(CAST({x} AS FLOAT) AS DOUBLE) + CAST(0 AS DOUBLE) END"


def _formula_query(domain: str) -> None:
    names = [f"{name}_{i}" if i else name for i, name in _numbered(domain)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = {n: F.expr(_number(sql)) for n, (_, sql) in zip(names, _forms(domain), strict=True)}
        return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *formulas.in_parts(columns))

    columns = ", ".join(f'{_number(_duck(sql))} AS "{n}"' for n, (_, sql) in zip(names, _forms(domain), strict=True))
    QUERIES[f"fml_{domain}"] = run
    ORACLES[f"fml_{domain}"] = f"SELECT l_orderkey, l_linenumber, {columns} FROM lineitem"


def _numbered(domain: str) -> list[tuple[int, str]]:
    """Each form's name, and which of the forms of that name it is."""
    names = [name for name, _ in _forms(domain)]
    return [(names[:i].count(name), name) for i, name in enumerate(names)]


for _domain in formulas.DOMAINS:
    if _forms(_domain):
        _formula_query(_domain)


@query()
def fml_normal_cdf(spark, sf_dir):
    """The formula with erf, which neither engine has."""
    formulas.register(spark)
    f = formulas.formula("statistics", "normal_cdf_approx")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f.column(x="l_quantity", mean="25D", sd="10D").alias("normal_cdf"))


_K = "CAST(l_linenumber AS INT)"


@query(f"SELECT l_orderkey, l_linenumber, round(factorial({_K} + 3) / (factorial({_K}) * 6.0), 6) AS combination, CAST(factorial({_K} + 3) / 6 AS DOUBLE) AS permutation, round(factorial({_K} + 3) / (factorial({_K}) * 6.0) * pow(l_discount + 0.1, {_K}) * pow(1 - (l_discount + 0.1), 3), 9) AS binomial_probability, round(pow(l_tax + 1, {_K}) * exp(-(l_tax + 1)) / factorial({_K}), 9) AS poisson_probability FROM lineitem")
def fml_special(spark, sf_dir):
    """Formulas with combinations and factorials."""
    x = {"n": "cast(l_linenumber + 3 AS int)", "k": "cast(l_linenumber AS int)", "r": "cast(l_linenumber AS int)", "p": "(l_discount + 0.1D)", "lam": "(l_tax + 1D)"}
    of = lambda d, n: formulas.formula(d, n).column(**{a: x[a] for a in formulas.formula(d, n).args}).cast("double")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(of("statistics", "combination"), 6).alias("combination"), of("statistics", "permutation").alias("permutation"), F.round(of("probability", "binomial_probability"), 9).alias("binomial_probability"), F.round(of("probability", "poisson_probability"), 9).alias("poisson_probability")
    )


_RE1, _IM1, _RE2, _IM2 = "l_quantity", "(l_discount - 0.05)", "(l_tax + 1)", "l_linenumber"
_COMPLEX = {
    "complex_conjugate": (_RE1, f"-({_IM1})"), "addition": (f"{_RE1} + {_RE2}", f"{_IM1} + {_IM2}"), "subtraction": (f"{_RE1} - {_RE2}", f"{_IM1} - {_IM2}"), "multiplication": (f"{_RE1} * {_RE2} - {_IM1} * {_IM2}", f"{_RE1} * {_IM2} + {_IM1} * {_RE2}"),
    "division": (f"({_RE1} * {_RE2} + {_IM1} * {_IM2}) / ({_RE2} * {_RE2} + {_IM2} * {_IM2})", f"({_IM1} * {_RE2} - {_RE1} * {_IM2}) / ({_RE2} * {_RE2} + {_IM2} * {_IM2})"), "polar_form": (f"{_RE1} * cos({_RE2})", f"{_RE1} * sin({_RE2})"), "euler_formula": (f"cos({_RE2})", f"sin({_RE2})"),
    "power_polar": (f"pow({_RE2}, 3) * cos(3 * {_RE2})", f"pow({_RE2}, 3) * sin(3 * {_RE2})"), "root_polar": (f"pow({_RE2}, 1 / CAST(3 AS DOUBLE)) * cos(({_RE2} + 2 * pi()) / 3)", f"pow({_RE2}, 1 / CAST(3 AS DOUBLE)) * sin(({_RE2} + 2 * pi()) / 3)"),
}


@query(f"SELECT l_orderkey, l_linenumber, {_RE1} AS real_part, round({_IM1}, 9) AS imaginary_part, round(sqrt({_RE1} * {_RE1} + {_IM1} * {_IM1}), 6) AS magnitude, round(atan2({_IM1}, {_RE1}), 6) AS argument, " + ", ".join(f"round({re_}, 6) + CAST(0 AS DOUBLE) AS {n}_re, round({im}, 6) + CAST(0 AS DOUBLE) AS {n}_im" for n, (re_, im) in _COMPLEX.items()) + " FROM lineitem")
def fml_complex_numbers(spark, sf_dir):
    number = lambda a, b: formulas.formula("complex_numbers", "complex_number").sql({"a": a, "b": b})
    x = {"z": number("l_quantity", "l_discount - 0.05D"), "z1": number("l_quantity", "l_discount - 0.05D"), "z2": number("l_tax + 1D", "cast(l_linenumber AS double)"), "r": "(l_tax + 1D)", "theta": "(l_tax + 1D)", "n": "3D", "k": "1D"}
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", *(F.expr(v).alias(k) for k, v in x.items()))
    args = {k: k for k in x}
    of = lambda n, **more: formulas.formula("complex_numbers", n).column(**{a: (args | more)[a] for a in formulas.formula("complex_numbers", n).args})
    pairs = {n: of(n, **({"r": "l_quantity"} if n == "polar_form" else {})) for n in _COMPLEX}
    return d.select(
        "l_orderkey", "l_linenumber", of("real_part").alias("real_part"), F.round(of("imaginary_part"), 9).alias("imaginary_part"), F.round(of("magnitude"), 6).alias("magnitude"), F.round(of("argument"), 6).alias("argument"),
        *((F.round(c[part], 6) + F.lit(0.0)).alias(f"{n}_{part}") for n, c in pairs.items() for part in ("re", "im")),
    )


@query("SELECT l_orderkey, l_linenumber, round((pow(l_discount + 1 + CAST(0.5 AS DOUBLE), 2) - pow(l_discount + 1, 2)) / CAST(0.5 AS DOUBLE), 9) AS quotient, round(((pow(l_discount + 1 + CAST(0.5 AS DOUBLE), 2) - pow(l_discount + 1, 2)) / CAST(0.5 AS DOUBLE)) * (3 * (l_discount + 1)) + pow(l_discount + 1, 2) * ((3 * (l_discount + 1 + CAST(0.5 AS DOUBLE)) - 3 * (l_discount + 1)) / CAST(0.5 AS DOUBLE)), 6) AS product_rule FROM lineitem")
def fml_calculus_functions(spark, sf_dir):
    x, h = "(l_discount + 1)", "0.5D"
    build = {"f": lambda a: f"power({a}, 2)", "g": lambda a: f"3 * ({a})"}
    quotient = formulas.formula("calculus", "difference_quotient").column({"f": build["f"]}, x=x, h=h)
    product = formulas.formula("calculus", "derivative_product_rule").column(build, x=x, h=h)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(quotient, 9).alias("quotient"), F.round(product, 6).alias("product_rule"))


_V, _R = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))", "list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"SELECT vec_id, round(sqrt(list_dot_product({_V}, {_V})), 6) AS magnitude, round(list_dot_product({_V}, {_R}), 6) AS dot, round(list_dot_product({_V}, {_R}) / nullif(list_dot_product({_V}, {_V}), 0), 6) AS cosine, round(({_V})[1] / sqrt(list_dot_product({_V}, {_V})), 6) AS first_of_unit FROM embeddings")
def vec_formulas(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("w", F.reverse("v"))
    of = lambda d, n, **a: formulas.formula(d, n).column(**a)
    return e.select(
        "vec_id", F.round(of("linear_algebra", "vector_magnitude", v="v"), 6).alias("magnitude"), F.round(of("linear_algebra", "dot_product", v="v", w="w"), 6).alias("dot"),
        F.round(of("vectors", "angle_between_vectors", v="v", w="w"), 6).alias("cosine"), F.round(F.element_at(of("linear_algebra", "unit_vector", v="v"), 1), 6).alias("first_of_unit"),
    )


@query(f"WITH m AS (SELECT vec_id, [{_V}[1:2], {_V}[3:4]] AS a FROM embeddings) SELECT vec_id, round(a[1][1] * a[1][1] + a[1][2] * a[2][1], 9) AS p11, round(a[2][1] * a[1][2] + a[2][2] * a[2][2], 9) AS p22, round(a[2][1], 9) AS t12, round(a[1][1] * a[2][2] - a[1][2] * a[2][1], 9) AS det FROM m")
def mat_formulas(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", F.array(F.slice("v", 1, 2), F.slice("v", 3, 2)).alias("a"))
    of = lambda n, **a: formulas.formula("linear_algebra", n).column(**a)
    v = v.withColumn("p", of("matrix_multiplication", A="a", B="a")).withColumn("t", of("matrix_transpose", A="a"))
    det = of("determinant_2x2", a="a[0][0]", b="a[0][1]", c="a[1][0]", d="a[1][1]")
    return v.select("vec_id", F.round(F.col("p")[0][0], 9).alias("p11"), F.round(F.col("p")[1][1], 9).alias("p22"), F.round(F.col("t")[0][1], 9).alias("t12"), F.round(det, 9).alias("det"))


# Conversations


@query("SELECT conv_id, turn, lag(text) OVER w AS previous, CAST(len(list_filter(coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []), lambda x: x = role)) AS BIGINT) AS recent_same FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win11_previous(spark, sf_dir):
    return conversation.with_previous(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "previous", "recent_same")


@query(f"WITH p AS (SELECT conv_id, turn, 'It and THIS said that' AS said, list_filter({_words('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')}, lambda x: x NOT IN ({_STOP}) AND length(x) > 2)[1] AS subject FROM conversations) SELECT conv_id, turn, CASE WHEN subject IS NULL THEN said ELSE array_to_string(list_transform(string_split(said, ' '), lambda x: CASE WHEN lower(x) IN ({_list(conversation.PRONOUNS)}) THEN subject ELSE x END), ' ') END AS resolved FROM p")
def str26_pronouns(spark, sf_dir):
    turns = conversation.with_previous(_t(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", conversation.resolve(F.lit("It and THIS said that"), F.col("previous")).alias("resolved"))
