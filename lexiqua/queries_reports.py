"""Queries over text functions, relations, reports, responses and mathematics beyond those of ``queries``, with SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiqua.functions import formulas, fragments, mathexpr, prompts, text
from lexiqua.operators import lookup, match, relations, reports
from lexiqua.plans import responses, sessions
from lexiqua.queries import _FAMILY, _MATCHES, _PERCENT, _RANKED, _SPANS, _OVERLAP, _content, _entries, _jaccard, _list, _normal, _profile, _session, _spans, _t, _tokens, _words, query, _INCLUDED, _PREDICATE

# Text


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ': it' ELSE p_name || ' ' || upper(p_name) || 'x' END AS cut FROM part")
def str10_leading_term(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), F.col("p_name"), F.lit(": it"))).otherwise(F.concat("p_name", F.lit(" "), F.upper("p_name"), F.lit("x")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.without_leading_term(said, F.col("p_name")).alias("cut"))


@query(
    r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\n.]'), lambda x: trim(x)), lambda x: contains(lower(x), 'tion'))[1] AS c FROM documents)
SELECT doc_id, CASE WHEN length(c) > 240 THEN left(c, 237) || '...' ELSE c END AS chunk FROM c"""
)
def str11_first_chunk(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.first_chunk_containing(F.col("text"), "TION").alias("chunk"))


_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '[' || chr(1) || chr(10) || ']'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    rf"""WITH s AS (SELECT conv_id, turn, list_filter({_SENTENCES}, lambda x: contains(lower(x), 'tion'))[1] AS s FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN length(s) > 400 THEN left(s, 397) || '...' ELSE s END AS s FROM s),
e AS (SELECT conv_id, turn, CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS s FROM t)
SELECT conv_id, turn, CASE WHEN s IS NULL THEN '' ELSE regexp_extract(s, '^[^a-zA-Z]*') || upper(substring(s, length(regexp_extract(s, '^[^a-zA-Z]*')) + 1, 1)) || substring(s, length(regexp_extract(s, '^[^a-zA-Z]*')) + 2) END AS told FROM e"""
)
def str13_sentence_with_term(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.sentences_with(F.col("text"), "tion"), " ").alias("told"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name || ' ' || p_type END AS value FROM part")
def str14_value_text(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.value_text(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.array("p_name", "p_type")).alias("value"))


@query(r"SELECT event_id, regexp_replace(props, '[!-/:-@\[-`{-~]+$', '') AS bare FROM events")
def str18_strip_punct(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.strip_punct(F.col("props")).alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '. ' || 'as ' || p_type ELSE p_name END AS core, p_type || '|of size ' || p_size AS details FROM part")
def str21_split_gloss(spark, sf_dir):
    said = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("; as "), F.col("p_type"))).otherwise(""), F.lit("; "), F.col("p_type"), F.lit(". of size "), F.col("p_size").cast("string"), F.lit("."))
    s = fragments.split_gloss(said)
    return _t(spark, sf_dir, "part").select("p_partkey", s["core"].alias("core"), F.array_join(s["details"], "|").alias("details"))


@query("SELECT p_partkey, upper(left(p_name, 1)) || substring(p_name, 2) || ' is ' || CASE WHEN p_type = 'ECONOMY' THEN 'an ' ELSE 'a ' END || p_type || ' part.' || CASE WHEN p_size % 2 = 0 THEN ' Its formula is ' || p_size || 'x.' ELSE '' END AS told FROM part")
def str22_definition_style(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.definition_sentence(F.col("p_name"), F.concat("p_type", F.lit(" part. ")), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("x")))).alias("told"))


@query("SELECT p_partkey, CAST(2 AS INT) AS pos, p_name AS phrase, split_part(p_name, ' ', 2) AS head, split_part(p_name, ' ', 1) AS modifiers FROM part UNION ALL SELECT p_partkey, 5, 'gear', 'gear', '' FROM part")
def str25_phrases(spark, sf_dir):
    said = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("See the "), F.upper("p_name"), F.lit(", a gear "), F.col("p_name")).alias("t"))
    terms = _t(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct().unionAll(spark.createDataFrame([("gear",)], "term string"))
    return reports.phrases(said, "p_partkey", "t", terms).withColumn("modifiers", F.array_join("modifiers", " "))


_RAW = [r"{n}x^2 + \frac{a}{b}", "E = mc{n}", "n(n+{n})/2", "({n}+b", "a = b = {n} c", "19{n}/05", "x² × {n} in meters", "sin(x) − {n}y", "3 : {n}"]
_CLEAN = ["{n}*x**2+((a)/(b))", "E=m*c**{n}", "n*(n+{n})/2", "({n}+b)", "{n}*c", "", "x**2*{n}", "sin(x)-{n}*y", "3/{n}"]


def _forms(forms: list[str], kind: str) -> str:
    n = f"CAST(p_partkey % 90 + 10 AS {kind})"
    return "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '" + f.replace("\\", "\\\\" if kind == "STRING" else "\\").replace("{n}", f"' || {n} || '") + "'" for i, f in enumerate(forms)) + " END"


@query(f"SELECT p_partkey, {_forms(_CLEAN, 'VARCHAR')} AS clean FROM part")
def str29_fragments(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fragments.normalize_fragment(F.expr(_forms(_RAW, "STRING"))).alias("clean"))


@query("SELECT p_partkey, CAST([4, 4, 3, 3, 3, 3, 2, 2, 0][p_partkey % 9 + 1] AS INT) AS level FROM part")
def str33_precedence(spark, sf_dir):
    ops = F.array(*map(F.lit, ("**", "^", "*", "/", "//", "%", "+", "-", "!")))
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.precedence(F.element_at(ops, (F.col("p_partkey") % 9 + 1).cast("int"))).alias("level"))


@query("SELECT p_partkey, p_size || ' + ab*' || p_partkey || ' - $1' AS said FROM part")
def str37_substitute(spark, sf_dir):
    values = {"a": F.col("p_size"), "a.b": F.col("p_partkey"), "x": F.lit("$1")}
    return _t(spark, sf_dir, "part").select("p_partkey", fragments.substitute(F.lit("a + ab*a.b - x"), list(values), values).alias("said"))


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)(?:^|[^0-9A-Za-z_])(?:the|la|der)(?:$|[^0-9A-Za-z_])') AS related FROM documents")
def str39_related(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.related_to(F.col("text"), ["THE", "la", "der"]).alias("related"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || 's', split_part(p_name, ' ', 2), 'glass', 'gla', 'glasses', 'glasse'] || CASE WHEN split_part(p_name, ' ', 2) = 'plate' THEN ['plat'] ELSE [] END)), ' ') AS variants FROM part")
def set3_plural_variants(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.plural_variants(F.concat("p_name", F.lit("s glass glasses"))), " ").alias("variants"))


@query(f"WITH t AS (SELECT conv_id, turn, list_distinct({_tokens('text')}) AS w FROM conversations) SELECT conv_id, turn, array_to_string((list_transform(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}})), lambda x: x.w))[1:4], ',') AS longest FROM t")
def top7_longest_words(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.longest(F.array_distinct(text.tokenize(F.col("text")))), ",").alias("longest"))


@query("SELECT p_partkey, length(p_name) >= 4 AND p_partkey % 3 = 0 AS good FROM part")
def flt7_good_definitions(spark, sf_dir):
    d = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("made of "), F.col("p_type"))).when(F.col("p_partkey") % 3 == 1, F.substring("p_name", 1, 5)).otherwise(F.concat(F.upper("p_name"), F.lit(" is it")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.is_good_definition(d, F.col("p_name")).alias("good"))


_ASKS = ["compare {a} and {b}", "are {a} and {b} alike?", "which is bigger: {a} or {b}?", "what is {a}?", "do {a}, {b} differ?", "{a} vs {b}", "are you {b}?"]


def _asked(forms: list[str]):
    said = F.array(*(F.lit(f) for f in forms))
    filled = F.replace(F.element_at(said, (F.col("p_partkey") % len(forms) + 1).cast("int")), F.lit("{a}"), F.col("p_name"))
    return F.replace(filled, F.lit("{b}"), F.lower("p_type"))


@query("SELECT p_partkey, [true, true, true, false, true, true, false][p_partkey % 7 + 1] AS compares FROM part")
def flt8_comparison_queries(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.is_comparison(_asked(_ASKS)).alias("compares"))


_EQUALS = ["is {a} the same as {b}?", "Are {a} and {b} equivalent?", "does {a} include {b}", "Is {a} a type of {b}?", "which is larger: {a} or {b}?", "compare {a} to {b}", "is {a} here?", "are {a} related to {b}?", "what's the difference between {a} and {b}?"]


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 <> 6 THEN p_name END AS a, CASE WHEN p_partkey % 9 <> 6 THEN lower(p_type) END AS b FROM part")
def rel8_compared_terms(spark, sf_dir):
    c = prompts.compared_terms(_asked(_EQUALS))
    return _t(spark, sf_dir, "part").select("p_partkey", c["a"].alias("a"), c["b"].alias("b"))


_VERBS = "|".join(text.VERBS)


@query(rf"SELECT p_partkey, 'is,runs,be' AS verbs, p_name AS subjects FROM part")
def tax4_verbs_and_subjects(spark, sf_dir):
    said = F.concat("p_name", F.lit(" is old, runs: 9 be"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.verbs(said), ",").alias("verbs"), F.array_join(text.subjects(said), ",").alias("subjects"))


@query("SELECT p_partkey, 'red big ' || p_name || ' here|far away' AS kept FROM part")
def win10_novelty_cover(spark, sf_dir):
    said = F.array(F.concat(F.lit("big "), F.col("p_name")), F.lit("far away"), F.concat(F.lit("red big "), F.col("p_name"), F.lit(" here")), F.lit("the away"), F.lit("far"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(responses.novelty_cover(said), "|").alias("kept"))


@query("SELECT p_partkey, p_name || ' ' || p_type AS gloss FROM part")
def prj6_chosen_sense(spark, sf_dir):
    e = _t(spark, sf_dir, "part").select("p_partkey", F.array(F.struct(F.concat_ws(" ", "p_name", "p_type").alias("gloss")), F.struct(F.lit("other").alias("gloss"))).alias("senses"))
    return e.select("p_partkey", match.choose_sense(F.col("senses"))["gloss"].alias("gloss"))


# Matches and lookups


@query(f"WITH {_MATCHES} SELECT keyword, phylum || '.json' AS file, key, field FROM m QUALIFY row_number() OVER (PARTITION BY phylum, key ORDER BY field DESC, keyword) = 1")
def join2_last_matches(spark, sf_dir):
    from lexiqua.queries import _WORDS

    return match.last_matches(match.matches(_entries(spark, sf_dir), _WORDS)).select("keyword", "file", "key", "field")


_SIDES = f"t AS (SELECT item_id, item_id // 4 AS g, item_id % 2 AS s, {_tokens('text')} AS t FROM benchmark)"


@query(
    f"""WITH {_SIDES}, p AS (SELECT a.g, a.t AS ta, b.t AS tb FROM t a JOIN t b ON a.g = b.g AND a.s = 0 AND b.s = 1),
m AS (SELECT g, max(len(list_intersect(ta, tb)) / CAST(greatest(least(len(list_distinct(ta)), len(list_distinct(tb))), 1) AS DOUBLE)) AS o, max({_INCLUDED.format(n='tb', b='ta')}) AS ab, max({_INCLUDED.format(n='ta', b='tb')}) AS ba, max({_jaccard('ta', 'tb')}) AS j FROM p GROUP BY g)
SELECT g, round(o, 9) AS overlap, round(ab, 9) AS a_covers, round(ba, 9) AS b_covers, round(j, 9) AS jaccard, CASE WHEN o > 0.85 OR ab >= 0.6 AND ba >= 0.6 THEN 'equal' WHEN ab >= 0.6 THEN 'a_includes_b' WHEN ba >= 0.6 THEN 'b_includes_a' WHEN j >= 0.25 THEN 'overlap' ELSE 'distinct' END AS relation FROM m"""
)
def join7_best_of_entries(spark, sf_dir):
    """JOIN-7 and the tiers of REL-1 on terms with several entries each."""
    e = _t(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("g"), (F.col("item_id") % 2).alias("s"), text.tokenize(F.col("text")).alias("t"))
    best = relations.tiered_relation(relations.best_of_entries(e.filter("s = 0"), e.filter("s = 1"), "g", "t"))
    return best.select("g", *(F.round(c, 9).alias(c) for c in ("overlap", "a_covers", "b_covers", "jaccard")), "relation")


_EDGES = "th AS (SELECT DISTINCT 'w' || n_nationkey % 7 AS word, lower(n_name) AS subject FROM nation UNION SELECT 'w0', lower(r_name) FROM region)"


@query(
    f"""WITH {_EDGES}, p AS (SELECT r_name AS a, n_name AS b, CASE n_nationkey % 3 WHEN 0 THEN ['averyveryverylongword', 'w0'] WHEN 1 THEN ['averyveryverylongword'] ELSE ['short', 'w0'] END AS shared FROM nation JOIN region ON r_regionkey = n_regionkey),
q AS (SELECT *, (SELECT list_sort(list(x.word)) FROM th x JOIN th y ON x.word = y.word AND x.subject = lower(a) AND y.subject = lower(b)) AS words FROM p)
SELECT a, b, coalesce(list_filter(shared, lambda t: list_contains(coalesce(words, []), t))[1], list_filter(shared, lambda t: length(t) <= 12)[1], words[1]) AS bridge FROM q"""
)
def join11_bridges(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    edges = n.select(F.concat(F.lit("w"), (F.col("n_nationkey") % 7).cast("string")).alias("word"), F.col("n_name").alias("subject")).unionAll(r.select(F.lit("w0"), "r_name"))
    shared = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("averyveryverylongword"), F.lit("w0"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("averyveryverylongword"))).otherwise(F.array(F.lit("short"), F.lit("w0")))
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"), shared.alias("shared"))
    return lookup.bridges(pairs, edges).select("a", "b", "bridge")


@query("SELECT CAST(n_nationkey AS INT) AS ord, n_name AS term, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE contains(n_name, '_1')) THEN 'x,_1' ELSE 'x' END AS related FROM nation")
def join12_tracked_word(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("term"), F.lower("n_name").alias("description"), F.array(F.lit("x")).alias("related_terms"), F.col("n_name").alias("example"))
    known = lookup.track_word(rows, "x")  # it is related already, so nothing changes
    return lookup.track_word(known, "_1").select("ord", "term", F.array_join("related_terms", ",").alias("related"))


@query("SELECT r_name, n_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name DESC) AS INT) AS rank FROM nation JOIN region ON r_regionkey = n_regionkey QUALIFY rank <= 4")
def top6_first_of_each(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return lookup.first_of(n, ["r_name"], [F.desc("n_name")], 4)


@query("SELECT 'part' AS file, p_name AS fragment, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'nation', n_name, count(*) FROM nation GROUP BY ALL UNION ALL SELECT 'region', r_name, count(*) FROM region GROUP BY ALL")
def set4_candidates_of_files(spark, sf_dir):
    """SET-4: fragments of several files, all of them."""
    one = lambda t, c: _t(spark, sf_dir, t).select(F.lit(t).alias("file"), F.col(c).alias("fragment"))
    return one("part", "p_name").unionByName(one("nation", "n_name")).unionByName(one("region", "r_name")).groupBy("file", "fragment").agg(F.count("*").alias("n"))


@query("SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1")
def set5_seen_names(spark, sf_dir):
    """SET-5: each name once, at its first place."""
    first = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return _t(spark, sf_dir, "part").withColumn("_n", first).filter("_n = 1").select("p_name", F.col("p_partkey").alias("first"))


# Reports


@query(f"WITH {_SPANS}, o AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, sp.s, sp.e, {_OVERLAP} AS overlap FROM sp, (SELECT 1900 AS s, 1960 AS e) q WHERE sp.s <= q.e AND q.s <= sp.e), r AS (SELECT *, CAST(row_number() OVER (ORDER BY overlap DESC, e - s, k) AS INT) AS rank FROM o QUALIFY rank <= 10) SELECT rank, k || ': ' || s || ' to ' || e || ' (' || printf('%.1f', overlap * 100) || '%)' AS line FROM r")
def rel3_period_coverage(spark, sf_dir):
    """REL-3 and TOP-4."""
    return reports.period_coverage(_spans(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("key"), "start", "end"), 1900, 1960)


_LISTED = "CASE len(x) WHEN 0 THEN 'nothing' WHEN 1 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], ', ') || ' and ' || x[len(x)] END"


def _said(words: str) -> str:
    return f"(SELECT {_LISTED} FROM (SELECT ({words})[1:6] AS x))"


@query(
    f"""WITH p AS (SELECT item_id, {_profile('text')} FROM benchmark), s AS (SELECT a.item_id AS a, b.item_id AS b, {_PERCENT} AS percent, list_sort(list_intersect(a.nouns, b.nouns)) AS shared, list_sort(list_filter(a.nouns, lambda x: NOT list_contains(b.nouns, x))) AS oa, list_sort(list_filter(b.nouns, lambda x: NOT list_contains(a.nouns, x))) AS ob FROM p a JOIN p b ON b.item_id = a.item_id + 1)
SELECT a, 'a and b are ' || CAST(round(round(percent, 6)) AS INT) || '% alike. Both concern ' || {_said('shared')} || '. Only a concerns ' || {_said('oa')} || '; only b concerns ' || {_said('ob')} || '. They are ' || CASE WHEN percent >= 60 THEN 'strongly' WHEN percent >= 30 THEN 'moderately' ELSE 'weakly' END || ' related.' AS report FROM s"""
)
def rel4_two_subjects(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("tb")), "a")
    return pairs.select("a", reports.two_subject_report(F.lit("a"), F.lit("b"), F.col("ta"), F.col("tb")).alias("report"))


@query(f"WITH p AS (SELECT item_id, {_profile('text')} FROM benchmark), s AS (SELECT a.item_id AS a, b.item_id AS b, {_PERCENT} AS percent, list_sort(list_intersect(a.nouns, b.nouns)) AS shared FROM p a JOIN p b ON a.item_id < b.item_id) SELECT a, b, round(percent, 6) AS percent, array_to_string(shared[1:6], ' ') AS shared, CAST(row_number() OVER (ORDER BY percent DESC, a, b) AS INT) AS rank FROM s WHERE percent >= 20 QUALIFY rank <= 50")
def top5_best_pairs(spark, sf_dir):
    best = relations.top_pairs(_t(spark, sf_dir, "benchmark"), "item_id", "text")
    return best.select("a", "b", F.round("percent", 6).alias("percent"), F.array_join("shared", " ").alias("shared"), "rank")


@query(
    f"""WITH p AS (SELECT item_id, lower(text) AS t, {_content('text', 'NOT ' + _PREDICATE)} AS nouns FROM benchmark), s AS (SELECT a.item_id AS a, b.item_id AS b, a.t AS ta, b.t AS tb, list_sort(list_intersect(a.nouns, b.nouns)) AS n FROM p a JOIN p b ON a.item_id < b.item_id),
e AS (SELECT a, b, CAST(len(list_filter(n[1:6], lambda x: contains(ta, x) OR contains(tb, x))) AS INT) AS examples, CAST(len(n) AS BIGINT) AS shared FROM s) SELECT a, b, examples, shared, CAST(row_number() OVER (ORDER BY examples DESC, shared DESC, a, b) AS INT) AS rank FROM e WHERE examples > 0 QUALIFY rank <= 20"""
)
def top5_exemplified_pairs(spark, sf_dir):
    return relations.exemplified_pairs(_t(spark, sf_dir, "benchmark"), "item_id", "text")


@query("SELECT event_type AS file, round(sum(value), 6) AS score FROM events GROUP BY 1 ORDER BY sum(value) * CASE WHEN starts_with(event_type, 'code') THEN 0.7 ELSE 1 END DESC, 1 LIMIT 1")
def agg4_topic(spark, sf_dir):
    scores = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("file")).agg(F.sum("value").alias("score"))
    return reports.best_topic(scores).select("file", F.round("score", 6).alias("score"))


_N = "(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), token, ''))) // length(token)"


@query(f"WITH t AS (SELECT unnest(['tion', 'que', 'e.', 'zzz']) AS token), c AS (SELECT token, CAST(sum(CASE WHEN role = 'user' THEN {_N} ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN role <> 'user' THEN {_N} ELSE 0 END) AS BIGINT) AS b FROM conversations, t GROUP BY 1) SELECT token, a, b, CASE WHEN a = b THEN 'equal' WHEN a > b THEN 'more in a' ELSE 'more in b' END AS label FROM c")
def agg9_token_support(spark, sf_dir):
    sides = _t(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "a").otherwise("b").alias("side"), "text")
    return reports.token_support(sides, "side", "text", ["tion", "que", "e.", "zzz"])


@query(f"WITH c AS (SELECT max(len(list_intersect(['the', 'that', 'and', 'are'], {_tokens('text')})) / CAST(4 AS DOUBLE)) AS coverage FROM benchmark) SELECT coverage, coverage >= 0.35 AS covered FROM c")
def agg15_predicate_coverage(spark, sf_dir):
    return reports.predicate_coverage(_t(spark, sf_dir, "benchmark"), "text", ["the", "that", "and", "are"])


@query("SELECT max(p_partkey) + 1 AS next_id FROM part")
def agg16_next_id(spark, sf_dir):
    return reports.next_id(_t(spark, sf_dir, "part"), "p_partkey")


@query("SELECT bool_and(p_size > 0) AS passed FROM part")
def agg18_all_passed(spark, sf_dir):
    return reports.all_passed(_t(spark, sf_dir, "part").select((F.col("p_size") > 0).alias("p")), "p")


_FRAGS = f"f AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS term, item_id AS ord, text AS f, contains(lower(text), 'ther') AS s, regexp_matches(lower(text), 'not|n''t|no|never|cannot|without') AND regexp_matches(lower(text), 'is|ther') AS u FROM benchmark)"


def _fragments(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("term"), F.col("item_id").alias("ord"), F.col("text").alias("fragment"))


@query(f"WITH {_FRAGS} SELECT term, bool_or(len(list_intersect({_words('f')}, ['ther', 'thers'])) > 0) AS has, count(*) FILTER (s) AS supporting, count(*) FILTER (u) AS unsupporting, md5(coalesce(string_agg(f, '|' ORDER BY ord) FILTER (s), '')) AS told FROM f GROUP BY term")
def rel5_evidence(spark, sf_dir):
    e = reports.evidence(_fragments(spark, sf_dir), "is ther")
    return e.select("term", "has", F.size("supporting").cast("long").alias("supporting"), F.size("unsupporting").cast("long").alias("unsupporting"), F.md5(F.array_join("supporting", "|")).alias("told"))


_SHARED = f"""{_FRAGS}, w AS (SELECT DISTINCT term, unnest({_tokens('f')}) AS token FROM f), k AS (SELECT token FROM w WHERE length(token) > 2 AND token NOT IN ('even', 'odd') GROUP BY token HAVING count(*) = 2),
c AS (SELECT token, CAST(coalesce(sum((length(f) - length(replace(lower(f), token, ''))) // length(token)) FILTER (term = 'even'), 0) AS BIGINT) AS n_a, CAST(coalesce(sum((length(f) - length(replace(lower(f), token, ''))) // length(token)) FILTER (term = 'odd'), 0) AS BIGINT) AS n_b, bool_or(s) AS s, bool_or(u) AS u FROM f JOIN k ON contains(lower(f), token) GROUP BY token),
d AS (SELECT *, CASE WHEN n_a = n_b THEN 'equal' WHEN n_a > n_b THEN 'more_in_even' ELSE 'more_in_odd' END AS equality, CASE WHEN s AND u THEN 'mixed' WHEN s THEN 'supportive' WHEN u THEN 'unsupportive' ELSE 'neutral' END AS status FROM c)"""


@query(
    f"""WITH {_SHARED} SELECT token, n_a, n_b, equality, status, 'Both even and odd mention ''' || token || ''', ' || CASE status WHEN 'supportive' THEN 'which supports similarity' WHEN 'unsupportive' THEN 'but it is negated in one of them at least' WHEN 'mixed' THEN 'with evidence for and against' ELSE 'without evidence for or against' END || '.' ||
CASE WHEN n_a = n_b THEN ' They do so equally often (' || n_a || ' times).' ELSE ' It is more frequent in ' || CASE WHEN n_a > n_b THEN 'even' ELSE 'odd' END || ' (' || greatest(n_a, n_b) || ' against ' || least(n_a, n_b) || ').' END AS sentence FROM d"""
)
def rel6_shared_tokens(spark, sf_dir):
    return reports.shared_token_appraisal(_fragments(spark, sf_dir), "even", "odd", "is ther")


@query(
    f"""WITH {_SHARED}, t AS (SELECT list_sort(list(token)) AS x FROM d), h AS (SELECT term, bool_or(len(list_intersect({_words('f')}, ['ther', 'thers'])) > 0) AS has, coalesce(array_to_string((list(f ORDER BY ord) FILTER (s))[1:2], '; '), '(no direct supporting fragments)') AS sup, count(*) FILTER (s) AS n FROM f GROUP BY term),
r AS (SELECT CASE WHEN bool_and(has) THEN 'Even and Odd both clearly is ther.' || CASE WHEN sum(n) > 0 THEN ' Supporting: Even: ' || max(sup) FILTER (term = 'even') || '; Odd: ' || max(sup) FILTER (term = 'odd') || '.' ELSE '' END ELSE 'Even and Odd do not clearly both is ther.' END AS response FROM h)
SELECT response, CAST(len(x) AS INT) AS shared, response || CASE WHEN len(x) > 0 THEN ' Shared words: ' || {_LISTED.replace("'nothing'", "''")} || '.' ELSE '' END AS narrative FROM r, t"""
)
def rel6_7_detailed_comparison(spark, sf_dir):
    """REL-6 and REL-7: response, evidence and narrative in one row."""
    return reports.detailed_comparison(_fragments(spark, sf_dir), "even", "odd", "is ther").select("response", F.size("shared").alias("shared"), "narrative")


@query(
    """WITH k AS (SELECT p_name, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1)
SELECT p.p_partkey AS prompt_id, CASE WHEN p.p_partkey % 3 <> 1 THEN upper(left(p.p_name, 1)) || substring(p.p_name, 2) || ': It is of ' || k.brand ELSE upper(left(p.p_name, 1)) || substring(p.p_name, 2) || ': It is of ' || k.brand || chr(10) || 'Nothing: (no definition found)' END AS answer FROM part p JOIN k USING (p_name) WHERE p.p_partkey % 3 <> 2"""
)
def rel9_definitions(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_name").alias("term")).agg(F.array(F.concat(F.lit("It is of "), F.min_by("p_brand", "p_partkey"), F.lit(" [1]"))).alias("definitions"))
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Define a "), F.col("p_name"), F.lit(" in one sentence"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("what is the definition of "), F.upper("p_name"), F.lit(" and the nothing?"))).otherwise(F.col("p_name"))
    return reports.definitions_for(part.select(F.col("p_partkey").alias("prompt_id"), said.alias("prompt")), known)


# Responses

_PROMPT2 = "red widget, which shines; economy brand and bolt = small gear"
_KW = "kw2 AS (SELECT * FROM (VALUES ('red', 0, 1, 'red widget'), ('widget', 0, 2, 'red widget'), ('shines', 2, 1, 'shines'), ('economy', 3, 1, 'economy brand and bolt = small gear'), ('brand', 3, 2, 'economy brand and bolt = small gear'), ('bolt', 3, 3, 'economy brand and bolt = small gear'), ('small', 3, 4, 'economy brand and bolt = small gear'), ('gear', 3, 5, 'economy brand and bolt = small gear')) v(keyword, frag, kw, fragment))"


def _taxa() -> str:
    from lexiqua.queries import _TAXA

    # The tables of matches keep their entry's key and gloss.
    return _TAXA.replace("x AS (SELECT keyword, 'other'", "x AS (SELECT key, gloss, synonym, keyword, 'other'") + f', {_KW}, y AS (SELECT s.*, frag, kw, fragment FROM s JOIN kw2 USING (keyword)), rep AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY variable ORDER BY frag, kw, phylum, variable, type, value) = 1)'


_SNIP = "CASE WHEN length({0}) > {1} THEN rtrim(left({0}, {1} - 3)) || '...' ELSE {0} END"
_ORDER1 = 'trim(split_part(split_part("order", chr(10), 1), \'.\', 1))'


def _walked(source: str, steps: int, shift: bool) -> str:
    at = f"CAST(round_even((cos(2 * pi() * i / {steps}) + 1) / 2 * (n - 1), 0) AS BIGINT)"
    return f"z AS (SELECT *, row_number() OVER (ORDER BY score DESC, frag, kw, phylum, variable, type, value) - 1 AS place, count(*) OVER () AS n FROM {source}), v AS (SELECT z.*, i AS step FROM z JOIN range({steps}) r(i) ON ({at}{' + i' if shift else ''}) % n = place)"


def _conditional() -> str:
    head = "CASE WHEN family <> 'general' AND phylum <> '' THEN family || ', ' || phylum WHEN family <> 'general' THEN family WHEN phylum <> '' THEN phylum ELSE kingdom END"
    ctx = f"CASE WHEN {_ORDER1} <> '' THEN {_ORDER1} ELSE fragment END"
    val = _SNIP.format("trim(replace(value, chr(10), ' '))", 200)
    forms = [f"{head} || ' — ' || variable || ' via ' || {ctx} || ' — => ' || type || ': ' || {val}", f"variable || ' via ' || {ctx} || ' — leads to ' || type || ': ' || {val}", f"{head} || ': ' || variable || ' via ' || {ctx} || ' -> ' || type || ': ' || {val}", f"variable || ' (' || {head} || ') — ' || type || ': ' || {val}"]
    return "CASE step % 4 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def _responses(spark, sf_dir):
    return responses.analysis(spark, spark.createDataFrame([(1, _PROMPT2)], "prompt_id int, prompt string"), _entries(spark, sf_dir))


@query(f'WITH {_taxa()} SELECT variable, keyword, type, value, score FROM rep')
def win3_representatives(spark, sf_dir):
    return responses.representatives(_responses(spark, sf_dir)).select("variable", "keyword", "type", "value", "score")


@query(f"WITH {_taxa()} SELECT variable FROM rep WHERE phylum = (SELECT phylum FROM y ORDER BY score DESC, frag, kw, phylum, variable, type, value LIMIT 1)")
def win7_anchored(spark, sf_dir):
    taxa = _responses(spark, sf_dir)
    return responses.anchored(taxa, responses.representatives(taxa), "phylum").select("variable")


@query(f"WITH {_taxa()} SELECT frag, variable, type, value FROM y QUALIFY row_number() OVER (PARTITION BY frag ORDER BY score DESC, frag, kw, phylum, variable, type, value) = 1")
def win2_best_of_fragments(spark, sf_dir):
    return responses.best_of_fragments(_responses(spark, sf_dir)).select("frag", "variable", "type", "value")


@query(f"WITH {_taxa()}, a AS (SELECT * FROM rep WHERE phylum = (SELECT phylum FROM y ORDER BY score DESC, frag, kw, phylum, variable, type, value LIMIT 1)), {_walked('a', 6, True)} SELECT CAST(step AS INT) AS step, variable, 'Variation ' || (step + 1) || '/6 — ' || variable || chr(10) || chr(10) || {_conditional()} AS text FROM v")
def tax3_conditional(spark, sf_dir):
    return responses.variations(_responses(spark, sf_dir)).select("step", "variable", "text")


@query(
    f"""WITH {_taxa()}, {_walked('rep', 6, False)} SELECT CAST(step AS INT) AS step, variable, 'Variation ' || (step + 1) || '/6 — ' || variable || chr(10) || chr(10) || 'Plunging into the ' || kingdom || ' of ' || phylum || ', a ' || family || ' named ' || variable || CASE WHEN {_ORDER1} <> '' THEN ', winds through ' || {_SNIP.format(_ORDER1, 140)} ELSE '' END || ', and pins the answer as the ' || type || ': ' || {_SNIP.format('value', 220)} || '.' AS text FROM v"""
)
def tax3_poetic(spark, sf_dir):
    return responses.variations(_responses(spark, sf_dir), kind="poetic").select("step", "variable", "text")


@query(
    f"""WITH {_taxa()}, {_walked('rep', 6, False)}, l AS (SELECT variable, string_agg('In ' || kingdom || ' (' || phylum || '), ' || variable || ', a ' || family || ': ' || value || ' (from: ''' || fragment || ''')', chr(10) || chr(10) ORDER BY r) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY score DESC, frag, kw, phylum, variable, type, value) AS r FROM y QUALIFY r <= 6) GROUP BY 1)
SELECT CAST(step AS INT) AS step, variable, 'Variation ' || (step + 1) || '/6 — ' || variable || chr(10) || chr(10) || lines AS text FROM v JOIN l USING (variable)"""
)
def tax3_plain(spark, sf_dir):
    return responses.variations(_responses(spark, sf_dir), kind="plain").select("step", "variable", "text")


@query(
    f"""WITH {_taxa()}, topic AS (SELECT phylum AS t FROM (SELECT phylum, sum(score) AS s FROM y GROUP BY 1) ORDER BY s DESC, phylum LIMIT 1), main AS (SELECT y.* FROM y, topic WHERE phylum = t ORDER BY score DESC, frag, kw, phylum, variable, type, value LIMIT 1),
cl AS (SELECT list(key || ': ' || gloss || ' (synonyms: ' || synonym || ')' ORDER BY frag, kw, phylum, variable, type, value) AS c FROM (SELECT y.* FROM y, topic WHERE phylum = t QUALIFY row_number() OVER (PARTITION BY variable ORDER BY frag, kw, phylum, variable, type, value) = 1)),
yf AS (SELECT y.* FROM y WHERE family = (SELECT family FROM main)), a AS (SELECT * FROM yf QUALIFY row_number() OVER (PARTITION BY variable ORDER BY frag, kw, phylum, variable, type, value) = 1), {_walked('a', 4, True)},
rl AS (SELECT list('Variation ' || (step + 1) || '/4 — ' || variable || chr(10) || chr(10) || {_conditional()} ORDER BY step) AS r FROM v), tv AS (SELECT *, {_SNIP.format('trim(value)', 400)} AS val FROM main)
SELECT t AS topic, variable, CAST(len(c) AS INT) AS clarifiers, 'Focusing on ' || kingdom || ' → ' || phylum || ' → ' || family || ',' || chr(10) || chr(10) || 'the concept ''' || variable || ''' resolves to ' || type || '.' || chr(10) || chr(10) || upper(left(val, 1)) || substring(val, 2) || chr(10) || chr(10) || 'Clarifiers: ' || array_to_string(c[1:4], '; ') || chr(10) || chr(10) || 'Related perspectives:' || chr(10) || chr(10) || array_to_string(r[1:4], chr(10) || chr(10)) AS response FROM tv, topic, cl, rl"""
)
def tax2_response(spark, sf_dir):
    r = responses.respond(_responses(spark, sf_dir))
    return r.select("topic", F.col("main.variable").alias("variable"), F.col("n_clarifiers").alias("clarifiers"), "response")


@query(
    f"""WITH {_RANKED}, d AS (SELECT *, CASE WHEN family <> 'general' THEN 3 ELSE 0 END + least(10, length("order") // 50) + least(10, length(value) // 80) AS depth FROM ranked),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY variable ORDER BY depth DESC, score DESC, rank) = 1),
p AS (SELECT *, row_number() OVER (ORDER BY depth DESC, score DESC, rank) - 1 AS pos FROM o QUALIFY pos < 8),
w AS (SELECT i AS step, CAST(round_even((cos(2 * pi() * i / 4) + 1) / 2 * ((SELECT count(*) FROM p) - 1), 0) AS BIGINT) AS pos FROM range(4) r(i)),
t AS (SELECT step, variable || ' (' || family || '): ' || CASE WHEN length(value) > 140 THEN left(value, 137) || '...' ELSE value END AS text FROM w JOIN p USING (pos))
SELECT string_agg(CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN rtrim(text) ELSE rtrim(text) || '.' END, ' ' ORDER BY step) AS paragraph FROM t"""
)
def ses4_paragraph(spark, sf_dir):
    return sessions.conjecture_paragraph(_session(spark, sf_dir), 4)


@query(
    f"""WITH {_RANKED}, a AS (SELECT * FROM ranked WHERE contains(variable, 'bolt') ORDER BY rank LIMIT 1),
t AS (SELECT ranked.*, CASE WHEN ranked.family = a.family THEN 1 WHEN ranked.phylum = a.phylum THEN 2 WHEN contains(ranked.variable, a.variable) THEN 3 END AS tier, a.variable AS own FROM ranked, a)
SELECT CAST(row_number() OVER (ORDER BY tier, rank) AS INT) AS step, variable, 'Step ' || step || ': ' || variable || ' (' || family || ', ' || phylum || ') — ' || type || ': ' || CASE WHEN length(value) > 180 THEN left(value, 177) || '...' ELSE value END AS text FROM t WHERE tier IS NOT NULL AND variable <> own QUALIFY step <= 5"""
)
def ses3_chain_text(spark, sf_dir):
    return sessions.chain_text(_session(spark, sf_dir), "bolt")


@query(f"WITH {_RANKED} SELECT variable, type, rank FROM ranked WHERE contains(variable, 'redwidget')")
def flt5_expanded(spark, sf_dir):
    return sessions.expand(_session(spark, sf_dir), "redwidget").select("variable", "type", F.col("rank").cast("long").alias("rank"))


# Mathematics

_STEPS = [{"expression": "size * 2 + 1", "assign": "width"}, {"expression": "width / size", "assign": "part", "description": "the part", "unit": "kg"}]


def _rendered(spark, sf_dir, render):
    return _t(spark, sf_dir, "part").select("p_partkey", render({"size": F.col("p_size")}, _STEPS).alias("told"))


_SIX = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('%.6g', CAST({0} AS DOUBLE)) END"
_W, _P = _SIX.format("(p_size * 2 + 1)"), "printf('%.6g', CAST((p_size * 2 + 1) / CAST(p_size AS DOUBLE) AS DOUBLE))"


@query(f"SELECT p_partkey, 'Given:|  size = ' || p_size || '|Steps:|  1. width|    Formula: size * 2 + 1|    Result: ' || {_W} || '|  2. the part|    Formula: width / size|    Result: ' || {_P} || ' kg|Answer: part = ' || {_P} || ' kg' AS told FROM part".replace("|  ", "' || chr(10) || '  ").replace("|Steps", "' || chr(10) || 'Steps").replace("|Answer", "' || chr(10) || 'Answer"))
def mth5_annotated(spark, sf_dir):
    return _rendered(spark, sf_dir, mathexpr.render_annotated)


@query(rf"SELECT p_partkey, '\textbf{{Given:}}' || chr(10) || '  $size = ' || p_size || '$' || chr(10) || '\textbf{{Steps:}}' || chr(10) || '  1. width' || chr(10) || '  $$size * 2 + 1$$' || chr(10) || '  $= ' || {_W} || '$' || chr(10) || '  2. the part' || chr(10) || '  $$width / size$$' || chr(10) || '  $= ' || {_P} || '\,\text{{kg}}$' || chr(10) || '\textbf{{Answer:}} $part = ' || {_P} || '\,\text{{kg}}$' AS told FROM part")
def mth5_latex(spark, sf_dir):
    return _rendered(spark, sf_dir, mathexpr.render_latex)


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CAST(p_size * 2 + 1 AS DOUBLE) AS first, 'kg' AS unit, round((p_size * 2 + 1) / CAST(p_size AS DOUBLE), 9) AS answer FROM part")
def mth5_json(spark, sf_dir):
    j = _rendered(spark, sf_dir, mathexpr.render_json)
    get = lambda path: F.get_json_object("told", path)
    return j.select("p_partkey", get("$.given.size").cast("long").alias("size"), get("$.steps[0].result").cast("double").alias("first"), get("$.steps[1].unit").alias("unit"), F.round(get("$.answer").cast("double"), 9).alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN round((p_size + 3 * p_retailprice) / 7, 4) END AS x, CASE WHEN p_partkey % 5 <> 4 THEN round((2 * p_retailprice - 4 * p_size) / CAST(14 AS DOUBLE), 4) END AS y FROM (SELECT p_partkey, p_size, CAST(p_partkey AS DOUBLE) AS p_retailprice FROM part)")
def mth6_equations(spark, sf_dir):
    """2x + 3y = p, 2x - 4y = 2s, of every fifth part two that are one."""
    n, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("x + y = "), n, F.lit(", 2x + 2y = 1"))).otherwise(F.concat(F.lit("x - 3*y = "), s, F.lit(" - 0, 2x + y = "), n))
    solved = reports.solve_equations(_t(spark, sf_dir, "part").select("p_partkey", said.alias("said")), "p_partkey", "said")
    return solved.select("p_partkey", F.round(F.col("solution")["x"], 4).alias("x"), F.round(F.col("solution")["y"], 4).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - l_tax, 9) AS u, round((l_quantity - l_tax) / 2, 9) AS half FROM lineitem")
def mth8_heat_balance(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(mathexpr.heat_balance(F.col("l_quantity"), F.col("l_tax")), 9).alias("u"), F.round(mathexpr.half_heat_balance(F.col("l_quantity"), F.col("l_tax")), 9).alias("half"))


_VALUE = {c: f"CAST(p_size + {i} AS DOUBLE)" for i, c in enumerate(sorted({n for e in mathexpr.GENERATED for n in mathexpr.names_of(e)}))}


def _sql_of(expression: str) -> str:
    text_ = re.sub(r"([A-Za-z]+)\*\*(\d+)", r"pow(\1, \2)", expression)
    return re.sub(r"[A-Za-z]+", lambda m: m[0] if m[0] == "pow" else _VALUE[m[0]], text_)


@query("SELECT p_partkey, " + ", ".join(f"round({_sql_of(e)}, 6) AS e{i}" for i, e in enumerate(mathexpr.GENERATED)) + " FROM part")
def mth9_generated(spark, sf_dir):
    values = {c: F.col("p_size") + i for i, c in enumerate(_VALUE)}
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(mathexpr.compile_expression(e, values), 6).alias(f"e{i}") for i, e in enumerate(mathexpr.GENERATED)))


_SPELLED = ["so PV = nRT, and F = m a", "Delta U = Q - W", "ΔS >= 0 always", "V=I R", "it is E = m c^2", "nothing", "Delta S ≥ 0x"]
_NAMED = ["Ideal Gas Law|Newton''s Second Law", "First Law of Thermodynamics", "Second Law of Thermodynamics (entropy)", "Ohm''s Law", "Energy-Mass Equivalence", "", ""]


@query("SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMED)) + " END AS names FROM part")
def mth10_equation_names(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(reports.equation_names(F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col("p_partkey") % 7 + 1).cast("int"))), "|").alias("names"))


@query(f"SELECT p_partkey, array_to_string(list_concat({_tokens("p_name || ' is ' || p_type || ' ion of size = ' || CAST(p_size AS VARCHAR)")}, {_tokens('p_brand')}), ' ') AS tokens FROM part")
def agg13b_entry_tokens(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("p_partkey", F.element_at(F.split("key", " "), -1).cast("long"))
    return e.select("p_partkey", F.array_join(match.entry_tokens(F.col("senses")), " ").alias("tokens"))


@query("SELECT p_partkey, p_name || ' is ' || CASE p_partkey % 4 WHEN 0 THEN 'a concept' WHEN 1 THEN 'the ' || p_type ELSE CASE WHEN p_type = 'ECONOMY' THEN 'an ' ELSE 'a ' END || p_type END || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' that ' || p_brand ELSE ' that ' || p_brand || ', x, and y' END || '.' || CASE WHEN p_size % 2 = 0 THEN ' The formula is ' || p_size || 'x.' ELSE '' END AS told FROM part")
def str22_definition_with_details(spark, sf_dir):
    n = F.col("p_partkey")
    core = F.when(n % 4 == 0, " ").when(n % 4 == 1, F.concat(F.lit("the "), F.col("p_type"))).otherwise(F.col("p_type"))
    details = F.when(n % 3 == 0, F.array(F.lit(" "))).when(n % 3 == 1, F.array("p_brand")).otherwise(F.array(F.col("p_brand"), F.lit("x "), F.lit(""), F.lit("y")))
    formula = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("x")))
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.definition_style(F.col("p_name"), core, details, formula).alias("told"))


@query("SELECT p_partkey, ['range', 'compare', 'none', 'range'][p_partkey % 4 + 1] AS kind, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS a, CASE WHEN p_partkey % 4 <> 2 THEN CAST(p_size AS VARCHAR) END AS b FROM part")
def str30_int_to_int(spark, sf_dir):
    n, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("from ("), n, F.lit(") to ("), s, F.lit(")"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Compare "), n, F.lit(" to "), s)).when(F.col("p_partkey") % 4 == 2, n).otherwise(F.concat(F.lit("x to "), s))
    i = prompts.int_to_int(said)
    return _t(spark, sf_dir, "part").select("p_partkey", i["kind"].alias("kind"), i["a"].alias("a"), i["b"].alias("b"))


@query(
    f"""WITH {_SIDES}, p AS (SELECT a.g, a.t AS ta, b.t AS tb FROM t a JOIN t b ON a.g = b.g AND a.s = 0 AND b.s = 1),
m AS (SELECT g, max(len(list_intersect(ta, tb)) / CAST(greatest(least(len(list_distinct(ta)), len(list_distinct(tb))), 1) AS DOUBLE)) AS o, max({_INCLUDED.format(n='tb', b='ta')}) AS ab, max({_INCLUDED.format(n='ta', b='tb')}) AS ba, max({_jaccard('ta', 'tb')}) AS j FROM p GROUP BY g)
SELECT g, CASE WHEN o > 0.85 THEN 'Yes: ''a'' and ''b'' are equivalent. (high token overlap)' WHEN ab >= 0.6 AND ba >= 0.6 THEN 'Yes: ''a'' and ''b'' are equivalent. (both include the other: ' || printf('%.2f', ab) || '/' || printf('%.2f', ba) || ')' WHEN ab >= 0.6 THEN '''a'' broadly includes ''b'' (score ' || printf('%.2f', ab) || ').'
 WHEN ba >= 0.6 THEN '''b'' broadly includes ''a'' (score ' || printf('%.2f', ba) || ').' WHEN j >= 0.25 THEN '''a'' and ''b'' overlap (score ' || printf('%.2f', j) || ').' ELSE '''a'' and ''b'' appear distinct. (low overlap and no inclusion)' END AS answer FROM m"""
)
def rel8_equality_answers(spark, sf_dir):
    """REL-8: the answer that follows from the relation of two terms."""
    e = _t(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("g"), (F.col("item_id") % 2).alias("s"), text.tokenize(F.col("text")).alias("t"))
    best = relations.tiered_relation(relations.best_of_entries(e.filter("s = 0"), e.filter("s = 1"), "g", "t"))
    return best.select("g", reports.equality_answer(F.lit("a"), F.lit("b"), F.col("relation"), F.col("score"), F.col("reason")).alias("answer"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) * p_size END AS value, CASE p_partkey % 4 WHEN 0 THEN 'area_square(s)' WHEN 1 THEN 'missing: s' WHEN 2 THEN 'no formula nothing of geometry' ELSE 'no value' END AS detail FROM part")
def mth7_by_name(spark, sf_dir):
    """MTH-7: a formula by its name, with what is missing told; of every fourth part a missing value of its argument."""
    cases = [formulas.evaluated("geometry", "AREA_Square", {"S": "cast(p_size AS double)"}), formulas.evaluated("geometry", "area_square", {"other": "1D"}), formulas.evaluated("geometry", "nothing", {}), formulas.evaluated("geometry", "area_square", {"s": "cast(NULL AS double)"})]
    c = F.element_at(F.array(*cases), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", c["value"].alias("value"), c["detail"].alias("detail"))


# Formulas over arrays and functions

_A = "(CAST(embedding[1] AS DOUBLE))", "(CAST(embedding[2] AS DOUBLE))", "(CAST(embedding[3] AS DOUBLE))"
_B = "(CAST(embedding[4] AS DOUBLE))", "(CAST(embedding[5] AS DOUBLE))", "(CAST(embedding[6] AS DOUBLE))"
_DOT = " + ".join(f"{a} * {b}" for a, b in zip(_A, _B))
_LEN = " + ".join(f"{b} * {b}" for b in _B)
_ARRAYS = {
    "algebra.polynomial": (f"{_A[0]} + {_A[1]} * 2 + {_A[2]} * 4", None), "algebra.evaluate_polynomial": (f"{_A[0]} + {_A[1]} * 2 + {_A[2]} * 4", None), "math.polynomial": (f"{_A[0]} + {_A[1]} * 2 + {_A[2]} * 4", None),
    "math.average": (f"({' + '.join(_A)}) / 3", None), "math.mean": (f"({' + '.join(_A)}) / 3", None), "statistics.mean": (f"({' + '.join(_A)}) / 3", None), "finance.expected_return": (_DOT, None), "finance.portfolio_return": (_DOT, None),
    "probability.expected_value_discrete": (_DOT, None), "probability.variance_discrete": (" + ".join(f"pow({a} - ({_DOT}), 2) * {b}" for a, b in zip(_A, _B)), None),
    "linear_algebra.projection_scalar": (f"({_DOT}) / sqrt({_LEN})", None), "vectors.projection_scalar": (f"({_DOT}) / sqrt({_LEN})", None), "linear_algebra.projection_vector": (f"({_DOT}) / ({_LEN}) * {_B[1]}", "[1]"), "vectors.projection_vector": (f"({_DOT}) / ({_LEN}) * {_B[1]}", "[1]"),
    "linear_algebra.cross_product": (f"{_A[2]} * {_B[0]} - {_A[0]} * {_B[2]}", "[1]"), "linear_algebra.unit_vector": (f"{_A[2]} / sqrt({' + '.join(f'{a} * {a}' for a in _A)})", "[2]"), "linear_algebra.vector": (_A[1], "[1]"),
    "linear_algebra.matrix_addition": (f"{_A[1]} + {_B[1]}", "[0][1]"), "linear_algebra.matrix_subtraction": (f"{_A[2]} - {_A[0]}", "[1][0]"), "linear_algebra.scalar_multiplication": (f"3 * {_A[1]}", "[0][1]"),
    "linear_algebra.matrix_2x2": (_A[2], "[1][0]"), "linear_algebra.inverse_2x2": (f"-{_A[1]} / ({_A[0]} * {_B[0]} - {_A[1]} * {_A[2]})", "[0][1]"),
}


def _single(x: str) -> str:
    """The nearest single-precision number."""
    return f"CAST(CAST(({x}) + CAST(0 AS DOUBLE) AS FLOAT) AS DOUBLE)"


@query("SELECT vec_id, " + ", ".join(f'{_single(sql)} AS "{n.replace(".", "_")}"' for n, (sql, _) in _ARRAYS.items()) + " FROM embeddings")
def fml_arrays(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).selectExpr("vec_id", "slice(e, 1, 3) AS v", "slice(e, 4, 3) AS w", "array(slice(e, 1, 2), array(e[2], e[3])) AS m", "array(slice(e, 4, 2), slice(e, 1, 2)) AS k")
    args = {"v": "v", "w": "w", "coeffs": "v", "values": "v", "ps": "w", "rs": "v", "ws": "w", "xs": "v", "x": "2D", "A": "m", "B": "k", "k": "3D", "a": "v[0]", "b": "v[1]", "c": "v[2]", "d": "w[0]", "coords": "v[0], v[1], v[2]"}
    columns = []
    for name, (_, at) in _ARRAYS.items():
        f = formulas.formula(*name.split("."))
        columns.append(F.expr(_single(f"({f.sql({a.lstrip('*'): args[a.lstrip('*')] for a in f.args})}){at or ''}")).alias(name.replace(".", "_")))
    return e.select("vec_id", *columns)


_F1, _G1 = "pow({0}, 2)", "(3 * ({0}))"
_X, _H = "(l_discount + 1)", "CAST(0.5 AS DOUBLE)"


def _at(form: str, x: str) -> str:
    return form.format(x)


_D = lambda form: f"(({_at(form, f'({_X} + {_H})')} - {_at(form, _X)}) / {_H})"
_CALCULUS = {
    "limit_definition": _at(_F1, f"({_X} + {_H})"), "derivative_definition": _D(_F1), "derivative_sum": f"{_D(_F1)} + {_D(_G1)}",
    "derivative_quotient_rule": f"({_D(_F1)} * {_at(_G1, _X)} - {_at(_F1, _X)} * {_D(_G1)}) / pow({_at(_G1, _X)}, 2)", "derivative_chain_rule": f"({_at(_F1, _at(_G1, f'({_X} + {_H})'))} - {_at(_F1, _at(_G1, _X))}) / {_H}",
    "riemann_sum_left": f"({_at(_F1, _X)} + {_at(_F1, '(l_tax + 2)')}) * {_H}", "riemann_sum_right": f"({_at(_F1, _X)} + {_at(_F1, '(l_tax + 2)')}) * {_H}", "definite_integral_approx": f"({_at(_F1, _X)} + {_at(_F1, '(l_tax + 2)')}) * {_H}",
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_single(sql)} AS {n}" for n, sql in _CALCULUS.items()) + ", round(l_discount * 100 / 1.05 + l_discount * 100 / pow(1.05, 2) + 100 / pow(1.05, 2), 6) AS bond_price FROM lineitem")
def fml_functions(spark, sf_dir):
    build = {"f": lambda a: f"power({a}, 2)", "g": lambda a: f"3 * ({a})"}
    args = {"x": "(l_discount + 1)", "h": "0.5D", "a": "(l_discount + 1)", "dx": "0.5D", "xs": "array(l_discount + 1, l_tax + 2)"}
    columns = []
    for name in _CALCULUS:
        f = formulas.formula("calculus", name)
        columns.append(F.expr(_single(f.sql({a: args[a] for a in f.args if a not in f.takes_functions}, {g: build[g] for g in f.takes_functions}))).alias(name))
    bond = formulas.formula("finance", "bond_price").column(C="(l_discount * 100)", r="0.05D", n="2D", F="100D")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns, F.round(bond, 6).alias("bond_price"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount), 3) AS finance_portfolio_return, round(sum(l_quantity * l_discount), 3) AS probability_expected_value_discrete, round(sum(l_discount * l_discount * l_tax) - pow(sum(l_discount * l_tax), 2), 3) AS probability_variance_discrete, round(avg(l_quantity), 6) AS math_average, round(avg(l_quantity), 6) AS math_mean, median(l_quantity) AS math_median, max(l_quantity) - min(l_quantity) AS math_range_stat, round(var_pop(l_quantity), 6) AS math_variance_population, round(stddev_pop(l_quantity), 6) AS math_standard_deviation_population FROM lineitem GROUP BY 1")
def fml_over_rows(spark, sf_dir):
    args = {"value": "l_quantity", "w": "l_discount", "r": "l_quantity", "x": "l_quantity", "p": "l_discount"}

    def of(domain: str, name: str, **more: str):
        names = {**args, **more}
        return F.expr(re.sub(r"\b(" + "|".join(names) + r")\b(?!\()", lambda m: names[m[1]], formulas.formula(domain, name, True).body))

    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(of("finance", "portfolio_return"), 3).alias("finance_portfolio_return"), F.round(of("probability", "expected_value_discrete"), 3).alias("probability_expected_value_discrete"), F.round(of("probability", "variance_discrete", x="l_discount", p="l_tax"), 3).alias("probability_variance_discrete"),
        *((F.round(of("math", n), 6) if n in ("average", "mean", "variance_population", "standard_deviation_population") else of("math", n)).alias(f"math_{n}") for n in ("average", "mean", "median", "range_stat", "variance_population", "standard_deviation_population")),
    )
