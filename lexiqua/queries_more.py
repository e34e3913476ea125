"""Queries over expressions in columns, units, equation systems, and joins by containment, likeness and rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiqua.functions import fuzzy, rowexpr, text, units
from lexiqua.operators import match, reports
from lexiqua.queries import _entries, _normal, _t, _words, query

#: Forms of expressions over a row's numbers: how each is written, and the same in SQL.
_FORMS = [
    (["", "l_quantity", " * (", "l_extendedprice", " - ", "l_discount", ") / -(1 + ", "l_tax", ")^2"], "l_quantity * (l_extendedprice - l_discount) / -((1 + l_tax) * (1 + l_tax))"),
    (["-", "l_quantity", "^2 + ", "l_extendedprice", " // 7 - ", "l_linenumber", " % 3"], "-(l_quantity * l_quantity) + floor(l_extendedprice / 7) - l_linenumber % 3"),
    (["sqrt(abs(", "l_discount", " - ", "l_tax", ")) * ", "l_quantity", " / ", "l_linenumber", " / 2"], "sqrt(abs(l_discount - l_tax)) * l_quantity / l_linenumber / 2"),
    (["2 - 3 - ", "l_quantity", " * -", "l_tax", " + (((", "l_extendedprice", ")))"], "2 - 3 - l_quantity * -l_tax + l_extendedprice"),
    (["", "l_quantity", " / (", "l_linenumber", " - ", "l_linenumber", ")"], "CAST(NULL AS DOUBLE)"),
    (["price * (1 - ", "l_discount", ") + unknown"], "CAST(NULL AS DOUBLE)"),
    (["price * (1 - ", "l_discount", ") ** 2 / 1e2"], "l_extendedprice * ((1 - l_discount) * (1 - l_discount)) / 100"),
    (["(", "l_quantity", " + ", "l_tax"], "CAST(NULL AS DOUBLE)"),
]
_FORM = f"(l_orderkey + l_linenumber) % {len(_FORMS)}"


@query(f"SELECT l_orderkey, l_linenumber, CAST(CASE {' '.join(f'WHEN {_FORM} = {i} THEN {sql}' for i, (_, sql) in enumerate(_FORMS))} END AS FLOAT) AS v FROM lineitem")
def mth2_rows(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")
    written = [F.concat(*(F.col(p).cast("string") if p.startswith("l_") else F.lit(p) for p in parts)) for parts, _ in _FORMS]
    expression = F.coalesce(*(F.when(F.expr(_FORM) == i, w) for i, w in enumerate(written)))  # only a row's own form is written
    told = items.select("l_orderkey", "l_linenumber", "l_extendedprice", expression.alias("expression"))
    return told.select("l_orderkey", "l_linenumber", rowexpr.evaluate(F.col("expression"), {"price": F.col("l_extendedprice")}).cast("float").alias("v"))


_KEYWORDS = f"(SELECT DISTINCT w AS keyword FROM (SELECT unnest({_words('text')}) AS w FROM documents))"


@query(
    f"""WITH kw AS (SELECT keyword, {_normal('keyword')} AS n FROM {_KEYWORDS} WHERE {_normal('keyword')} <> ''),
e AS (SELECT lower(p_type) || '.json' AS file, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS key, {_normal("p_name || ' ' || CAST(p_partkey AS VARCHAR)")} AS k, {_normal("p_name || ' is ' || p_type || ' ion of size = ' || CAST(p_size AS VARCHAR)")} AS g, {_normal('p_brand')} AS s FROM part),
m AS (SELECT keyword, file, key, contains(k, n) AS ink, contains(s, n) AS ins, contains(g, n) AS ing FROM kw, e WHERE contains(k, n) OR contains(s, n) OR contains(g, n))
SELECT keyword, file, key, 'key' AS field FROM m WHERE ink UNION ALL SELECT keyword, file, key, 'synonym' FROM m WHERE NOT ink AND ins UNION ALL SELECT keyword, file, key, 'gloss' FROM m WHERE NOT ink AND ing"""
)
def join1_many_keywords(spark, sf_dir):
    """Every word of all documents against the parts."""
    words = _t(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("keyword"))  # repeats and all: these end at a limit
    return match.matches(_entries(spark, sf_dir), words).select("keyword", "file", "key", "field")


#: Stretches still open of a pair of words, one taken at a time: its longest common block (first in ``a``, then in ``b``) as 1000 * size - place.
_RATIO = """r AS (SELECT a, b, [{i: 0, j: length(a), k: 0, n: length(b)}] AS todo, 0 AS matched FROM p
 UNION ALL SELECT a, b, rest || CASE WHEN best IS NULL THEN [] ELSE list_filter([{i: s.i, j: ia, k: s.k, n: s.k + too}, {i: ia + size, j: s.j, k: s.k + too + size, n: s.n}], lambda x: x.i < x.j AND x.k < x.n) END, matched + coalesce(size, 0)
 FROM (SELECT *, CAST(instr(substr(b, s.k + 1, s.n - s.k), substr(a, ia + 1, size)) - 1 AS INT) AS too FROM (SELECT *, CAST(ceil(best / 1000) AS INT) AS size, CAST(ceil(best / 1000) * 1000 - best AS INT) AS ia FROM (SELECT *,
 list_max(flatten(list_transform(range(s.i, s.j), lambda x: list_transform(list_filter(range(1, s.j - x + 1), lambda l: contains(substr(b, s.k + 1, s.n - s.k), substr(a, x + 1, l))), lambda l: l * 1000 - x)))) AS best
 FROM (SELECT a, b, matched, todo[-1] AS s, todo[:-2] AS rest FROM r WHERE len(todo) > 0)))))"""


@query(
    f"""WITH RECURSIVE w AS (SELECT DISTINCT w FROM (SELECT unnest({_words('text')}) AS w FROM benchmark)),
p AS (SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w < y.w AND 5 * least(length(x.w), length(y.w)) >= 2 * (length(x.w) + length(y.w))
 WHERE 5 * list_sum(list_transform(list_distinct(string_split(x.w, '')), lambda c: least(length(x.w) - length(replace(x.w, c, '')), length(y.w) - length(replace(y.w, c, ''))))) >= 2 * (length(x.w) + length(y.w))),
{_RATIO}
SELECT a, b, round(2 * matched / (length(a) + length(b)), 9) AS ratio FROM r WHERE len(todo) = 0 AND 10 * matched >= 4 * (length(a) + length(b))"""
)
def join10_near_words(spark, sf_dir):
    """Words of the benchmark that are nearly alike."""
    words = _t(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("w")).distinct()
    return fuzzy.similar(words, words, 0.8).filter("a < b").select("a", "b", F.round("ratio", 9).alias("ratio"))


#: Pairs of units, and the same in SQL with their factors.
_UNITS = [
    ("kN*m/s**2", "N*m/s^2", "x * 1000"), ("miles per hour", "m/s", "x * 1609.344 / 3600"), ("kg m^2 / s^2", "kJ", "x / 1000"), ("degC", "degF", "x * 9 / 5 + 32"), ("degF", "K", "(x + 459.67) * 5 / 9"), ("m", "s", "NULL"),
    ("1/(kg*m)", "1/(g*cm)", "x / 100000"), ("m²", "cm^2", "x * 10000"), ("kW*hour", "MJ", "x * 3.6"), ("kilometers", "feet", "x * 1000 / 0.3048"), ("L/min", "gal/day", "x * 0.001 * 1440 / 0.003785411784"), ("degC*m", "K*m", "NULL"), ("blorp", "m", "NULL"), ("s^-1", "mHz", "x * 1000"),
]
_CASES = " ".join(f"WHEN {i} THEN {sql}" for i, (_, _, sql) in enumerate(_UNITS))
_WRONG = {5: "m is length, s is time", 11: "unknown unit: degC*m", 12: "unknown unit: blorp"}


@query(f"SELECT p_partkey, CAST(CASE k {_CASES} END AS FLOAT) AS result, CASE k {' '.join(f'''WHEN {i} THEN '{e}' ''' for i, e in _WRONG.items())} END AS error FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS x, p_partkey % {len(_UNITS)} AS k FROM part)")
def mth3_any_units(spark, sf_dir):
    """Each part's price as a measure, in units of its own row."""
    at = (F.col("p_partkey") % len(_UNITS)).cast("int")
    pick = lambda i: F.get(F.array(*(F.lit(u[i]) for u in _UNITS)), at)
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"), pick(0).alias("a"), pick(1).alias("b"))
    return rows.select("p_partkey", units.convert(F.col("x"), F.col("a"), F.col("b")).alias("r")).select("p_partkey", F.col("r.result").cast("float").alias("result"), "r.error")


@query(
    """WITH s AS (SELECT p_partkey, CAST(p_partkey % 90 AS DOUBLE) AS p, CAST(p_size AS DOUBLE) AS s FROM part), d AS (SELECT *, s * s - 4 * p AS d FROM s)
SELECT p_partkey, CAST((s - sqrt(d)) / 2 AS FLOAT) AS x, CAST((s + sqrt(d)) / 2 AS FLOAT) AS y FROM d WHERE d >= 0 UNION ALL SELECT p_partkey, CAST((s + sqrt(d)) / 2 AS FLOAT), CAST((s - sqrt(d)) / 2 AS FLOAT) FROM d WHERE d > 0"""
)
def mth6_systems(spark, sf_dir):
    """Of each part the numbers whose product and sum are what its key and size say."""
    said = F.concat(F.lit("x*y = "), (F.col("p_partkey") % 90).cast("string"), F.lit(", x + y = "), F.col("p_size").cast("string"))
    solved = reports.solve_systems(_t(spark, sf_dir, "part").select("p_partkey", said.alias("said")), "p_partkey", "said")
    return solved.select("p_partkey", F.explode("solutions").alias("v")).select("p_partkey", F.col("v")["x"].cast("float").alias("x"), F.col("v")["y"].cast("float").alias("y"))
