import random

from pyspark.sql import functions as F

from lexiqua.functions import fragments, mathexpr, sets, text
from lexiqua.operators import lookup, match, relations, reports


def clean(spark, *texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fragments.normalize_fragment(F.col("t")).alias("x")).collect()]


def test_fragments(spark):
    got = clean(spark, "n(n+1)/2", "E = mc²", "x^2 + \\frac{a}{b}", "2(a+b", "1905/06", "CH=O", "a : b", "2 π r", "a=b=c+1", "F = m a in newtons", None, "x^{12}", "(a+b))")
    assert got == ["n*(n+1)/2", "E=m*c**2", "x**2+((a)/(b))", "2*(a+b)", "", "", "a/b", "2*pi*r", "c+1", "F=m*a", "", "x**12", "(a+b)"]
    # examples of the survey, and what a fragment must not become
    assert clean(spark, "E = mc2", "E = m c^2", "δU = Q - W", "$1/2$") == ["E=m*c**2", "E=m*c**2", "delta*U=Q-W", "1/2"]
    assert clean(spark, "a++b", "-x * -y", "(", "a+(", "sqrt(2", "3.5x", "10²", "x_1 y2", "a <= b", "mc^2", "sin x", "") == ["a+b", "-x*-y", "", "a", "sqrt(2)", "3.5*x", "10**2", "x_1*y**2", "a<=b", "m*c**2", "sinx", ""]


def test_substituted_names_stand_for_themselves(spark):
    value = spark.range(1).select(fragments.substitute(F.lit("a.b + axb * a"), ["a", "a.b"], {"a": F.lit("$1"), "a.b": F.lit(2)}).alias("x")).first().x
    assert value == "2 + axb * $1"


def test_split_gloss(spark):
    get = lambda t: spark.range(1).select(fragments.split_gloss(F.lit(t)).alias("s")).first()["s"]
    assert tuple(get("A thing; with parts. Then more. and so")) == ("A thing. with parts", ["Then more", "and so"])
    assert tuple(get('He said "one. Two" there. End')) == ('He said "one. Two" there', ["End"]) and get("") is None


def test_reports(spark):
    spans = spark.createDataFrame([("a", 1900, 1909), ("b", 1905, 1920), ("c", 1950, 1960)], "key string, start int, end int")
    assert [r.line for r in reports.period_coverage(spans, 1900, 1909).orderBy("rank").collect()] == ["a: 1900 to 1909 (100.0%)", "b: 1905 to 1920 (23.8%)"]
    c = spark.range(1).select(reports.comparison(F.lit("alpha beta"), F.lit("alpha gamma")).alias("c")).first()["c"]
    assert (list(c.shared), list(c.only_a), list(c.only_b), c.verdict) == (["alpha"], ["beta"], ["gamma"], "strong")
    assert reports.best_topic(spark.createDataFrame([("code.json", 10.0), ("math.json", 8.0)], "file string, score double")).first().file == "math.json"
    sides = spark.createDataFrame([("a", "red red"), ("b", "Red blue")], "side string, text string")
    assert {r.token: (r.a, r.b, r.label) for r in reports.token_support(sides, "side", "text", ["red", "blue", "x"]).collect()} == {"red": (2, 1, "more in a"), "blue": (0, 1, "more in b"), "x": (0, 0, "equal")}
    assert tuple(reports.predicate_coverage(sides, "text", ["red", "green"]).first()) == (0.5, True)
    assert reports.next_id(spark.range(3), "id").first().next_id == 3 and reports.next_id(spark.range(0), "id").first().next_id == 1
    assert not reports.all_passed(spark.createDataFrame([(True,), (False,)], "p boolean"), "p").first().passed


def test_phrases_are_longest_from_the_left(spark):
    texts = spark.createDataFrame([(1, "The big red ball hit a red ball, big red ball")], "id int, text string")
    terms = spark.createDataFrame([("red ball",), ("big red ball",), ("ball",), ("hit",)], "term string")
    got = [(r.pos, r.phrase, r.head, r.modifiers) for r in reports.phrases(texts, "id", "text", terms).orderBy("pos").collect()]
    assert got == [(1, "big red ball", "ball", ["big", "red"]), (4, "hit", "hit", []), (6, "red ball", "ball", ["red"]), (10, "ball", "ball", [])]


def test_linear_systems(spark):
    rows = [(1, [[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0]), (2, [[1.0, 1.0], [2.0, 2.0]], [1.0, 2.0])]
    got = {r.id: r.x for r in reports.solve_linear(spark.createDataFrame(rows, "id int, a array<array<double>>, b array<double>")).collect()}
    assert [round(x, 9) for x in got[1]] == [0.8, 1.4] and got[2] is None


def test_terms_with_marks_are_no_patterns(spark):
    texts = spark.createDataFrame([("a", "axb a.b c++"), ("b", "C++ c++")], "side string, text string")
    assert {r.token: (r.a, r.b) for r in reports.token_support(texts, "side", "text", ["a.b", "c++"]).collect()} == {"a.b": (1, 0), "c++": (1, 2)}
    assert {r.term: r.n for r in lookup.occurrences(texts, "text", ["a.b", "c++", "("]).collect()} == {"a.b": 1, "c++": 3, "(": 0, None: 4}


def test_known_part_gives_a_row_for_each_row(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "red blue red"), (1, "red"), (2, ""), (None, "blue x y")], "id int, text string")
    words = spark.createDataFrame([("red",), ("x",), (None,)], "word string")
    want = [(None, round(1 / 3, 6)), (1, round(2 / 3, 6)), (1, 1.0), (2, 1.0)]
    get = lambda: sorted(((r.id, round(r.known_part, 6)) for r in lookup.known_part(texts, "id", "text", words).collect()), key=str)
    assert get() == sorted(want, key=str)
    monkeypatch.setattr(lookup, "LITERAL_WORDS", 1)
    assert get() == sorted(want, key=str)
    assert [r.known_part for r in lookup.known_part(texts, "id", "text", words.limit(0)).collect()].count(1.0) == 1


def test_pairs_alike_by_what_both_lack(spark):
    """Brute force over all pairs: texts without words of a kind are alike in it."""
    texts = ["red ball", "", "red game running and so", "motion and running", "the and", "ball game", "motion", "xyz", "xyz and", "compute red", "running", "however motion running"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = df.select("id", sets.profile(F.col("text")).alias("p"))
    every = p.alias("x").crossJoin(p.alias("y")).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), sets.percent_similarity(F.col("x.p"), F.col("y.p")).alias("percent")).collect()
    for least in (4.0, 20.0, 21.0, 50.0, 81.0, 100.0):
        got = {(r.a, r.b): round(r.percent, 6) for r in relations.similar_pairs(df, "id", "text", least).collect()}
        assert got == {(r.a, r.b): round(r.percent, 6) for r in every if r.percent >= least}


def test_pairs_of_frequent_keys_are_spread(spark, monkeypatch):
    rows = [(i, f"k{i % 3}") for i in range(40)] + [(i, "all") for i in range(0, 40, 2)] + [(99, "one")]
    want = sorted((a, b, k) for a, k in rows for b, j in rows if a < b and j == k)
    for spread in (2_000, 3):
        monkeypatch.setattr(relations, "SPREAD_ROWS", spread)
        assert sorted(map(tuple, relations.met_pairs(spark.createDataFrame(rows, "id int, k string")).collect())) == want


def test_relations_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("red red blue ball game far away from sun moon star".split()) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    t = df.select("id", text.tokenize(F.col("text")).alias("t"))
    every = t.alias("x").crossJoin(t.alias("y")).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), relations.relation(F.col("x.t"), F.col("y.t")).alias("relation")).filter("relation <> 'distinct'").collect()
    assert sorted(map(tuple, relations.relations(df, "id", "text").collect())) == sorted(map(tuple, every)) and len(every) > 100


def test_keywords_in_the_row(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta the an epsilon zeta eta theta".split()) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(99, None)]
    want = set()
    for i, t in rows:
        words = [w for w in (t or "").split() if w not in ("the", "an")]
        counts = sorted(set(words), key=lambda w: (-words.count(w), words.index(w)))[:6]
        want |= {(i, w, words.count(w), at) for at, w in enumerate(counts, 1)}
    assert {tuple(r) for r in match.keywords(spark.createDataFrame(rows, "id int, text string"), ["id"], "text").collect()} == want


def test_equations_in_words(spark):
    said = ["2x + 3y = 5, x - y = 0", "x = 1", "x + y = 2", "x*x = 1", "a = b, b = 2.5", "nothing", None, "0x = 1"]
    got = [r.solution for r in reports.solve_equations(spark.createDataFrame(list(enumerate(said)), "i int, t string").coalesce(1), "i", "t").collect()]
    assert [None if g is None else {k: round(v, 9) for k, v in g.items()} for g in got] == [{"x": 1.0, "y": 1.0}, {"x": 1.0}, None, None, {"a": 2.5, "b": 2.5}, None, None, None]


def test_six_digits(spark):
    values = [0.5, 1234567.0, 0.00001234567, 100.0, -2.0, 123456.4, 0.1 + 0.2, 1e20, 0.0]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(mathexpr.shown(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:.6g}" for v in values]
