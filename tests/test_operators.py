import json
import random

import pytest
from pyspark.sql import functions as F

from lexiqua.operators import intervals, lookup, match, relations
from lexiqua.plans import sessions
from lexiqua.sources import dictionaries, notes
from lexiqua.streaming import conversation


@pytest.fixture
def folder(tmp_path):
    files = {
        "physics.json": {"force": [{"gloss": "mass times acceleration", "formula": "F = m a", "exec": "lambda m, a: m * a", "synonyms": ["push"]}], "quark": {"gloss": "a small particle", "is a": "particle", "see also": ["gluon", "boson"]}, "plain": "just a text"},
        "history.json": {"war": {"gloss": "a long war", "start_year": 1914, "end_year": 1918}, "moon": {"year": 1969, "gloss": "landing"}, "Force": {"gloss": "later force"}},
        "listed.json": [{"gloss": "first"}, {"gloss": "second"}],
        "broken.json": None,
    }
    for name, value in files.items():
        (tmp_path / name).write_text("{bad json" if value is None else json.dumps(value))
    return str(tmp_path)


def test_dictionaries(spark, folder):
    entries = dictionaries.read_entries(spark, folder).cache()
    assert {(r.file, r.key) for r in entries.collect()} == {("physics.json", "force"), ("physics.json", "quark"), ("physics.json", "plain"), ("history.json", "war"), ("history.json", "moon"), ("history.json", "Force"), ("listed.json", "0"), ("listed.json", "1")}
    assert {r.key: r.senses[0].gloss for r in entries.collect()}["plain"] == "just a text"
    assert {r.term: r.file for r in dictionaries.subject_definitions(entries).collect()}["force"] == "physics.json"
    merged = {r.term: r for r in dictionaries.knowledge(entries).collect()}
    assert merged["listed"].definitions == ["first", "second"] and merged["force"].formulas == ["F = m a"] and merged["force"].sources == ["physics.json"]
    assert sorted(tuple(r) for r in dictionaries.relations(entries).collect()) == [("force", "synonyms", "push"), ("quark", "is a", "particle"), ("quark", "see also", "boson"), ("quark", "see also", "gluon")]
    assert sorted((r.key, r.start, r.end) for r in dictionaries.year_spans(entries).collect()) == [("moon", 1969, 1969), ("war", 1914, 1918)]


def test_matches_and_taxonomy(spark, folder):
    entries = dictionaries.read_entries(spark, folder)
    found = match.matches(entries, ["push", "force", "particle", ""])
    assert sorted((r.keyword, r.file, r.key, r.field) for r in found.collect()) == [("force", "history.json", "Force", "key"), ("force", "physics.json", "force", "key"), ("particle", "physics.json", "quark", "gloss"), ("push", "physics.json", "force", "synonym")]
    taxa = {(r.keyword, r.phylum): r for r in match.taxonomy(found).withColumn("score", match.score()).collect()}
    assert taxa["push", "physics"].value == "push" and taxa["push", "physics"].kingdom == "science" and taxa["particle", "physics"].type == "gloss" and taxa["force", "physics"].score == 4 and taxa["particle", "physics"].score == 3


def test_sessions(spark, folder, tmp_path):
    entries = dictionaries.read_entries(spark, folder)
    prompts = spark.createDataFrame([(1, "a small particle, which gives a push; force of war")], "prompt_id int, prompt string")
    items = sessions.create("one", sessions.analyze(spark, prompts, entries)).cache()
    assert items.count() > 3 and items.filter("rank = 1").first().score == items.agg(F.max("score")).first()[0]
    out = str(tmp_path / "saved")
    sessions.save(items, out)
    again = sessions.load(spark, out, "one")
    assert again.count() == items.count() and sessions.load(spark, out, "two").count() == 0
    explored = sessions.mark_explored(items, "force")
    assert sessions.alerts(explored, 0).filter("variable = 'force'").count() == 0 < sessions.alerts(items, 0).filter("variable = 'force'").count()
    assert sessions.lineage(items, "quark").first().phylum == "physics" and sessions.lineage(items, "none").count() == 0
    assert all(r.variable != "force" for r in sessions.chain(items, "force").collect())
    assert [r.step for r in sessions.conjecture(items, 4).orderBy("step").collect()] == [0, 1, 2, 3]
    assert sessions.conjecture(items.limit(0), 4).count() == 0


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(8)
    rows = lambda n: [(i, s := rng.randint(-50, 200), s + rng.randint(-2, 60)) for i in range(n)]
    a, b = rows(60), rows(40)
    frame = lambda r: spark.createDataFrame(r, "id int, start long, end long")
    got = sorted((r.id, r.b_id) for r in intervals.overlap_join(frame(a), frame(b), 25).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s <= e and t <= f and s <= f and t <= e)


def test_relations(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta epsilon"), (3, "zeta"), (4, "alpha beta x1 x2 x3 x4 x5"), (5, "alpha q1 q2 q3 q4 q5 q6"), (6, None)]
    got = {(r.a, r.b): r.relation for r in relations.relations(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert got == {(1, 2): "equal"}  # distinct ones are not listed
    pairs = {(r.a, r.b): r.percent for r in relations.similar_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert abs(pairs[1, 3] - 50) < 1e-9 and abs(pairs[1, 2] - 90) < 1e-9  # no predicates, participles or connectives in either


def test_lookups(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "k string, g int")
    assert {r.k: r.siblings for r in lookup.siblings(t, "g", "k").collect()} == {"a": ["b"], "b": ["a"], "c": []}
    first, second = spark.createDataFrame([("a", "1")], "k string, value string"), spark.createDataFrame([("a", "9"), ("b", "2")], "k string, value string")
    assert {r.k: (r.found, r.source) for r in lookup.cascade(t, "k", [("x", first), ("y", second)]).collect()} == {"a": ("1", "x"), "b": ("2", "y"), "c": (None, None)}


def test_notes(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "code.py").write_text("one\ntwo\nthree\n")
    doc = lambda i, path, a, b: {"id": i, "path": path, "range": {"start": a, "end": b}, "title": f"T{i}", "tags": ["x", i], "notes": ["n"], "text": "old"}
    file = tmp_path / "notes.json"
    file.write_text(json.dumps({"schema_version": 1, "repo": "r", "documents": [doc("a", "src/code.py", 2, 9), doc("b", "no_such_file.py", 1, 2)]}))
    docs = notes.load_notes(spark, str(file)).cache()
    assert [r.place for r in notes.listing(docs).orderBy("id").collect()] == ["src/code.py:2-9", "no_such_file.py:1-2"]
    assert notes.search(docs, "NO_SUCH").count() == 1 and {r.tag: r.n for r in notes.tag_counts(docs).collect()} == {"x": 2, "a": 1, "b": 1}
    fresh = {r.id: r for r in notes.refreshed(docs, notes.lines_of(spark, str(tmp_path))).collect()}
    assert fresh["a"].text == "two\nthree" and not fresh["a"].errors and fresh["b"].text == "old" and fresh["b"].errors
    assert [r.no for r in notes.matching_lines(notes.lines_of(spark, str(source)), "t").orderBy("no").collect()] == [2, 3]
    (tmp_path / "bad.json").write_text("{bad json")
    for path, says in (("bad.json", "not valid JSON"), ("none.json", "does not exist")):
        with pytest.raises(notes.NotesError, match=says):
            notes.load_notes(spark, str(tmp_path / path))
    layers = spark.createDataFrame([([("L1", [["a b", "c"], ["b"]]), ("L2", [["b"]])],)], "layers array<struct<name:string,actions:array<array<string>>>>")
    assert sorted((r.layer, r.para, r.line, r.new) for r in notes.planned_replacements(layers, "b", "x").collect()) == [("L1", 0, 0, "a x"), ("L1", 1, 0, "x"), ("L2", 0, 0, "x")]
    assert notes.planned_replacements(layers, "^b$", "x", True, "L1").count() == 1
    files = spark.createDataFrame([(0, "a", 60), (1, "b", 50), (2, "c", 40), (3, "d", 999)], "ord int, path string, size long")
    assert [r.path for r in notes.gathered(files, 100, 100).orderBy("no").collect()] == ["a", "c"]
    store = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert sorted(map(tuple, notes.upsert(store, spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_streamed_turns_are_those_of_the_batch(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    stream = spark.readStream.schema(turns.schema).option("pathGlobFilter", "conversations.parquet").parquet(sf_dir)
    q = conversation.stream_previous(stream).writeStream.format("memory").queryName("turns").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(((r.conv_id, r.turn, r.previous) for r in rows), key=str)
    assert key(spark.table("turns").collect()) == key(conversation.with_previous(turns).collect())


def test_windowed_counts_on_a_stream(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = conversation.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
