from pyspark.sql import functions as F

from lexiqua.plans import responses
from lexiqua.sources import notes

ENTRIES = "file string, key string, senses array<struct<gloss:string,synonyms:array<string>>>"


def taxa(spark, *prompts):
    rows = [("geometry.json", "area square", [("area = s * s", ["quadrate"])]), ("code_dictionary.json", "square root", [("a function", None), ("the square of it", None)]), ("physics.json", "electron", [("an electron with a charge", [])])]
    asked = spark.createDataFrame(list(enumerate(prompts)), "prompt_id int, prompt string")
    return responses.analysis(spark, asked, spark.createDataFrame(rows, ENTRIES))


def test_each_prompt_has_its_own_answer(spark):
    found = taxa(spark, "what is a square", "the electron", "nothing here")
    got = {r.prompt_id: r for r in responses.computed(responses.respond(found), {"s": "3D"}).collect()}
    assert set(got) == {0, 1} and got[0].topic == "geometry" and got[1].main.variable == "electron"
    assert got[1].response.startswith("Focusing on science → physics → atomic,\n\nthe concept 'electron' resolves to entry.") and "Clarifiers: electron: an electron with a charge" in got[1].response
    assert got[0].main.variable == "areasquare" and got[0].computed == 9.0 and got[1].computed is None


def test_variations_give_as_many_as_asked(spark):
    found = taxa(spark, "what is a square", "the electron")
    for kind in ("conditional", "poetic", "plain"):
        for reverse in (False, True):
            rows = responses.variations(found, 5, kind, reverse=reverse).collect()
            assert sorted((r.prompt_id, r.step) for r in rows) == [(p, s) for p in (0, 1) for s in range(5)] and all(r.text.startswith("Variation ") for r in rows)
    assert responses.variations(found.limit(0), 3).count() == 0 and responses.respond(found.limit(0)).count() == 0


def test_cover_of_fragments(spark):
    get = lambda *x: spark.range(1).select(responses.novelty_cover(F.array(*map(F.lit, x))).alias("c")).first().c
    assert get("a cat", "a big cat", "dog", "cat dog", "") == ["a big cat", "cat dog"] and get("x y") == ["x y"]


def test_notes_are_rewritten_and_a_store_is_kept(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("one\ntwo\nthree\n")
    doc = lambda i, path: {"id": i, "path": path, "range": {"start": 2, "end": 9}, "title": "t", "tags": [], "notes": [], "text": "old"}
    import json

    (tmp_path / "n.json").write_text(json.dumps({"schema_version": 1, "documents": [doc("x", "src/a.py"), doc("y", "no_such_file.py")]}))
    data = notes.refresh(spark, str(tmp_path / "n.json"), str(tmp_path))
    assert [d["text"] for d in data["documents"]] == ["two\nthree", "old"] and len(data["_refresh_errors"]) == 1 and data["generated_at"].endswith("+00:00")
    assert json.loads((tmp_path / "n.json").read_text()) == data
    path = str(tmp_path / "pending.json")
    (tmp_path / "bad.json").write_text("{bad json")
    assert notes.load_pending(spark, path).count() == 0 and (tmp_path / "pending.json").read_text() == "[]" and notes.load_pending(spark, str(tmp_path / "bad.json")).count() == 0
