import hashlib
import random
import re

from pyspark.sql import functions as F

from lexiqua.llm import decontaminate as d

SCHEMA = "doc_id long, text string, items string, spans int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item_id, item in bench:
            x = words(item)
            m = min(10, len(x))
            for s in range(len(x) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[s : s + m]:
                        hit |= set(range(p, p + m))
                        items.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, bench, **more):
    frame = d.match(spark.createDataFrame([(a, b, "x", 1) for a, b in docs], SCHEMA), spark.createDataFrame(bench, "item_id long, text string"), **more)
    got = frame.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.expr("n_hit > 0"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def cases():
    rng = random.Random(5)
    bench = [(i, " ".join(rng.choice("ab cd Ef gé h1".split()) for _ in range(n))) for i, n in enumerate((12, 10, 3, 25, 40, 1, 0))] + [(9, None), (3, "x y z")]
    docs = [(i, " ".join(rng.choice("ab cd ef GÉ gé h1, zz".split()) for _ in range(rng.choice((0, 2, 30, 200))))) for i in range(40)]
    docs += [(100, "zz " + bench[3][1] + "! " + bench[4][1].upper() + " zz"), (100, None), (None, bench[0][1]), (101, bench[0][1] + "\x00" + bench[0][1])]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = cases()
    assert run(spark, docs, bench) == brute(docs, bench)
    assert run(spark, docs, bench[:2]) == brute(docs, bench[:2])  # no short test text


def test_blocks_agree(spark):
    docs, bench = cases()
    assert run(spark, docs, bench, block_words=20) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = cases()
    assert run(spark, [], bench) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_spans_are_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(5, 25)) + " c")], "doc_id long, text string")
    spans = d.match(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()["spans"]
    assert [tuple(s) for s in spans] == [("7", 5, 2, 20)]
    assert d.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 0


def test_a_document_begins_where_the_test_text_has_an_unknown_word(spark):
    item = "unknown " + " ".join(f"w{i}" for i in range(12)) + " another"
    docs = [(1, " ".join(f"w{i}" for i in range(12))), (2, " ".join(f"w{i}" for i in range(12)) + " end"), (3, "w1 w2")]
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 5, 7, "s"), (2, "x y z", "other", 6, 8, "t"), (3, None, None, None, None, None)], "doc_id long, text string, items string, n_words int, n_hit int, spans string")
    out = d.decontaminate(docs, spark.createDataFrame([(1, "x y z")], "item_id long, text string"))
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == [(1, "a b c", "mine", 5, 7, "s"), (3, None, None, None, None, None)]


def test_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(500))
    docs = [(1, "the " * 700_000 + item + " the" * 1000)]
    got = d.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "the " * 9)], "item_id long, text string")).first()
    assert (got.n_words, got.n_hit, got["items"]) == (701_500, 701_500, ["1", "2"]) and max(s["n_words"] for s in got.spans) == 500
