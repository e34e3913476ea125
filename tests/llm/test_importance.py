import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from lexiqua.llm import importance as m

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def buckets(text, n=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[j : j + k]).encode()) % n for k in (1, 2, 3) for j in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20):
    """Rows of (doc_id, n_features, weight, score, rank), by plain counting."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x))
    for x in target:
        t.update(buckets(x))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        f = buckets(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000.0) / ((s[b] + 1.0) * (T + 10_000.0)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {r[0]: n for n, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*r[:4], drawn.get(r[0])) for r in rows), key=str)


def run(spark, docs, target, **more):
    d = spark.createDataFrame([(i, x, "x", 7) for i, x in docs], "doc_id long, text string, digest string, weight int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted(map(tuple, m.resampled(d, t, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_hashes_of_runs():
    texts = ["Hello, World foo-bar 12 é x", "", "a", "a b", "!!!", "long " + "w" * 5000 + " end x y", "Ünï çode 漢字 ÄÖ"]
    values, first, n = m.run_hashes(pa.array(texts))
    for i, text in enumerate(texts):
        w = words(text)
        assert values[first[i] : first[i + 1]].tolist() == [zlib.crc32(" ".join(w[j : j + k]).encode()) for k in (1, 2, 3) for j in range(len(w) - k + 1)] and n[i] == len(w)


def test_table_by_brute_force_and_sql(spark, sf_dir):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), [x for (x,) in read("benchmark", "text")])
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, m.op13_importance(spark, sf_dir).select(*columns).collect()), key=str) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(con.sql(m.ORACLES["op13_importance"]).select(", ".join(columns)).fetchall(), key=str) == want


@pytest.mark.parametrize("hot", [100, 3])
def test_copies_nulls_and_long_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT_COPIES", hot)
    stock = " ".join(f"stock{i % 7}" for i in range(30))
    docs = [(i, stock) for i in range(40)] + [(100, None), (101, ""), (102, "?! ..."), (103, "one Two"), (104, "word " * 60_000), (None, " ".join(map(str, range(25))))]
    target = [stock, None, "", "word word"]
    assert run(spark, docs, target, percent=20) == brute(docs, target, percent=20)


def test_repeated_rows_have_ranks_each(spark):
    text = " ".join(map(str, range(30)))
    rows = run(spark, [(1, text)] * 10, ["0 1 2"], percent=50)
    assert sorted((r[4] for r in rows), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5] + [None] * 5 and len({r[:4] for r in rows}) == 1


def test_empty_tables(spark):
    assert run(spark, [], ["a b c"]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
