import random
import re

import numpy as np
import pytest

from lexiqua.llm import jaccard_join as j

SCHEMA = "doc_id long, text string, n int, uid string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if find(x) == find(i) and rows[x][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in j.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, docs=60, copies=6):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    rows, i = [], 0
    common = [rng.choice(words) for _ in range(25)]
    for _ in range(docs):
        base = [rng.choice(words) for _ in range(rng.choice((1, 2, 3, 8, 11, 14, 20, 22, 24, 30, 60, 150)))]
        if rng.random() < 0.4:
            base += common
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.5:
                t += [rng.choice(words) for _ in range(rng.randint(0, 2))]
            rows.append((i, rng.choice((" ", "\n ", "\t")).join(t)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed) + [(None, "a b c"), (9000, "A B c"), (9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (3, "again and again"), (None, "only null"), (9004, "one")]
        assert run(spark, rows) == brute(rows)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):  # some in reach of each other only through others
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[: 100 + i % 25])) for i in range(80)]
    old = j.BLOCK
    j.BLOCK = 100
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        j.BLOCK = old


def test_boundary_follows_cost():
    assert j.boundary({}, 90) == 0
    assert j.boundary({9: 100, 20: 1000}, 90) < 20 <= j.boundary({20: 1000}, 90) + 20
    assert j.needed(10, 9, 90) == 9 and j.needed(20, 20, 90) == 19 and list(j.partners(10, 90)) == [9, 10, 11]


def test_block_links_are_a_forest():
    rng = np.random.default_rng(0)
    items = [np.unique(rng.integers(0, 40, 30)) for _ in range(80)]
    sizes = np.array([len(x) for x in items])
    u, v = j._block_links(sizes, items, 60)
    assert len(u) < 80 and len(set(u.tolist())) == len(u)
    same = lambda a, b: 160 * len(np.intersect1d(items[a], items[b])) >= 60 * (sizes[a] + sizes[b])
    label = np.arange(80)
    label[u] = v
    for a in range(80):
        for b in range(a):
            assert not same(a, b) or label[a] == label[b]


def test_one_of_each(spark):
    rows = corpus(4, docs=20) + [(3, "again and again it goes"), (5000, None), (5001, "")]
    docs = frame(spark, rows)
    out = j.one_of_each(docs)
    want = {c for _, n, c in brute(rows) if n} | {5000, 5001}
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_no_rows(spark):
    assert run(spark, []) == [] and j.one_of_each(frame(spark, [])).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from lexiqua.llm import components as c

    rng = random.Random(11)
    links = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(59, 200), (200, 101)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = list(range(400))
    for a, b in links * 400:
        root[a] = root[b] = min(root[a], root[b])
    want = {i: r for i, r in enumerate(root) if r != i}
    for hub in (5, 40, 10_000):
        monkeypatch.setattr(c, "HUB_LINKS", hub)
        assert {r.id: r.label for r in c.components(spark.createDataFrame(links, "u long, v long")).collect()} == want


@pytest.mark.parametrize("percent", [40, 50, 64, 65, 75])
def test_lower_similarities(spark, percent):
    """The part of all hashes that a prefix may need reaches half of them here."""
    rows = corpus(7, docs=25, copies=4)
    got = sorted((tuple(r) for r in j.jaccard_components(frame(spark, rows), 3, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, percent)


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "x y z"), (3, "x y z"), (4, "x y z q"), (None, "x y z")]
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, _id int, _th int, _row int, _i int, _x int, _twice int, _least int, th int")
    out = j.one_of_each(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text, r._id, r.th) for r in out.collect()) == [(1, "a b c d", 0, 7), (3, "x y z", 0, 7), (4, "x y z q", 0, 7)]


def test_a_very_long_text(spark):
    """A text of 60 000 words, its copy, and one that lacks a twentieth of it."""
    rng = random.Random(11)
    long = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(long[3_000:])), (4, " ".join(long[30_000:])), (5, "w1")]
    assert run(spark, rows) == brute(rows)


def test_stock_passages_gather_no_documents(spark, monkeypatch):
    """Different texts that share a passage are not compared as one large group."""
    rng = random.Random(11)
    stock = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) + " " + stock) for i in range(300)]
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]
    gathered, plain = [], j._blocked

    def counted(sets, groups, percent):
        gathered.append(groups.count())
        return plain(sets, groups, percent)

    monkeypatch.setattr(j, "_blocked", counted)
    assert run(spark, rows) == brute(rows)
    assert gathered[0] < 60


def test_pairs_of_short_and_long_lists(spark, monkeypatch):
    """Near copies that meet once in a short list, and else in lists that are long."""
    monkeypatch.setattr(j, "SHORT_LIST", 3)
    rows = corpus(5, docs=20, copies=7)
    assert run(spark, rows) == brute(rows)
