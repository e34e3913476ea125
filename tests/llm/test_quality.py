import random
import re
import string
from collections import Counter, defaultdict

from lexiqua.llm import quality as q

SCHEMA = "doc_id long, text string, source string, n_chars long, lines int, hash string, kept int, removed_lines string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, "y", 3) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def normal(line):
    folded = ("".join("0" if c in "0123456789" else c.lower() if "A" <= c <= "Z" else c for c in w if ord(c) > 127 or c in string.ascii_letters + string.digits) for w in words(line))
    return " ".join(w for w in folded if w)


def brute(rows, limit_docs, limit_share):
    known, holders, hosts = {}, defaultdict(set), defaultdict(set)
    for i, (_, text, source) in enumerate(rows):
        lines = [normal(x) for x in (text or "").split("\n")]
        known[i] = frozenset(filter(None, lines))
        hosts[source].add(known[i])
        for x in filter(None, lines):
            holders[source, x].add(known[i])
    out = []
    for i, (doc_id, text, source) in enumerate(rows):
        w, lines = words(text), (text or "").split("\n")
        full = [x for x in lines if words(x)]
        windows = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
        c = Counter(windows)
        rep = len({p + j for p, x in enumerate(windows) if c[x] > 1 for j in range(5)})
        gone = [no for no, x in enumerate(lines) if normal(x) and (n := len(holders[source, normal(x)])) > limit_docs and n > limit_share * len(hosts[source])]
        stays = len(w) - sum(len(words(lines[no])) for no in gone)
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        kept = not failed and stays >= 10 and stays >= 0.1 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(full) - len(set(full)), rep, failed, tuple(gone), stays, kept))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["Ab", "cd,", "éf", "12", "#x", "--", "gh"]) + rng.choice(string.ascii_lowercase) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [text(rng.randint(0, 12)) for _ in range(rng.randint(1, 4))] + ["Share this page on 12 sites now please do it today!"] * (i % 2) + ["", " \t"] * (i % 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(100, "share THIS page, on 99 sites now please do it today", "a"), (101, None, "a"), (None, text(20), "b"), (102, "", "b"), (103, "a b c d e " * 400, "a"), rows[3], rows[3], (104, "x \n\n x\n x ", "c"), (105, "y\r\nz\x0b\x0cw", "c")]
    copy = text(30) + "\n" + text(15)
    return rows + [(200 + i, copy + f" {text(1)}", "a") for i in range(30)]


def run(spark, rows, **limits):
    got = q.judge(frame(spark, rows), **limits)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "kept_words", "kept")
    return sorted((tuple(tuple(r[c]) if c == "removed_lines" else r[c] for c in cols) for r in got.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    for limits in ({"limit_docs": 4, "limit_share": 0.05}, {"limit_docs": 0, "limit_share": 0.2}):
        assert run(spark, rows, **limits) == brute(rows, *limits.values())


def test_copies_are_not_boilerplate(spark):
    text = "one text of two lines and more than ten words\nits second line"
    rows = [(i, text, "a") for i in range(30)] + [(50, f"{text}\nand a third", "a")] + [(60 + i, f"own words {i // 10}", "a") for i in range(30)]
    got = {r.doc_id: r for r in q.judge(frame(spark, rows), limit_docs=4, limit_share=0.05).collect()}
    assert all(got[i].kept and got[i].removed_lines == [] for i in (*range(30), 50))


def test_cleaned_keeps_columns_and_other_lines(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = q.cleaned(docs, limit_docs=4, limit_share=0.05)
    assert out.columns == docs.columns
    verdict = {r.doc_id: r for r in q.judge(docs, limit_docs=4, limit_share=0.05).collect()}
    texts = {r[0]: r[1] for r in rows}
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows if verdict[r[0]].kept)
    for r in got:
        assert r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in verdict[r.doc_id].removed_lines) and r.n_chars == len(r.text)


def test_texts_that_are_all_short(spark):
    rows = [(i, "two words", "a") for i in range(9)]
    assert run(spark, rows) == brute(rows, q.LIMIT_DOCS, q.LIMIT_SHARE)


def test_no_rows(spark):
    assert run(spark, []) == [] and q.cleaned(frame(spark, [])).count() == 0


def test_a_notice_that_is_the_longest_line_is_counted_in_each_document(spark):
    notice = "by reading this page you agree to all of our terms and to the notice below"
    own = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)} has a story of its own told in ten words"
    rows = [(i, f"{notice}\n{own(i)}", "a") for i in range(100)] + [(200 + i, notice, "a") for i in range(5)]
    copies = [(300 + i, f"one text of two lines and more than ten words {'!' * i}\nits second line", "b") for i in range(30)]
    docs = frame(spark, rows + copies)
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    assert all(got[r[0]].removed_lines == [0] for r in rows) and not any(got[r[0]].removed_lines for r in copies)
    out = {r.doc_id: r.text for r in q.cleaned(docs).collect()}
    assert out == {i: own(i) for i in range(100)} | {d: t for d, t, _ in copies}
