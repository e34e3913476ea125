import random
import re
from collections import Counter

import pytest

from lexiqua.llm import unit_dedup as u

SCHEMA = "doc_id long, text string, removed int, start string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def normal(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))


def cut_up(text, unit):
    if unit == "sentence":  # one character at a time, unlike the operator
        out, i, text = [""], 0, text or ""
        while i < len(text):
            c, i = text[i], i + 1
            if c == "\n":
                out.append("")
                continue
            out[-1] += c
            if c in ".!?…。！？":
                j = i
                while j < len(text) and " " < text[j] < "\x80" and not text[j].isalnum():
                    j += 1
                if j < len(text) and text[j] in " \t\x0b\x0c\r":
                    out[-1] += text[i:j]
                    out.append("")
                    i = j + 1
        return out
    return (text or "").split({"line": "\n", "paragraph": "\n\n"}[unit])


def brute(rows, least, unit="line"):
    gap = 2 if unit == "paragraph" else 1
    seen, removed, texts = {}, [], {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        doc_id, text = rows[i]
        at, found, run, gone = 0, [], [], set()

        def close():
            if (n := sum(x[4] for x in run)) >= least:
                removed.extend((*x[:5], n, *x[5:]) for x in run)
                gone.update(x[1] for x in run)
            run.clear()

        for no, part in enumerate(cut_up(text, unit)):
            key = normal(part)
            found.append((no, part))
            if key:
                first = seen.setdefault(key, (i, doc_id, at))
                if first[0] == i and first[2] == at:
                    close()
                else:
                    run.append((doc_id, no, at, at + len(part), len(key.split()), *first[1:]))
            at += len(part) + gap
        close()
        texts[i] = [x for no, x in found if no not in gone]
    return sorted(removed, key=str), texts


def corpus():
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["Ab", "é", "CD", "x", "3.5"]) + str(rng.randrange(9)) for _ in range(n))
    lines = [words(rng.randint(1, 4)) + rng.choice([".", "!", '."', ".) ", ""]) for _ in range(30)]
    rows = []
    for i in range(60):
        picked = [rng.choice(lines) for _ in range(rng.randint(1, 9))]
        rows.append((i, "".join(x.replace(" ", rng.choice([" ", "\t ", "  "])) + rng.choice([" ", "\n", "\n\n", "\t"]) for x in picked)))
    return rows + [(None, rows[0][1]), (100, None), (101, ""), (102, "\n\n"), (7, rows[7][1]), (7, rows[7][1]), (103, rows[2][1].upper()), (104, "a. " * 3000), (105, "b" * 200_000)]


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_repeats_against_brute_force(spark, unit):
    rows = corpus()
    got = u.repeats(frame(spark, rows), 5, unit).select("doc_id", "unit_no", "start", "end", "n_words", "run_words", "first_doc_id", "first_start")
    want = brute(rows, 5, unit)[0]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 5


def test_frequent_units_are_found_alike(spark, monkeypatch):
    rows, columns = corpus(), ["doc_id", "unit_no", "start", "end", "n_words", "run_words", "first_doc_id", "first_start"]
    monkeypatch.setattr(u, "HOT_UNITS", 5)
    assert sorted((tuple(r) for r in u.repeats(frame(spark, rows), 5).select(columns).collect()), key=str) == brute(rows, 5, "sentence")[0]


@pytest.mark.parametrize("unit", ["sentence", "line"])
def test_text_without_repeats(spark, unit):
    rows = corpus()
    out = u.deduplicated(frame(spark, rows), 5, unit)
    assert [c for c in out.columns if c != "removed"] == ["doc_id", "text", "start", "a.b"]
    out = out.collect()
    got = Counter(x.strip() for r in out for x in cut_up(r.text, unit) if x.strip())
    removed, texts = brute(rows, 5, unit)
    assert got == Counter(x.strip() for kept in texts.values() for x in kept if x.strip())
    spans = sorted((r.doc_id if r.doc_id is not None else -1, s["start"]) for r in out for s in r.removed)
    assert spans == sorted((d if d is not None else -1, s) for d, _, s, *_ in removed)


def test_a_passage_goes_however_it_is_broken_and_a_stock_line_stays(spark):
    say = [f"{w} of this passage has {w} words to say." for w in ("one", "two", "six", "ten")]
    stock = "Share this page with all of your friends now and then again in ten words or a few more."
    rows = [(1, " ".join(["Before it."] + say)), (2, "New text stands here and\n" + "\n".join(say) + " And on it goes."), (3, stock + "\nown words"), (4, stock + "\nother words")]
    assert len(stock.split()) < u.LEAST_WORDS
    got = {r.doc_id: r.text for r in u.deduplicated(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "New text stands here and\nAnd on it goes.", 3: rows[2][1], 4: rows[3][1]}


def test_no_rows(spark):
    for unit in u.BREAKS:
        assert u.repeats(frame(spark, []), unit=unit).count() == 0
    assert u.deduplicated(frame(spark, [])).count() == 0
