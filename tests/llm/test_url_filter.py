import random
import re

from lexiqua.llm import url_filter as u

SCHEMA = "page_id long, url string, host int, rule string, extra string"


def rows_of(spark, urls, **more):
    pages = spark.createDataFrame([(i, x, 1, "r", "e") for i, x in enumerate(urls)], SCHEMA)
    out = u.judge(pages, **more)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    return [tuple(r)[3:] for r in out.orderBy("page_id").collect()]


def test_rules_of_the_contract(spark):
    urls = ["https://A.Example.COM/en/7x?q", "http://example.com/en/8", "http://examplecom/en/1", "http://com/en/", "http://x.net/de/8", "http://example.net/de/8", "http://x.org/es/1#a", "http://x.org/ES/1", "http://x.org?/es/", None, "no scheme", "http://", "http://example.com", "ftp://h/x://y/en/", "http://a.b.example.net/de/81", "http://m.casino-win.org/de/", "http://x.org/casino"]
    got = rows_of(spark, urls)
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [g[2:] for g in got[1:9]] == [("com/en/", "block"), (None, "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow")]
    assert got[8][:2] == ("x.org", "") and got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12][:2] == ("example.com", "")
    assert got[13][:2] == ("h", "/x://y/en/") and got[14][2] == "example.net/de/8" and got[15][3] == "block" and got[16][3] == "allow"


def test_each_rule_has_the_word_of_the_contract(spark):
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{word} {rule}" for rule, word in u.HOST_RULES] == said.split(", ")
    # The rule's word decides over the globs, and the longer rule over the shorter.
    urls = ["http://net/de/", "http://m.casino.net/de/1", "http://example.net/de/7", "http://example.net/de/8", "http://a.com/en/7", "http://org/es/"]
    assert [g[3] for g in rows_of(spark, urls)] == ["allow", "allow", "allow", "block", "block", "block"]
    assert "WHEN rule = 'net/de/' THEN 'allow'" in u.ORACLES["op8_url_filter"]


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    text = lambda n, more="": "".join(rng.choice("ab./z" + more) for _ in range(n))
    globs = [text(rng.randint(0, 7), "*?") + rng.choice(["", "**", "*"]) for _ in range(120)]
    texts = [text(rng.randint(0, 12)) for _ in range(400)] + ["a" * 5000]
    found = u.Automaton(globs).fits([t.encode() for t in texts])
    for j, g in enumerate(globs):
        want = re.compile(u._regex(g))
        assert [bool(want.match(t)) for t in texts] == found[:, j].tolist(), g


def test_no_rows_and_no_rules(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, ["http://com/en/"], host_rules=(), globs=()) == [("com", "/en/", None, "allow")]


def test_very_long_urls(spark):
    urls = ["http://" + "a" * 300_000 + "-pills.b", "http://x.com/" + "a" * 300_000, "http://y.com/en/" + "b" * 300_000]
    assert [g[3] for g in rows_of(spark, urls)] == ["block", "allow", "block"]
