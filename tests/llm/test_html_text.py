import html
import random
import re

from lexiqua.llm import html_text as h

SCHEMA = "page_id long, url string, html string, text int, host string"


def texts(spark, rows):
    out = h.extract(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    got = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_deleted"] and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got} if len(got) == len({r[0] for r in rows}) else [r.text for r in got]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav>
<!-- ad <p>x</p> --><div class="ad">Buy</div><article><header><h1>Title &amp; more</h1></header><p><b>One<br>two &nbsp; three<p class=x>Four <i>five</i>, s<b>i</b>x</p><ul><li>a<li>b</ul>
<div class="share-buttons">Share</div><form>Mail <input name=q></form><aside>Side</aside><p>x &lt; y<section id="comments"><p>Nice!</p></section></article><footer>&copy; F</footer></body>"""


def test_article_of_a_page(spark):
    want = "Title & more\n\nOne two three\n\nFour five, six\n\na\n\nb\n\nx < y"
    assert texts(spark, [(1, "http://a/1", PAGE), (2, "http://a/2", PAGE), (3, None, None), (4, "x", ""), (5, "http://b/", "plain <b>text"), (6, "http://c/", "a < b <p>cut <a hre")]) == {1: want, 2: want, 3: "", 4: "", 5: "plain text", 6: "a < b\n\ncut"}


def test_shared_lines_go_where_markup_tells_nothing(spark):
    page = lambda *own: "<body><div>Home</div><div>About us</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>All rights reserved</div></body>"
    rows = [(1, "http://a/n/1", page("first story", "it goes on")), (2, "http://a/n/2", page("second story", "and ends")), (3, "http://a/z", page("third")), (4, "http://other/", page("alone"))]
    got = texts(spark, rows)
    assert got[1] == "first story\n\nit goes on" and got[2] == "second story\n\nand ends" and got[3] == "third"
    assert got[4] == "Home\n\nAbout us\n\nalone\n\nAll rights reserved"


def test_copies_keep_their_text(spark):
    page = "<body><div>a b</div><div>c d</div></body>"
    assert texts(spark, [(1, "http://a/1", page), (1, "http://a/1", page)]) == ["a b\n\nc d"] * 2
    assert texts(spark, []) == {}


def test_a_large_template_goes_and_copies_pair_with_the_next_that_differs(spark):
    page = lambda *own: "".join(f"<div>Menu {i}</div>" for i in range(20)) + "".join(f"<div>{x}</div>" for x in own)
    rows = [(1, "http://a/1", page("w", "x", "y", "z")), (2, "http://a/2", page("one")), (3, "http://a/3", page("one")), (4, "http://a/4", page("one")), (5, "http://b/1", page("p")), (6, "http://b/2", page("p")), (7, "http://b/3", page("q"))]
    assert texts(spark, rows) == {1: "w\n\nx\n\ny\n\nz", 2: "one", 3: "one", 4: "one", 5: "p", 6: "p", 7: "q"}


def plain(html):
    return "\n\n".join(t for state, t in h.lines_of(html) if state > h.NEVER)


def test_words_within_a_line_go_alone():
    assert plain('<article><p>a <span class="ad">x <div>y</div></span> b</p><p>c<span hidden>d') == "a b\n\nc"


def test_elements_without_words_end_with_their_parent():
    for name in h.NO_WORDS:
        assert plain(f"<article><div>a <{name}>x <b>y</div>b <p>c</article>") == "a\n\nb\n\nc"
        assert plain(f"<article>a <{name}>x <p>y</p> z</{name}>b <{name}/>c</article>") == "a b c"
    assert plain("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><text>y</text></svg><object>z</object> holds</article>") == "so x=1 yz holds"
    assert plain("<article>a<script>b</div>c</article>") == "a"


def test_names_count_as_a_whole():
    for name in ("share-price-report", "social-history", "comment-free", "banner-layout", "has-ads no-sidebar", "adhesive", "header-image"):
        assert plain(f'<article><div class="{name}">text</div></article>') == "text"
    for name in ("ad", "x AD-slot", "cookie-notice", "article-comments", "reader_comments", "sidebar left", "share-buttons"):
        assert plain(f'<div class="{name}">text</div><article>a<section id="{name.split()[0]}">text</section></article>' if name != "x AD-slot" else f'<p class="{name}">text</p>a') == "a"
    assert plain("<p>before</p><article>a</article><p>after</p>") == "before\n\na\n\nafter"


def brute(rows):
    """Pairs and differences by plain reading: a sorted list, a walk to each side, a table for each subsequence."""

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    pages = []
    for page_id, url, text in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        pages.append((host, path, page_id, url, [x for x in h.lines_of(text or "") if x[0] > h.NEVER]))
    pages.sort(key=lambda p: (p[0], p[1], p[2] is not None, p[2] or 0, p[3] is not None, p[3] or ""))
    out, lengths = {}, {}
    for i, (host, path, page_id, _url, lines) in enumerate(pages):
        sides = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(pages) and pages[j][0] == host and pages[j][4] == lines:
                j += step
            if 0 <= j < len(pages) and pages[j][0] == host:
                sides.append(pages[j])
        sides.sort(key=lambda p: -next((k for k, (a, b) in enumerate(zip(p[1], path)) if a != b), min(len(p[1]), len(path))))
        texts = [t for _, t in lines]
        shared = [h.common(texts, [t for _, t in p[4]]) for p in sides]
        for s, p in zip(shared, sides, strict=True):
            assert sum(s) == lcs(texts, [t for _, t in p[4]])
        size = lambda some: sum(len(t.split()) for (state, t), x in zip(lines, some, strict=True) if x and state == h.IN_ARTICLE)
        copy = any(2 * size(s) > size([True] * len(lines)) for s in shared)
        keep = [not (shared and shared[0][k]) if state != h.IN_ARTICLE else not (len(shared) == 2 and not copy and shared[0][k] and shared[1][k]) for k, (state, _) in enumerate(lines)]
        out[page_id] = "\n\n".join(t for t, k in zip(texts, keep, strict=True) if k)
        lengths[page_id] = len(lines) - sum(keep)
    return out, lengths


def site():
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta".split())
    rows = []
    for i in range(300):
        host = rng.choice(["hot.com"] * 5 + ["b.org", "C.net", "alone.com"][: 3 if i == 0 else 2])
        body = [f"<div>{x}</div>" for x in ("Home", "News", f"Page {word()}")] + [f"<p>{word()} {i % 7}</p>" for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.6:
            body.append("<article>" + "".join(f"<p>{rng.choice([f'own words of page {i} here', 'Subscribe now', word()])}</p>" for _ in range(rng.randint(1, 6))) + "</article>")
        rng.shuffle(body)
        rows.append((i, f"http://{host}/{rng.choice('ab')}/{rng.randrange(40)}", "".join(body) + "<footer>f</footer>"))
    copies = [(1000 + i, f"https://hot.com/a/{i % 5}", rows[3][2]) for i in range(60)]
    return rows + copies + [(2000, None, None), (2001, "x", "<p>lone"), (2002, "", "<p>lone"), (2003, "http://empty.com/", ""), (2004, "http://empty.com/a", "<p>t")]


def test_pairs_and_differences_against_brute_force_in_any_number_of_ranges(spark):
    rows = site()
    want, n = brute(rows)
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for ranges in (1, 7, 50, 400):
        got = h.extract(docs, ranges).collect()
        assert {r.page_id: r.text for r in got} == want and {r.page_id: r.n_deleted for r in got} == n and len(got) == len(rows)
    assert sum(n.values()) > 300


def test_a_long_page(spark):
    page = lambda own: "<div>Menu</div>" + "".join(f"<p>{own} {i}</p>" for i in range(30_000)) + "<div>End</div>"
    got = texts(spark, [(1, "http://a/1", page("x")), (2, "http://a/2", page("y")), (3, "http://a/3", "<div>Menu</div><div>End</div>")])
    assert got[3] == "" and got[1].count("\n\n") == 29_999 and got[1].startswith("x 0\n\n")


def test_subsequence_is_longest():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = [x for x, s in zip(a, h.common(a, b), strict=True) if s]
        assert len(kept) == table[-1][-1]
        it = iter(b)
        assert all(x in it for x in kept)


def test_table_against_a_plain_reading(spark, sf_dir):
    """All pages here have one article of h1 and p; a regular expression finds its blocks, and the brute force says which go."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    want, n = brute(rows)
    got = {r.page_id: r.text for r in h.op6_html_text(spark, sf_dir).collect()}
    assert got == want
    for page_id, _, page in rows:
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")))
        whole = list(filter(None, blocks))
        assert len(whole) - n[page_id] == len(got[page_id].split("\n\n")) and (n[page_id] or got[page_id] == "\n\n".join(whole))


def test_hostile_markup_is_read_in_time():
    for x in ("<a " * 20000, "<!-- " * 20000, "<p" * 20000, "<div>" * 20000, "&amp" * 20000, '<a href="' * 5000, "<script>" * 3000):
        h.lines_of(x)
