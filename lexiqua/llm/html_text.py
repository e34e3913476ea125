"""HTML extraction by nearest-URL page differencing.

A page becomes text lines (blocks). Markup leaves out only what is no text of a page's own kind: scripts, menus, headers, footers,
asides, forms and elements that are named, as a whole, as adverts, notices, comments and the like; and it tells which lines are in an
article. All other lines are decided by differencing. Pages are ordered by host and URL path. Those next to each other whose lines
are all equal are copies; a page's neighbours are the nearest pages of its host before and after it that are no copies of it, and
the one with the longer common path prefix is its pair. The lines of both are aligned by their longest common subsequence:

* a shared line goes;
* a shared line within an article goes if the other neighbour shares it, too (in the alignment of those two), and neither
  neighbour has more than half of the article's words: stock sentences recur in articles, templates recur on all pages.

Lines meet as hashes, so what is sorted is a few per cent of the pages. Rows with one order give the same pairs in any number of
partitions: the pages at the edges of a range are compared with those of the ranges next to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, parts_for, slices
from lexiqua.llm.url_filter import host_of, path_of

TEXT = "page_id long, url string, text string, n_chars long, n_deleted long"
#: A page's place, and its lines that aren't out by markup: their hashes, words and whether they are in an article.
LINES = "host string, path string, page_id long, url string, content long, told long, hashes array<long>, words array<int>, inside array<boolean>"
ORDER = ["host", "path", "page_id", "url", "content"]
#: Verdicts (about 60 bytes each) that may be broadcast; more are joined by a shuffle of the pages.
BROADCAST_ROWS = 1_000_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?:/?[a-zA-Z]|[!?/])[^<>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What holds raw text up to its end tag, or to the end of the page; and other elements whose words don't count.
RAW = frozenset("script style textarea title xmp".split())
NO_WORDS = frozenset("noscript iframe noembed noframes template audio video canvas select button".split())
NEVER_TEXT = frozenset("nav footer aside form head menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values. A value counts if it has one of these and all its others are of the second list, so
#: "cookie-notice" and "article-comments" do, and "share-price-report", "comment-free" and "has-ads" don't.
UNWANTED = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies pagination pager skip toolbar widget".split())
BESIDE = frozenset("article page post site reader user box block container wrapper wrap inner outer section area bar slot unit list item items button buttons icons links top bottom left right".split())
CONTENT = frozenset("article main".split())
#: What an open element closes when it starts again.
CLOSES = {"p": frozenset("p"), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
FENCE = frozenset("article main section div table ul ol dl aside nav footer header form body blockquote td th li".split())
#: Blocks before which an open paragraph ends.
ENDS_P = frozenset("div ul ol dl table section article blockquote pre form header footer aside nav main figure h1 h2 h3 h4 h5 h6".split())
IN_ARTICLE, UNDECIDED, NEVER, SKIPPED = 2, 1, 0, -1


def _verdict(name: str, attributes: str, inside: bool) -> int:
    """-1: nothing below is main text; 2: an article; 0: as around it."""
    if name in NEVER_TEXT or name == "header" and not inside:
        return -1
    values = {}
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            values[m[1].lower()] = unescape(m[2] or m[3] or m[4] or "").lower()
        if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role") in ROLES:
            return -1
        if name not in ("body", "html", "main"):
            for value in (values.get("class", "").split() + values.get("id", "").split()):
                words = _TOKEN.findall(value)
                if UNWANTED.intersection(words) and all(w in UNWANTED or w in BESIDE for w in words) and not (name == "article" and words[0] in CONTENT):
                    return -1
    if name in CONTENT or values.get("role") in ("main", "article") or "articlebody" in values.get("itemprop", ""):
        return IN_ARTICLE
    return 0


def lines_of(html: str) -> list[tuple[int, str]]:
    """The text lines of a page, each with what its markup says; scripts and the like have none."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter: name, state around them
    state, parts, at = UNDECIDED, [], 0

    def flush() -> None:
        if parts and state != SKIPPED:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append((state, text))
            parts.clear()

    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        if state != SKIPPED:
            parts.append(html[at : m.start() if m else end])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCKS
        if name in ("br", "hr") and state != SKIPPED:
            parts.append(" ")
        if m[1]:
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if state == SKIPPED and stack[i][1] != SKIPPED and i < len(stack) - 1:  # ended by its parent, whose line ends
                        state = next((x for _, x in reversed(stack[i + 1 :]) if x != SKIPPED), SKIPPED)
                    if state != SKIPPED and (block or stack[i][1] != state):
                        flush()
                    state = stack[i][1]
                    del stack[i:]
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
            if block:
                flush()
            continue
        if block and state != SKIPPED:
            flush()
            shut = CLOSES.get(name) or (CLOSES["p"] if name in ENDS_P else None)
            if shut:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut:
                        state = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] in FENCE:
                        break
        if name in VOID or name in NO_WORDS and m[3].endswith("/"):
            continue
        if name in NO_WORDS:
            stack.append((name, state))
            state = SKIPPED
            continue
        says = _verdict(name, m[3], state == IN_ARTICLE)
        if block or says:
            stack.append((name, state))
            if says < 0 and state > NEVER:
                state = NEVER if block else SKIPPED  # within a line, only the words in it go
            elif says == IN_ARTICLE and state > NEVER:
                flush()
                state = IN_ARTICLE
    if state == SKIPPED:
        state = next((s for _, s in reversed(stack) if s != SKIPPED), UNDECIDED)
    flush()
    return out


def common(a: list[str], b: list[str]) -> list[bool]:
    """Which of ``a`` are in a longest common subsequence of both: rows of the table as bits of whole numbers, kept to walk back."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid, other = a[lead : len(a) - tail], b[lead : len(b) - tail]
    at: dict[str, int] = {}
    for j, x in enumerate(other):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    rows, row = [], full
    for x in mid:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    shared, j = [False] * len(mid), len(other)
    length = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()
    for i in range(len(mid) - 1, -1, -1):
        before = rows[i - 1] if i else full
        here = length(rows[i], j)
        if here == length(before, j):
            continue
        shared[i] = True
        while length(rows[i], j - 1) == here:
            j -= 1
        j -= 1
    return [True] * lead + shared + [True] * tail


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deleted(page: dict, pair: dict, other: dict | None) -> list[int]:
    """The numbers of a page's lines that go, given its pair and its other neighbour (each with ``hashes``, ``words``, ``inside``)."""
    shared = [common(page["hashes"], x["hashes"]) for x in (pair, other) if x is not None]
    article = sum(n for n, i in zip(page["words"], page["inside"], strict=True) if i)
    copies = any(2 * sum(n for n, i, s in zip(page["words"], page["inside"], by, strict=True) if i and s) > article for by in shared)
    return [no for no, inside in enumerate(page["inside"]) if (len(shared) == 2 and not copies and shared[0][no] and shared[1][no] if inside else shared[0][no])]


def lined(pages: DataFrame) -> DataFrame:
    """``LINES`` of each page, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            hashes, words, inside, told = [], [], [], []
            for html in batch.column("html"):
                lines = [(state, text) for state, text in lines_of(html.as_py() or "") if state > NEVER]
                hashes.append([xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for _, t in lines])
                words.append([t.count(" ") + 1 for _, t in lines])
                inside.append([state == IN_ARTICLE for state, _ in lines])
                told.append(xxhash.xxh3_64_intdigest(repr((hashes[-1], inside[-1])).encode()) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ORDER), pa.array(told, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(inside, pa.list_(pa.bool_()))], names=[*ORDER, "told", "hashes", "words", "inside"])

    return cut(_placed(pages).mapInArrow(run, LINES), "lines")


def _placed(pages: DataFrame) -> DataFrame:
    html = F.col("html").cast("string")
    return pages.select(host_of("url").alias("host"), path_of("url").alias("path"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(html).alias("content"), html.alias("html"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range with each row's number, and that of its run of copies."""
    no, run, last = 0, -1, None
    for batch in batches:
        runs = []
        for key in zip(batch.column("host").to_pylist(), batch.column("told").to_pylist(), strict=True):
            run, last = run + (key != last), key
            runs.append(run)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(no, no + batch.num_rows), pa.int64()), pa.array(runs, pa.int64())], names=[*batch.schema.names, "no", "run"])
        no += batch.num_rows


def _beyond(ranged: DataFrame) -> DataFrame:
    """For each range the page before its first run and the one after its last run, as rows of the range with ``no`` -1 and the largest.

    What is numbered here are four runs of each range at most, not pages.
    """
    ends = ranged.groupBy("part").agg(F.max("run").alias("_most"))
    edges = ranged.join(F.broadcast(ends), "part").filter("run < 2 OR run > _most - 2")
    page = F.struct("host", "path", "told", "hashes", "words", "inside")
    runs = edges.groupBy("part", "run").agg(F.first("host").alias("host"), F.first("told").alias("told"), F.first("_most").alias("_most"), F.min_by(page, "no").alias("first"), F.max_by(page, "no").alias("last"))
    order = Window.orderBy("part", "run")
    new = ~(F.col("host").eqNullSafe(F.lag("host").over(order)) & F.col("told").eqNullSafe(F.lag("told").over(order)))
    runs = cut(runs.withColumn("whole", F.sum(new.cast("long")).over(order)), "edges")
    spans = runs.groupBy("whole").agg(F.min_by("first", F.struct("part", "run")).alias("first"), F.max_by("last", F.struct("part", "run")).alias("last"))
    asked = lambda rows, by, page, no: rows.select("part", (F.col("whole") + by).alias("whole"), F.col("host").alias("_host")).join(spans, "whole").filter(F.col(f"{page}.host") == F.col("_host")).select("part", F.lit(no).cast("long").alias("no"), f"{page}.*")
    return asked(runs.filter("run = 0"), -1, "last", -1).unionByName(asked(runs.filter("run = _most"), 1, "first", (1 << 63) - 1))


VERDICTS = "page_id long, url string, content long, gone array<int>"


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on sorted pages of ranges; in hand are a run of copies, whose lines are held once, and the page on either side."""
    out: list[tuple] = []
    part = before = now = None
    members: list[tuple] = []

    def close(after: dict | None) -> None:
        if now is None or not now["hashes"]:
            return
        sides = [x for x in (before, after) if x is not None and x["host"] == now["host"]]
        known: dict[int, list[int]] = {}
        for path, *key in members if sides else ():
            first = max(range(len(sides)), key=lambda i: _prefix(sides[i]["path"], path))
            if first not in known:
                known[first] = deleted(now, sides[first], sides[1 - first] if len(sides) > 1 else None)
            if known[first]:
                out.append((*key, known[first]))

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                close(None)
                part, before, now, members = row["part"], None, None, []
            if now is None or (row["host"], row["told"]) != (now["host"], now["told"]):
                close(row)
                before = now and {**now, "path": members[-1][0] if members else now["path"]}
                now, members = row, []
            if 0 <= row["no"] < (1 << 63) - 1:
                members.append((row["path"], row["page_id"], row["url"], row["content"]))
        yield _verdict_rows(out)
        out.clear()
    close(None)
    yield _verdict_rows(out)


def _verdict_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())))], names=["page_id", "url", "content", "gone"])


def verdicts(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """``page_id, url, content`` (hash of the html) of the pages of which lines go, and their numbers ``gone``; written to the shared folder."""
    lines = lined(pages)
    ranged = lines.repartitionByRange(ranges or parts_for(lines), *ORDER).sortWithinPartitions(*ORDER)
    ranged = cut(ranged.mapInArrow(_numbered, f"{LINES}, no long, run long").withColumn("part", F.spark_partition_id()), "ranged")
    columns = ["part", "no", "host", "path", "told", "hashes", "words", "inside"]
    rows = ranged.select(*columns, "page_id", "url", "content").unionByName(_beyond(ranged).select(*columns), allowMissingColumns=True)
    # One range is one key: about as many rows as a range was made for.
    sorted_ = rows.repartition("part").sortWithinPartitions("part", "no")
    return cut(sorted_.mapInArrow(_decided, VERDICTS).dropDuplicates(["page_id", "url", "content"]), "verdicts")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts, n = [], []
        for html, gone in zip(batch.column("html"), batch.column("gone").to_pylist(), strict=True):
            kept = [text for state, text in lines_of(html.as_py() or "") if state > NEVER]
            out = set(gone or ())
            texts.append("\n\n".join(t for i, t in enumerate(kept) if i not in out))
            n.append(len(out))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_deleted"])


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars, n_deleted`` (lines that went since its neighbours share them).

    ``pages`` needs these columns and ``html``; others are not read and not returned, whatever their names. Null html is empty, a
    null or odd url has an empty host and path. Repeated rows give a row each, with one text. Ties of path go by page id, url and a
    hash of the html. A host with one page, or with copies of one page alone, keeps all lines. A very long page is read whole, by one worker.
    No rows: no rows. ``ranges``, the partitions of the sort, changes no row; a hot host is as many ranges as it fills.
    """
    found = verdicts(pages, ranges)
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    page = _placed(pages).select("page_id", "url", "content", "html").alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("v.page_id")) & F.col("p.url").eqNullSafe(F.col("v.url")) & (F.col("p.content") == F.col("v.content"))
    return page.join(found.alias("v"), same, "left").select("p.page_id", "p.url", "html", "gone").mapInArrow(_extract, TEXT)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLES: dict[str, str] = {}
