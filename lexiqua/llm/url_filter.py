"""URL filters: a bit-parallel wildcard automaton.

All glob rules are packed into one state vector of several 64-bit words, a bit for each place in each rule. A character
advances every rule at once (Shift-And): states move on where their next character fits, and states at a wildcard also
stay. The canonical URL is ``.host/path``: the host lower-cased behind a dot, so ``*.com`` fits a host and all its
subdomains. In globs ``?`` is one character, ``*`` any characters but ``/``, ``**`` any characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host and path prefix to verdict: a rule fits its host and all subdomains, the longest that fits decides.
HOST_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: What decides where no host rule fits: a URL that fits any of these is blocked, others are allowed.
GLOBS = ("*.adult*.**", "*adult-*.**", "*casino*.**", "*.ads-track.**", "*-pills.**", "*free-bets.**", "*spam-farm.**")
URLS = "host string, path string, rule string, verdict string"
#: Bytes of a text from which on it is read alone, with the state as one whole number; shorter ones advance together.
LONG = 1000


class Automaton:
    """Rules of UTF-8 bytes as masks: ``step[c]`` states that are entered by c, ``stay[c]`` states kept by c."""

    def __init__(self, globs: list[str]):
        places: list[tuple[int | None, int]] = []  # character that enters the state (None: the start, 256: any), and its loop: 0, 1 (not /), 2
        self.starts, self.ends = [], []
        for glob in globs:
            self.starts.append(len(places))
            places.append((None, 0))
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i] == ord("*"):
                    many = data[i : i + 2] == b"**"
                    places[-1] = (places[-1][0], max(places[-1][1], 2 if many else 1))
                    i += 2 if many else 1
                else:
                    places.append((256 if data[i] == ord("?") else data[i], 0))
                    i += 1
            self.ends.append(len(places) - 1)
        self.words = -(-len(places) // 64) or 1
        self.step, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for at, (char, loop) in enumerate(places):
            word, bit = at // 64, np.uint64(1) << np.uint64(at % 64)
            if char == 256:
                self.step[:, word] |= bit
            elif char is not None:
                self.step[char, word] |= bit
            if loop:
                self.stay[:, word] |= bit
                if loop == 1:
                    self.stay[ord("/"), word] &= ~bit
        whole = lambda masks: [int.from_bytes(x.astype("<u8").tobytes(), "little") for x in masks]
        self.whole = whole(self.step), whole(self.stay)
        self.begin = np.zeros(self.words, np.uint64)
        for at in self.starts:
            self.begin[at // 64] |= np.uint64(1) << np.uint64(at % 64)

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """Which text fits which rule."""
        found = np.zeros((len(texts), len(self.ends)), bool)
        size = np.array([len(t) for t in texts], np.int64)
        found[size < LONG] = self._together([t for t in texts if len(t) < LONG])
        for i in np.flatnonzero(size >= LONG):
            found[i] = self._alone(texts[i])
        return found

    def _alone(self, text: bytes) -> list[bool]:
        step, stay = self.whole
        state = int.from_bytes(self.begin.astype("<u8").tobytes(), "little")
        for c in text:
            state = state << 1 & step[c] | state & stay[c]
        return [bool(state >> at & 1) for at in self.ends]

    def _together(self, texts: list[bytes]) -> np.ndarray:
        """Texts of one length end together, so each step works on those still running."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        first = (np.cumsum(size) - size)[order]
        longest = size[order]
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-longest, -at, side="left"))  # texts longer than ``at``
            now, char = state[:n], data[first[:n] + at]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[char]) | (now & self.stay[char])
        found = np.zeros((len(texts), len(self.ends)), bool)
        for rule, at in enumerate(self.ends):
            found[order, rule] = (state[:, at // 64] >> np.uint64(at % 64) & one).astype(bool)
        return found


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    """Lower-cased host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal(text: str) -> str:
    """A rule's text as a glob; rules with a wildcard in them have no literal form here."""
    if set(text) & {"*", "?"}:
        raise ValueError(f"a host rule can't hold a wildcard: {text}")
    return text


def judge(pages: DataFrame, host_rules=HOST_RULES, globs=GLOBS, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    Of the host rules that fit, the longest decides (of equal ones, a block); where none fits ``rule`` is null and the globs
    decide. A null URL, or one without ``://``, has an empty host and path and is allowed unless a glob fits an empty host.
    Columns of ``pages`` with these names are replaced, others stay; rows, repeated ones too, are judged one by one. Long URLs
    are read whole, in time that grows with their length times the rules'. Rules go to workers with the plan: thousands of
    them, not a table. No rows: no rows.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(url_col), "path": path_of(url_col)})
    ranked = sorted(host_rules, key=lambda r: (-len(r[0]), r[1] != "block"))
    rules = Automaton([f"*.{literal(r)}**" for r, _ in ranked] + list(globs))
    kept = [c for c in pages.columns if c not in ("host", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = rules.fits([f".{h}{p}".encode() for h, p in zip(host, path, strict=True)])
            mine, other = found[:, : len(ranked)], found[:, len(ranked) :].any(axis=1)
            which = np.where(mine.any(axis=1), mine.argmax(axis=1), -1) if len(ranked) else np.full(len(host), -1)
            rule = [ranked[i][0] if i >= 0 else None for i in which]
            verdict = [ranked[i][1] if i >= 0 else "block" if o else "allow" for i, o in zip(which, other, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*kept, "host", "path", "rule", "verdict"])

    schema = pages.select(*kept, "host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for name in ("rule", "verdict"):
        schema[name].nullable = True
    return pages.select(*kept, "host", "path").mapInArrow(run, schema)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _regex(glob: str) -> str:
    out = ""
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            many = glob[i : i + 2] == "**"
            out += ".*" if many else "[^/]*"
            i += 2 if many else 1
        else:
            out += "." if glob[i] == "?" else "\\" + glob[i] if glob[i] in ".+()[]{}|^$\\" else glob[i]
            i += 1
    return f"^(?s:{out})$"


QUERIES = {"op8_url_filter": op8_url_filter}
_CASES = " ".join(f"WHEN regexp_matches(c, '{_regex(f'*.{r}**')}') THEN '{r}'" for r, _ in sorted(HOST_RULES, key=lambda r: -len(r[0])))
ORACLES = {
    "op8_url_filter": rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {_CASES} END AS rule, regexp_matches(c, '{"|".join(map(_regex, GLOBS))}') AS other FROM (SELECT *, '.' || host || path AS c FROM u))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in HOST_RULES)} WHEN other THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
}
