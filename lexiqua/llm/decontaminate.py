"""Benchmark decontamination with training suffix arrays.

The test texts are cut into blocks of bounded size, which are written once to the shared folder. Training texts are read once:
a worker takes a shard of whole documents, numbers its words and sorts all its suffixes (to the window's words) into a suffix
array. Then it takes the blocks one by one and binary-searches each test suffix in the array. A hit whose words before differ,
too, is where a verbatim match begins; it is followed word by word to its end, which gives the longest match with its place
in both texts. No shuffle, no block passes through the driver, and nothing that grows with the training texts leaves its task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm._common import kept, new_folder, slices, split_words, spread, translated

#: Lower-cases A-Z and turns each other ASCII character that belongs to no word into a space.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Words of test text in a block: what is searched at once.
BLOCK_WORDS = 500_000
#: Blocks that a worker keeps between shards.
KEPT_BLOCKS = 4
SPANS = "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"
_SPANS = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
FIGURES = ("n_words", "n_hit", "items", "spans")


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().translate(WORD_BYTES).split()]


class Block:
    """Test texts: their words, numbered by the block's vocabulary, and their suffixes of ``window`` words (of all words, where a text has fewer)."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        codes, self.vocabulary, first = split_words(translated(texts, WORD_BYTES))
        self.ids, self.codes, self.window = ids, codes, window
        count = np.diff(first)
        width = np.minimum(window, count)
        starts = np.where(count > 0, count - width + 1, 0)
        self.item = np.repeat(np.arange(len(count)), starts)
        self.start = spread(np.zeros(len(count)), starts)
        self.width = width[self.item]
        self.begin, self.end = first[:-1][self.item], first[1:][self.item]


class Shard:
    """Whole documents as one array of word numbers from 1, apart by 0, and its suffix array to ``window`` words."""

    def __init__(self, texts: pa.Array, window: int):
        codes, self.vocabulary, first = split_words(translated(texts, WORD_BYTES))
        n = len(first) - 1
        self.counts = np.diff(first)
        self.first = first[:-1] + np.arange(n)
        self.numbers = np.zeros(len(codes) + n + window + 1, np.uint64)
        self.numbers[np.arange(len(codes)) + np.repeat(np.arange(n), self.counts)] = codes.astype(np.uint64) + np.uint64(1)
        self.window = window
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.each = min(window, 64 // self.bits)  # words in a key
        self.keys = -(-window // self.each)
        at = np.flatnonzero(self.numbers)
        lead = self._key(self.numbers, at, 0)
        order = np.argsort(lead)
        self.suffixes, self.lead = at[order], lead[order]
        if self.keys > 1 and len(at):
            new = np.append(True, self.lead[1:] != self.lead[:-1])
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            some = self.suffixes[tied]
            finer = np.lexsort([*(self._key(self.numbers, some, k) for k in range(self.keys - 1, 0, -1)), np.cumsum(new)[tied]])
            self.suffixes[tied] = some[finer]

    def _key(self, numbers: np.ndarray, at: np.ndarray, k: int, width: np.ndarray | None = None, fill: int = 0) -> np.ndarray:
        """Words ``k * each`` and on of the suffixes at ``at`` as one number; those beyond ``width`` are ``fill``."""
        key = np.zeros(len(at), np.uint64)
        for j in range(k * self.each, (k + 1) * self.each):
            if j >= self.window:
                word = np.uint64(0)
            elif width is None:
                word = numbers[at + j]
            else:
                word = np.where(j < width, numbers[np.minimum(at + j, len(numbers) - 1)], np.uint64(fill))
            key = (key << np.uint64(self.bits)) | word
        return key

    def _bound(self, wanted: list[np.ndarray], low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """Binary search between places of equal first key: the first suffix not below (``after``: above) each."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at = self.suffixes[mid]
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, want in enumerate(wanted, 1):
                key = self._key(self.numbers, at, k)
                less |= same & (key < want[open_])
                same &= key == want[open_]
            right = less | same if after else less
            low[open_[right]], high[open_[~right]] = mid[right] + 1, mid[~right]
        return low

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches with a block's texts: item, first word in it, place in ``numbers``, words."""
        none = np.zeros(0, np.int64)
        if not len(self.suffixes) or not len(block.item):
            return none, none, none, none
        of = pc.fill_null(pc.add(pc.index_in(block.vocabulary, value_set=self.vocabulary), 1), 0).to_numpy(zero_copy_only=False).astype(np.uint64)
        test = np.append(of[block.codes], np.uint64(0))
        absent = np.concatenate(([0], np.cumsum(test == 0)))
        at = block.begin + block.start
        here = np.flatnonzero(absent[at + block.width] == absent[at])
        at, width = at[here], block.width[here]
        top = (1 << self.bits) - 1
        low = np.searchsorted(self.lead, self._key(test, at, 0, width), "left")
        high = np.searchsorted(self.lead, self._key(test, at, 0, width, top), "right")
        more = np.flatnonzero((width > self.each) & (low < high))
        if more.size:
            bounds = [self._bound([self._key(test, at[more], k, width[more], fill) for k in range(1, self.keys)], low[more], high[more], fill > 0) for fill in (0, top)]
            low[more], high[more] = bounds
        found = np.flatnonzero(low < high)
        place = self.suffixes[spread(low[found], high[found] - low[found])]
        hit = here[np.repeat(found, high[found] - low[found])]
        item, start, at, end = block.item[hit], block.start[hit], block.begin[hit] + block.start[hit], block.end[hit]
        # A match begins where the words before differ, or one of the texts does.
        before = self.numbers[place - 1]
        first = (start == 0) | (place == 0) | (before == 0) | (test[at - 1] != before)
        item, start, place, at, end, length = item[first], start[first], place[first], at[first], end[first], block.width[hit][first]
        open_ = np.arange(len(item))
        while open_.size:
            step = np.arange(64)
            mine, other = at[open_, None] + length[open_, None] + step, place[open_, None] + length[open_, None] + step
            word = self.numbers[np.minimum(other, len(self.numbers) - 1)]  # the last is a 0, as between documents
            same = (mine < end[open_, None]) & (word > 0) & (test[np.minimum(mine, len(test) - 1)] == word)
            run = np.where(same.all(axis=1), 64, same.argmin(axis=1))
            length[open_] += run
            open_ = open_[run == 64]
        return item, start, place, length


def write_blocks(bench: DataFrame, folder: str, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write the test texts (``item_id, text``) as files of about ``block_words`` words, whole texts in each; returns the names of the files.

    Null and empty texts, and texts without words, are in no window; null ones are left out. Repeated items are items each. A
    text longer than a block makes its block longer. No rows: no files. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        parts, n, names = [], 0, []

        def close() -> None:
            names.append(f"{uuid.uuid4().hex}.parquet")
            parquet.write_table(pa.Table.from_batches(parts), f"{top}/{names[-1]}", filesystem=store)

        for batch in slices(batches, "text", block_words * 4):
            parts.append(batch)
            n += int(pc.sum(pc.fill_null(pc.binary_length(batch.column("text")), 0)).as_py() or 0)
            if n >= block_words * 4:
                close()
                parts, n = [], 0
        if parts:
            close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return sorted(r[0] for r in rows.mapInArrow(run, "name string").collect())


def _block(store, folder: str, name: str, window: int) -> Block:
    """A block of test texts; a worker keeps a few."""
    from pyarrow import parquet

    blocks = kept(("blocks", folder, window), dict)
    if name not in blocks:
        table = parquet.read_table(f"{folder}/{name}", filesystem=store)
        while len(blocks) >= KEPT_BLOCKS:
            del blocks[next(iter(blocks))]
        blocks[name] = Block([x or "" for x in table.column("item_id").to_pylist()], table.column("text").combine_chunks(), window)
    return blocks[name]


def match(docs: DataFrame, bench: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``n_words``, ``n_hit``, ``items`` (sorted ids of test texts with a match) and ``spans`` (longest matches).

    ``docs`` needs ``text``, ``bench`` needs ``item_id`` and ``text``. Rows stay as they are: repeated rows and rows with
    equal ids are judged one by one; a null or empty text has no words; columns of ``docs`` with one of the four names are
    replaced. A null item id counts as the empty id; items of one id count as one. No test texts: no hits. No rows: no rows.
    A document longer than a shard is a shard of its own, whole, whose arrays are about 60 bytes a word.
    """
    docs = docs.drop(*FIGURES)
    given = [c for c in docs.columns if columns is None or c in columns]
    folder = new_folder(docs.sparkSession, "blocks")
    names = write_blocks(bench, folder, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in slices(batches, "text", keeps=True):
            shard = Shard(batch.column("text"), window)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for name in names:
                block = _block(store, top, name, window)
                item, start, place, length = shard.search(block)
                row = np.searchsorted(shard.first, place, side="right") - 1
                for r, i, s, p, n in zip(row.tolist(), item.tolist(), start.tolist(), (place - shard.first[row]).tolist(), length.tolist(), strict=True):
                    found[r].append({"item_id": block.ids[i], "item_word": s, "doc_word": p, "n_words": n})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(shard.counts, pa.int64()), pa.array(found, _SPANS)], names=[*given, "n_words", "spans"])

    schema = docs.select(*(F.col(f"`{c}`") for c in given), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans")).schema
    found = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*given, "text"]))).mapInArrow(run, schema)
    return _summary(found).select(*(F.col(f"`{c}`") for c in given), *FIGURES)


def _summary(docs: DataFrame) -> DataFrame:
    """Counts from spans. Hit words are the union of spans: spans in order of their start, folded with the furthest end so far."""
    step = "(a, s) -> named_struct('end', greatest(a.end, s.doc_word + s.n_words), 'n', a.n + greatest(0L, s.doc_word + s.n_words - greatest(a.end, s.doc_word)))"
    order = "array_sort(transform(spans, s -> named_struct('doc_word', s.doc_word, 'n_words', s.n_words)))"
    return (
        docs.withColumn("n_hit", F.expr(f"aggregate({order}, named_struct('end', 0L, 'n', 0L), {step}, a -> a.n)"))
        .withColumn("items", F.expr("array_sort(array_distinct(transform(spans, s -> s.item_id)))"))
    )


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold any window of a test text.

    All columns stay as they are, also those with a name that ``match`` gives its own. Null and empty texts have no words and
    stay; repeated rows are judged one by one. Long texts, ties and empty tables are as in ``match``.
    """
    own = {c: f"_own_{c}" for c in docs.columns if c in FIGURES}
    renamed = docs.withColumnsRenamed(own)
    clean = match(renamed, bench, window).filter("n_hit = 0")
    return clean.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op4_decontaminate": rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
dw AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw))),
hit AS (SELECT DISTINCT dw.doc_id, dw.p, dw.m, bw.item_id FROM dw JOIN bw USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS i FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
