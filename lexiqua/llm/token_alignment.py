"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both token sequences of a text cover its bytes, so their ends are cumulative sums of token lengths. Ends that both have
(an intersection of sorted arrays) cut the tokens into groups; a search of each end among the cuts is its group. Tokens of
both sides in one group are linked. Links are expanded by repeats, a block of groups at a time; a group of many tokens is
first reduced to its distinct ids with their counts. How many documents link a pair of ids is counted in each task, then over
salted parts of each pair, then over the parts.

Tokens and group sizes are written to the shared folder once, so texts are encoded once; counts, and what they say about each
document, are computed from these.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, filled, kept, slices, spread, sums

#: Fixed value: how a byte-level pre-tokenizer splits text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts, in characters, go through the tokenizers library itself, whose splitter keeps no stack.
LONG = 1 << 20
#: Links that a worker holds at once; a group of more links than ``WIDE`` is reduced to distinct ids first.
BLOCK_LINKS, WIDE = 1 << 21, 1 << 14
#: Distinct pairs that a counting task holds before it sends what it has.
HELD_PAIRS = 2_000_000
SALTS = 8
#: The largest table of pairs that each worker reads (17 bytes a pair); a larger one is joined.
WORKER_PAIRS = 4_000_000
#: In that join, pairs of more documents than this, and than this part of all rows, are broadcast: 100 000 of them at most.
HOT_ROWS, HOT_PART = 10_000, 1e-5
ALIGNED = "doc_id long, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, sizes_a binary, sizes_b binary"
NONE = np.zeros(0, np.int64)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, others from 256 on in order."""
    visible = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE tokenizer file; special tokens' strings are plain text.

    Where the file is plain (no normaliser, the standard splitter, merges in the order of the ids they make), its vocabulary is a
    table of ranks, and a faster encoder of ranks gives the same ids; else the file's own library encodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        plain = plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and made == sorted(made) and len(ranks) == len(made) + 256
        self.size = max([*ranks.values(), *(x["id"] for x in spec.get("added_tokens", []))]) + 1
        self.pieces = [b""] * self.size
        for t, i in ranks.items():
            self.pieces[i] = t
        for x in spec.get("added_tokens", []):
            self.pieces[x["id"]] = x["content"].encode()
        self.plain, self._ranks = plain, None
        if plain:
            import tiktoken

            self._ranks = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self._ranks is not None and len(text) <= LONG:
            return np.asarray(self._ranks.encode_to_numpy(text, disallowed_special=()), np.int64)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentencepiece model file; a piece's bytes are its text with U+2581 as space, or the byte that it names."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        self.pieces = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self._model.id_to_piece, range(self.size)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Tokenizers:
    """Both tokenizers of a worker, and what alignment needs of their vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.length_a, self.length_b = (np.array([len(p) for p in x.pieces], np.int64) for x in (self.a, self.b))
        n = max(self.a.size, self.b.size)
        self.n = n
        #: Each id in digits with what may follow it, in the bytes of one integer; bytes that aren't needed are 0.
        self.digits = np.array([f"{i}{end}" for end in ",|;" for i in range(n)], "S8").view("<u8")

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none for texts whose bytes they don't give back."""
        left, right = [], []
        for text, ids in zip(texts, self.b.encode(texts), strict=True):
            a, b = NONE, NONE
            if text:
                want = (" " + text).encode()
                a, b = self.a.encode(" " + text), np.array(ids, np.int64)
                # A plain byte-level vocabulary gives back all bytes by construction.
                if b"".join(map(self.b.pieces.__getitem__, ids)) != want or not self.a.plain and b"".join(map(self.a.pieces.__getitem__, a.tolist())) != want:
                    a, b = NONE, NONE
            left.append(a)
            right.append(b)
        return left, right


def groups(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side each group has, from the byte lengths of tokens over the same bytes."""
    ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return tuple(np.bincount(np.searchsorted(cuts, ends), minlength=len(cuts)) for ends in (ends_a, ends_b))


def _firsts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, of: np.ndarray, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int]]:
    """Links in blocks: the document of each, its pair (a * ``n_b`` + b) and how often it stands there (1 for all, or an array).

    ``of`` is the document of each group. A wide group gives one row for each pair of its distinct ids, in blocks too.
    """
    start_a, start_b = _firsts(size_a), _firsts(size_b)
    n = size_a.astype(np.int64) * size_b
    for g in np.flatnonzero(n > WIDE):
        x, times_x = np.unique(a[start_a[g] : start_a[g + 1]], return_counts=True)
        y, times_y = np.unique(b[start_b[g] : start_b[g + 1]], return_counts=True)
        step = max(1, BLOCK_LINKS // len(y))
        for low in range(0, len(x), step):
            pair = (x[low : low + step, None] * n_b + y).ravel()
            yield np.full(len(pair), of[g]), pair, (times_x[low : low + step, None] * times_y).ravel()
    narrow = np.flatnonzero(n <= WIDE)
    ahead = np.cumsum(n[narrow])
    low = 0
    while low < len(narrow):
        high = max(int(np.searchsorted(ahead, (ahead[low - 1] if low else 0) + BLOCK_LINKS, side="right")), low + 1)
        g = narrow[low:high]
        times = np.repeat(size_b[g], size_a[g])
        left = np.repeat(a[spread(start_a[g], size_a[g])], times)
        right = b[spread(np.repeat(start_b[g], size_a[g]), times)]
        yield np.repeat(of[g], n[g]), left * n_b + right, 1
        low = high


def _sizes(counts: np.ndarray) -> bytes:
    """Group sizes in a byte each, or four where one is larger; the count of groups tells which."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ALIGNED`` for each row of ``docs`` (``doc_id``, ``text``), written to the shared folder.

    Null and empty texts, and those that either tokenizer doesn't give back byte for byte, have no tokens, zeros and the empty
    text for ``groups_sha256``. Repeated rows are rows each, with a ``uid`` of their own. A very long text is encoded as a whole by
    one worker. Other columns are not read, whatever their names. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("aligner", path_a, path_b), lambda: Tokenizers(path_a, path_b))
        for batch in slices(batches, "text", most=1 << 20, keeps=True):
            left, right = own.tokens(filled(batch.column("text")).to_pylist())
            a, b = np.concatenate(left), np.concatenate(right)
            n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
            size_a, size_b = groups(own.length_a[a], own.length_b[b])
            first_a, first_b, start_a, start_b = _firsts(size_a), _firsts(size_b), _firsts(n_a), _firsts(n_b)
            first = np.searchsorted(first_a, start_a)  # a document begins with a group
            # All ids in digits, group by group, A before B.
            order = np.empty(len(a) + len(b), np.int64)
            end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            end_a[first_a[1:] - 1], end_b[first_b[1:] - 1] = 1, 2
            order[np.arange(len(a)) + np.repeat(first_b[:-1], size_a)] = a + end_a * own.n
            order[np.arange(len(b)) + np.repeat(first_a[1:], size_b)] = b + end_b * own.n
            digits = own.digits[order].view(np.uint8)
            full = digits != 0
            at = _firsts(full.reshape(-1, 8).sum(axis=1))[start_a + start_b].tolist()
            digits = memoryview(digits[full])
            texts = [hashlib.sha256(digits[low : high - 1]).hexdigest() if low < high else "" for low, high in zip(at, at[1:])]
            kind_a, kind_b = ("<u2" if x.size <= 1 << 16 else "<u4" for x in (own.a, own.b))
            span = [slice(first[i], first[i + 1]) for i in range(batch.num_rows)]
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("uid"), long(n_a), long(n_b), long(np.diff(first)), long(sums(size_a * size_b, first)), pa.array(texts, pa.string()),
                    *(pa.array([x.astype(kind).tobytes() for x in side], pa.binary()) for side, kind in ((left, kind_a), (right, kind_b))),
                    *(pa.array([_sizes(size[s]) for s in span], pa.binary()) for size in (size_a, size_b)),
                ],
                names=[x.split()[0] for x in ALIGNED.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, ALIGNED), "aligned")


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and group sizes of a batch of ``ALIGNED``, and the row of each group."""
    n = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "n_groups")}

    def arrays(name: str, counts: np.ndarray) -> np.ndarray:
        read = [np.frombuffer(x, {1: np.uint8, 2: "<u2", 4: "<u4"}[len(x) // c]).astype(np.int64) for x, c in zip(batch.column(name).to_pylist(), counts.tolist(), strict=True) if c]
        return np.concatenate(read) if read else NONE

    return arrays("a", n["n_a"]), arrays("b", n["n_b"]), arrays("sizes_a", n["n_groups"]), arrays("sizes_b", n["n_groups"]), np.repeat(np.arange(batch.num_rows), n["n_groups"])


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(place, np.concatenate(counts), len(pair)).astype(np.int64)


def pair_counts(rows: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """``pair, n, best`` of all linked pairs of ids: in how many rows of ``ALIGNED`` each is linked, and whether no other pair of its A
    id is in more; written to the shared folder. ``n_a`` and ``n_b`` are the sizes of the vocabularies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [], [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(counts[0])], names=["pair", "n"])

        for batch in slices(batches, "a", most=2 << 20):
            a, b, size_a, size_b, of = _read(batch)
            seen = [np.unique(doc * (n_a * n_b) + pair) for doc, pair, _ in links(a, b, size_a, size_b, of, n_b)]
            if not seen:
                continue
            pair, n = np.unique((np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]) % (n_a * n_b), return_counts=True)
            pairs.append(pair)
            counts.append(n)
            held += len(pair)
            if held > HELD_PAIRS:
                pairs, counts = ([x] for x in _merged(pairs, counts))
                held = len(pairs[0])
                if held > HELD_PAIRS // 2:
                    yield sent()
                    pairs, counts, held = [], [], 0
        if pairs:
            pairs, counts = ([x] for x in _merged(pairs, counts))
            yield sent()

    part = rows.select("n_a", "n_b", "n_groups", "a", "b", "sizes_a", "sizes_b").mapInArrow(count, "pair long, n long")
    salted = part.groupBy("pair", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    total = cut(salted.groupBy("pair").agg(F.sum("n").alias("n")), "counts").withColumn("a", F.floor(F.col("pair") / n_b))
    most = F.broadcast(total.groupBy("a").agg(F.max("n").alias("most")))  # a row for each id of a vocabulary
    return cut(total.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A written table of ``pair_counts``, sorted by pair, as a worker reads it from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(path)
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(top)) if x.path.endswith(".parquet"))
    read = pa.concat_tables([pq.read_table(f, filesystem=store) for f in files])
    order = np.argsort(read["pair"].to_numpy())
    return tuple(read[c].to_numpy()[order] for c in ("pair", "n", "best"))


def pair_sums(rows: DataFrame, pairs: DataFrame, n_a: int, n_b: int, worker_pairs: int = WORKER_PAIRS) -> DataFrame:
    """``rows`` of ``ALIGNED`` without their tokens, with ``n_best`` (links whose pair is ``best``) and ``count_sum`` (their pairs' counts).

    Up to ``worker_pairs`` pairs, each worker reads the table from the shared folder; a larger one is joined to the pairs of each
    row, with the pairs of most rows broadcast. Both give the same rows.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if pairs.count() <= worker_pairs:
        path = pairs.inputFiles()[0].rpartition("/")[0] if pairs.inputFiles() else None

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "a", most=2 << 20, keeps=True):
                best, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for doc, pair, times in links(*_read(batch), n_b):
                    known, n, is_best = kept(("pairs", path), lambda: _table(path))
                    distinct, place = np.unique(pair, return_inverse=True)
                    at = np.searchsorted(known, distinct)
                    best += np.bincount(doc, is_best[at][place] * times, batch.num_rows)
                    total += np.bincount(doc, n[at][place] * times, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best.astype(np.int64)), pa.array(total.astype(np.int64))], names=[*names, "n_best", "count_sum"])

        return rows.mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a", most=2 << 20):
            for doc, pair, times in links(*_read(batch), n_b):
                key, place = np.unique(doc * (n_a * n_b) + pair, return_inverse=True)
                n = np.bincount(place, np.broadcast_to(times, place.shape), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(key // (n_a * n_b))), pa.array(key % (n_a * n_b)), pa.array(n)], names=["uid", "pair", "times"])

    each = rows.select("uid", "n_a", "n_b", "n_groups", "a", "b", "sizes_a", "sizes_b").mapInArrow(listed, "uid long, pair long, times long")
    hot = F.col("n") > max(HOT_ROWS, (pairs.agg(F.sum("n")).first()[0] or 0) * HOT_PART)
    many = F.broadcast(pairs.filter(hot))
    joined = each.join(many, "pair").unionByName(each.join(many.select("pair"), "pair", "left_anti").join(pairs.filter(~hot), "pair"))
    found = joined.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.select("uid", *names).join(found, "uid", "left").fillna(0, ["n_best", "count_sum"]).drop("uid")


def alignment(docs: DataFrame, path_a: str, path_b: str, worker_pairs: int = WORKER_PAIRS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.

    ``path_a`` is a byte-level BPE tokenizer file, ``path_b`` a sentencepiece model; workers open both. What nulls, odd, long and
    repeated texts and other columns give is in ``aligned``. ``aligned`` and ``pair_counts`` give the links and the table of pairs themselves.
    """
    rows = aligned(docs, path_a, path_b)
    own = Tokenizers(path_a, path_b)
    return pair_sums(rows, pair_counts(rows, own.a.size, own.b.size), own.a.size, own.b.size, worker_pairs)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment(docs, *tokenizer_paths())


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
