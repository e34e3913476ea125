"""Token counts of a unigram tokenizer, without its tokens: count-only Viterbi.

An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at each character; dynamic programming carries
the best score and the piece count of the text so far. Ties are those of the tokenizers library's Unigram model: pieces are
tried by rising start and only a better score replaces; a character that is no piece itself may be unknown, at the lowest
score less 10, tried after the pieces that start there. Unknown characters next to each other are one token, or their UTF-8
bytes where the vocabulary has all byte pieces. Words are separate, as the library's Metaspace pre-tokenizer splits them,
so a worker keeps the counts of frequent words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm._common import filled, kept, slices, sums

#: Words whose counts a worker keeps; kept as they come, which keeps the frequent ones.
KEPT_WORDS = 500_000
SPACE = "▁"
PENALTY = 10.0


class Counter:
    """Counts for one vocabulary of (piece, score), numbered by place; ``unk`` is the number of the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], unk: int = 0, byte_fallback: bool = True):
        import ahocorasick

        pieces = dict(vocabulary)
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.lowest = min(s for _, s in vocabulary) - PENALTY
        self.singles = {p for p in pieces if len(p) == 1}
        self.longest = max(map(len, pieces))
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces.items():
            if p:
                self.automaton.add_word(p, (len(p), s, p == vocabulary[unk][0]))
        self.automaton.make_automaton()
        # A line feed in no piece stands alone on any path; with whole scores, sums are exact and the parts beside it are apart.
        self.apart = self.bytes and not any("\n" in p for p in pieces) and all(float(s).is_integer() and abs(s) < 1 << 31 for s in pieces.values())
        self.known: dict[str, int] = {}

    def viterbi(self, word: str) -> tuple[float, int]:
        """Best score and piece count of a word (a pre-token with its leading space mark)."""
        n, ring = len(word), min(len(word), self.longest) + 1
        score, count, fused = [0.0] * ring, [0] * ring, [False] * ring  # of the last places, as far back as a piece begins
        at, found = 0, []

        def close(end: int) -> None:
            """Settle places up to ``end``, with ``found`` pieces ending there."""
            best, most, joined = None, 0, False
            for length, s, unk in sorted(found, reverse=True):
                start = (end - length) % ring
                value = s + score[start]
                if best is None or value > best:
                    best, joined = value, unk
                    most = count[start] + (0 if unk and fused[start] and not self.bytes else 1)
            c, before = word[end - 1], (end - 1) % ring
            if c not in self.singles:
                value = self.lowest + score[before]
                if best is None or value > best:
                    best, joined = value, True
                    most = count[before] + (len(c.encode()) if self.bytes else 0 if fused[before] else 1)
            score[end % ring], count[end % ring], fused[end % ring] = best, most, joined

        for last, piece in self.automaton.iter(word):
            end = last + 1
            if end != at:
                if at:
                    close(at)
                for e in range(at + 1, end):
                    found = []
                    close(e)
                at, found = end, []
            found.append(piece)
        if at:
            close(at)
        for e in range(at + 1, n + 1):
            found = []
            close(e)
        return score[n % ring], count[n % ring]

    def count(self, word: str) -> int:
        c = self.known.get(word)
        if c is None:
            if self.apart and "\n" in word:
                parts = word.split("\n")
                c = sum(self.count(p) for p in parts if p) + len(parts) - 1
            else:
                c = self.viterbi(word)[1] if word else 0
            if len(self.known) < KEPT_WORDS:
                self.known[word] = c
        return c

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token counts of filled texts."""
        texts = pc.replace_substring(texts, SPACE, " ")
        lead = pc.starts_with(texts, " ")
        texts = pc.if_else(lead, pc.utf8_slice_codeunits(texts, 1), texts)
        empty = pc.and_(pc.equal(pc.binary_length(texts), 0), pc.invert(lead)).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        each = np.fromiter((self.count(SPACE + w) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        total = sums(each[coded.indices.to_numpy()] if len(each) else np.zeros(0, np.int64), offsets - offsets[0])
        return np.where(empty, 0, total)


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], unk: int = 0, byte_fallback: bool = True) -> DataFrame:
    """``docs`` (its columns but ``text``) with ``n_tokens``: tokens of each whole text.

    The vocabulary is broadcast; its size is that of a tokenizer. Null and empty texts have 0 tokens. Repeated rows are
    counted each; a column ``n_tokens`` of ``docs`` is replaced, others stay. Texts are read whole; of a long word without
    spaces, what is held beside it is as long as the longest piece. Ties of scores are the library's. No rows: no rows.
    """
    docs = docs.drop("n_tokens")
    others = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vocabulary, unk, byte_fallback)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("counter", hash(shared.value)), lambda: Counter(*pickle.loads(shared.value)))
        for batch in slices(batches, "text", keeps=True):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(counter.counts(filled(batch.column("text"))))], names=[*others, "n_tokens"])

    schema = docs.select(*others, F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.mapInArrow(run, schema)


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, as its vocabulary orders them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, vocabulary_of(model_path()))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
