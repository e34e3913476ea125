import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexiqua.llm import token_alignment as m

PATH_A, PATH_B = m.tokenizer_paths()


def library_tokens(texts):
    """Ids and bytes of both libraries for each text, read plainly."""
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    byte = {c: i for i, c in enumerate(_characters())}
    for text in texts:
        if not text:
            yield [], [], [], []
            continue
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_x = [bytes(byte[c] for c in t) for t in x.tokens]
        pieces = [b.id_to_piece(i) for i in y]
        bytes_y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, pieces)]
        if b"".join(bytes_x) != (" " + text).encode() or b"".join(bytes_y) != (" " + text).encode():
            yield [], [], [], []
        else:
            yield x.ids, bytes_x, y, bytes_y


def _characters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, more = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + more)
            more += 1
    return [names[b] for b in range(256)]


def brute(docs):
    cut = []
    for ids_a, bytes_a, ids_b, bytes_b in library_tokens([x for _, x in docs]):
        found, i, j = [], 0, 0
        while i < len(ids_a):
            start, end = (i, j), [len(bytes_a[i]), len(bytes_b[j])]
            i, j = i + 1, j + 1
            while end[0] != end[1]:
                if end[0] < end[1]:
                    end[0] += len(bytes_a[i])
                    i += 1
                else:
                    end[1] += len(bytes_b[j])
                    j += 1
            found.append((ids_a[start[0] : i], ids_b[start[1] : j]))
        cut.append((len(ids_a), len(ids_b), found))
    count = Counter(p for _, _, found in cut for p in {(x, y) for xs, ys in found for x in xs for y in ys})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (i, _), (n_a, n_b, found) in zip(docs, cut):
        every = [(x, y) for xs, ys in found for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in found)
        rows.append((i, n_a, n_b, len(found), len(every), sum(count[p] == best[p[0]] for p in every), sum(count[p] for p in every), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "a", "  two  spaces ", "tabs\tand\nlines\r\n\n", "mark ▁ inside", "漢字 かな 🙂🙂 x🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "é é ﬁ İ", "\x00\x01", "naïve façade", "aaaa" * 300, "=" * 500 + " x", "it's I'll 12345 x1y2"]


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, x, 5, "b") for i, x in docs], "doc_id long, text string, uid int, a string")
    return sorted((tuple(r) for r in m.alignment(df, PATH_A, PATH_B, **more).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("worker_pairs", [m.WORKER_PAIRS, 0])
def test_odd_texts(spark, monkeypatch, worker_pairs):
    monkeypatch.setattr(m, "HOT_ROWS", 2)
    docs = [*enumerate(ODD), (3, "a"), (None, "the the the cat"), (90, "the cat " * 20_000)]
    assert run(spark, docs, worker_pairs=worker_pairs) == brute(docs)


def test_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in m.op12_alignment(spark, sf_dir).select(*COLUMNS).collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_blocks_and_wide_groups(monkeypatch):
    rng = np.random.default_rng(3)
    size_a, size_b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    a, b, of = rng.integers(0, 5, size_a.sum()), rng.integers(0, 7, size_b.sum()), np.repeat(np.arange(10), 4)

    def counted():
        total = Counter()
        for doc, pair, times in m.links(a, b, size_a, size_b, of, 7):
            for d, p, t in zip(doc.tolist(), pair.tolist(), np.broadcast_to(times, pair.shape).tolist()):
                total[d, p] += t
        return total

    want = counted()
    assert sum(want.values()) == (size_a * size_b).sum()
    monkeypatch.setattr(m, "WIDE", 6)
    monkeypatch.setattr(m, "BLOCK_LINKS", 10)
    assert counted() == want


def test_both_encoders_give_the_same_ids(monkeypatch):
    own = m.ByteLevel(PATH_A)
    assert own._ranks is not None
    texts = [" " + (x or "") for x in ODD] + [f" a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}" for c in range(1, 0x3000, 7)]
    fast = [own.encode(x).tolist() for x in texts]
    monkeypatch.setattr(m, "LONG", -1)
    assert [own.encode(x).tolist() for x in texts] == fast
