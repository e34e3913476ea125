import zlib

import numpy as np
from tokenizers import Tokenizer

from lexiqua.llm import token_files as t
from lexiqua.llm._common import new_path

SCHEMA = "doc_id long, text string, shard string, no int"


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(t.tokenizer_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    folder = new_path(spark, "tokens")
    return [tuple(r) for r in t.read_shards(t.write_shards(docs, folder, t.tokenizer_path(), 2), folder).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_odd_texts(spark):
    rows = [(5, "It's  the\tEND of <|endoftext|> x<|startoftext|>y \x00 a\x00b"), (1, None), (None, "null id"), (3, ""), (2, "ΑΣ İstanbul éÉ ﬁ 1234 x 　 漢字"), (9, "word " * 5000), (7, " \n\t "), (8, "a.,b...c !!")]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_no_rows(spark):
    rows = [(4, "same"), (4, "same"), (6, "z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_table_is_encoded_as_the_library_does(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [tuple(r) for r in t.op2_token_files(spark, sf_dir).orderBy("start").collect()]
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_a_tokenizer_whose_pieces_hold_spaces_is_taken_whole():
    import pyarrow as pa

    path = t.tokenizer_path("byte_bpe_50k.json")
    texts = ["a b  c\n\nd", "", "It's  the end", " x "]
    own, library = t.WordEncoder(path), Tokenizer.from_file(path)
    ids, n = own.encode(pa.array(texts), 2)
    want = [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert not own.by_word and t.WordEncoder(t.tokenizer_path()).by_word
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_places_are_numbers(spark):
    rows = [(i, f"text {i}", part, i) for i, part in enumerate((100_000, 99_999, 9, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long, row long")
    folder = new_path(spark, "tokens")
    got = t.read_shards(t.write_shards(docs, folder, t.tokenizer_path(), 2, place=("part", "row")), folder).orderBy("start")
    assert [r.doc_id for r in got.collect()] == [2, 3, 1, 0]
