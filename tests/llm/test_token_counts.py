import random

import pyarrow as pa
from tokenizers import Tokenizer, models, pre_tokenizers

from lexiqua.llm import token_counts as t


def library(vocabulary, unk=0, byte_fallback=True):
    own = Tokenizer(models.Unigram(vocabulary, unk, byte_fallback))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return own


def same(vocabulary, texts, **more):
    own, lib = t.Counter(vocabulary, **more), library(vocabulary, **more)
    got = own.counts(pa.array(texts)).tolist()
    want = [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert got == want, [(a, b, c) for a, b, c in zip(texts, got, want, strict=True) if b != c][:3]


ODD = ["", " ", "  ", " a", "a ", "a  b", "▁", "▁▁x", "x▁y ▁ z", "line\nline\n\n end\n", "\n", "漢字 かな 🙂🙂 x🙂", "<unk> <s><0x41>", "aaaaaaaaaaaaaaaaaaaa" * 50, "\x00\x01 tab\there", "é é ﬁ İ"]


def test_model_vocabulary_with_the_librarys_rules():
    same(t.vocabulary_of(t.model_path()), ODD)


def test_random_vocabularies_with_ties():
    rng = random.Random(1)
    for byte_fallback in (False, True):
        for scores in ((-1.0, -2.0), (-0.1, -0.2, -0.3, -0.7), (0.0,)):
            pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 5))) for _ in range(60)} - {"c"}
            vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] * byte_fallback + [(p, rng.choice(scores)) for p in sorted(pieces)]
            texts = ["".join(rng.choice("aabbcx \n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
            same(vocabulary, texts, byte_fallback=byte_fallback)


def test_table_is_counted_as_the_library_does(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    lib = library(t.vocabulary_of(t.model_path()))
    assert {r.doc_id: r.n_tokens for r in t.op5_token_counts(spark, sf_dir).collect()} == {i: len(lib.encode(x or "", add_special_tokens=False).ids) for i, x in docs.items()}


def test_nulls_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (1, "a b", 6, None), (None, "a b", 7, "y")], "doc_id long, text string, n_tokens int, extra string")
    out = t.token_counts(docs, [("<unk>", 0.0), ("▁a", -1.0), ("▁b", -1.0)], byte_fallback=False)
    assert out.columns == ["doc_id", "extra", "n_tokens"] and sorted(r.n_tokens for r in out.collect()) == [0, 2, 2]
    assert t.token_counts(docs.limit(0), [("<unk>", 0.0)]).count() == 0


def test_a_long_word_takes_no_more_than_the_longest_piece():
    own = t.Counter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -1.5), ("aaa", -1.9)], byte_fallback=False)
    assert own.longest == 5 and own.counts(pa.array(["a" * 600_001])).tolist() == [200_002]
