import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from test_decontaminate import brute as leaks
from test_mixing import filled
from test_quality import brute as rules
from tokenizers import Tokenizer

import corpus_pipeline as p
from lexiqua.llm import mixing, quality, token_files
from lexiqua.llm._common import new_path


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def first_of_each(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return sorted({min(rows[x][0] for x in range(len(rows)) if find(x) == find(i)) for i in range(len(rows)) if sets[i]} | {r[0] for r, s in zip(rows, sets, strict=True) if not s})


def epochs(rows):
    """How often each document is taken: whole epochs of its source, and of one more those that fit in order of the ids' digests."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of, out = {}, Counter()
    for r in rows:
        of.setdefault(r[2], []).append(r)
    sizes = {s: sum(size(r[1]) for r in own) for s, own in of.items()}
    target = filled(sizes)
    for s, own in of.items():
        assert len(own) <= mixing.BUCKET_ROWS  # one bucket, so the digests alone order it
        whole, rest = divmod(int(target[s] + 0.5), sizes[s]) if sizes[s] else (0, 0)
        before = 0
        for doc_id, text, _ in sorted(own, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
            n = size(text)
            out[doc_id] += whole + (n > 0 and 2 * before + n <= 2 * rest)
            before += n
    return +out


def check_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in p.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "quality rules":
            verdict = {r[0]: r for r in rules(rows, quality.LIMIT_DOCS, quality.LIMIT_SHARE)}
            want = [(d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in verdict[d][7]) if verdict[d][7] else t) for d, t, _ in rows if verdict[d][-1]]
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(want)
        elif name == "near duplicates":
            assert sorted(r.doc_id for r in out.collect()) == first_of_each([r[:2] for r in rows])
        elif name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in leaks([r[:2] for r in rows], bench) if not r[-1])
        elif name == "mixing":
            assert Counter(r.doc_id for r in out.collect()) == epochs(rows)
        else:
            own, start, want = Tokenizer.from_file(token_files.tokenizer_path()), 0, []
            for d, t, _ in rows:
                ids = [*own.encode(t, add_special_tokens=False).ids, 2]
                want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert [tuple(r) for r in out.orderBy("start").collect()] == want
            break
        assert out.columns == columns
        docs = out
        rows = [(r.doc_id, r.text, r.source) for r in out.orderBy("_metadata.file_name", "_metadata.row_index").collect()]


def test_each_stage_against_brute_force(spark, sf_dir):
    check_stages(spark, sf_dir)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows, bench=()):
    spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def odd_rows():
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(500)) for _ in range(n))
    rows = [(i, f"{said(20)}\n{said(12)}", rng.choice(["a", "b", None])) for i in range(40)]
    return rows + [(50, None, "a"), (51, "", None), (52, " \n\t", "b"), (53, said(60_000), "a"), (54, rows[3][1] + " end", "a"), (55, rows[4][1], "b"), rows[5], rows[5]], said


def test_odd_rows(spark, tmp_path):
    rows, said = odd_rows()
    bench = said(12)
    check_stages(spark, folder(spark, tmp_path, [*rows, (60, f"{said(30)} {bench} {said(9)}", "a")], [(1, bench), (2, None), (3, "")]))


def test_null_ids_and_no_rows(spark, tmp_path):
    rows, _ = odd_rows()
    assert p.run(spark, folder(spark, tmp_path / "nulls", [(None, t, s) for _, t, s in rows])).count() > 0
    assert p.run(spark, folder(spark, tmp_path / "none", [])).count() == 0


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    assert sorted(map(str, p.run(spark, sf_dir).collect())) == sorted(map(str, p.run(spark, sf_dir).collect()))
