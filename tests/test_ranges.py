import io
import json
import random

import pytest

from lexiqua.sources import notes, ranges


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_files_of_one_name_are_several_files(spark, tmp_path):
    put(tmp_path / "src/a/x.md", b"A1\nA2\nA3\n")
    put(tmp_path / "src/b/x.md", b"B1\nB2\n")
    put(tmp_path / "src/odd name %41/x.md", "é1\r\né2".encode())
    doc = lambda i, path, a, b: {"id": i, "path": path, "range": {"start": a, "end": b}, "title": "t", "tags": [], "notes": [], "text": "old"}
    docs = [doc("1", "a/x.md", 1, 2), doc("2", "./b/x.md", 2, 9), doc("3", "x.md", 1, 1), doc("4", "odd name %41/x.md", 2, 2), doc("5", "b/x.md", 3, 4)]
    (tmp_path / "n.json").write_text(json.dumps({"documents": docs}))
    told = notes.load_notes(spark, str(tmp_path / "n.json"))
    got = {r.id: (r.text, len(r.errors)) for r in notes.refreshed(told, notes.lines_of(spark, str(tmp_path / "src"), notes.ranges_of(told))).collect()}
    assert got == {"1": ("A1\nA2", 0), "2": ("B2", 0), "3": ("old", 1), "4": ("é2", 0), "5": ("old", 1)}
    data = notes.refresh(spark, str(tmp_path / "n.json"), str(tmp_path / "src"))
    assert [d["text"] for d in data["documents"]] == ["A1\nA2", "B2", "old", "é2", "old"] and len(data["_refresh_errors"]) == 2
    every = {(r.path, r.no): r.line for r in notes.lines_of(spark, str(tmp_path / "src")).collect()}
    assert every[("odd name %41/x.md", 1)] == "é1\r" and len(every) == 7


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_slices_give_each_line_once(monkeypatch, size):
    """Whatever the slices and blocks, a file's lines are those of the whole file."""
    rng = random.Random(size)
    monkeypatch.setattr(ranges, "BLOCK", 5)
    for _ in range(60):
        data = bytes(rng.choice(b"ab\n\n") for _ in range(rng.randint(1, 40)))
        whole = data.split(b"\n")[: -1 if data.endswith(b"\n") else None]
        for asked in ([(1, 10**9)], [(2, 3), (3, 5)], [(4, 4)], [(50, 60)]):
            got, before = [], 0
            for at in range(0, len(data), size):
                length = min(size, len(data) - at)
                got += ranges.asked_lines(io.BytesIO(data), at, length, len(data), before, asked)
                before += data[at : at + length].count(b"\n")
            assert got == [(i, x) for i, x in enumerate(whole, 1) if any(a <= i <= b for a, b in asked)]


def test_few_lines_of_a_large_file(spark, tmp_path):
    with open(tmp_path / "large.txt", "wb") as f:
        for low in range(0, 2_000_000, 10_000):
            f.write(b"".join(b"line %d of a large file\n" % i for i in range(low + 1, low + 10_001)))
    put(tmp_path / "empty.txt", b"")
    asked = spark.createDataFrame([("large.txt", 1, 1), ("large.txt", 1_234_567, 1_234_568), ("large.txt", 1_999_999, 3_000_000), ("empty.txt", 1, 5), (None, 1, 2), ("large.txt", None, 2)], "path string, start int, end int")
    got = ranges.lines(spark, str(tmp_path), asked, slice_bytes=1 << 20).collect()
    assert sorted((r.no, r.line) for r in got) == [(i, f"line {i} of a large file") for i in (1, 1_234_567, 1_234_568, 1_999_999, 2_000_000)]


def test_a_file_is_replaced_by_one_rename(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    for text in ("one", "two é", ""):
        notes.write_text(spark, path, text)
        assert (tmp_path / "t.txt").read_text() == text and not (tmp_path / "t.txt.new").exists()
