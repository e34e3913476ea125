"""Token-ID binary output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

Each shard is one file of ids (``.bin``: unsigned 16-bit where the vocabulary allows it, else 32-bit, little-endian)
and one of document offsets (``.idx``: 64-bit, counted from the shard's first id, one more than it has documents),
beside the documents' ids (``.ids``: 64-bit). Shards follow ascending document id; the base of a shard is the
prefix sum of the ids in the shards before it, so a document's place in the whole corpus is base + offset.

Shards are written through ``pyarrow.fs``, so the folder can be a shared POSIX folder or any store it knows.
An attempt writes under names of its own and only names in the manifest count: a lost executor or a second
attempt leaves files that nothing refers to, and ``write_shards`` deletes them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, filled, kept, new_folder, parts_for, slices, split_words, spread

MANIFEST = "shard string, first_part long, first_id long, first_hash long, n_docs long, n_ids long, width int"
DOCS = "shard string, no long, doc_id long, start long, n_tokens long, ids_crc32 long"
#: Words whose ids a Python worker keeps. Words are kept as they come, which keeps the frequent ones.
KEPT_WORDS = 600_000
#: A pretoken between words that are encoded together; words that hold it are encoded alone.
BETWEEN = "\x00"
#: Words of many kinds between each kind of ASCII white space, alone and in rows.
PROBE = " The cat's  sat,\ton\n the\r\nmat.\x0b 12 345,6 \x0c(x) [y] a-b_c \n\n Été straße 中文。 U.S. \t\t e\u0301 <s> </s> don't I'm  ...  !? end \n"


class WordEncoder:
    """The tokenizers library's own ids of whole texts, with words encoded once.

    For tokenizers whose pretokens never hold white space (word_bpe), a text's ids are those of its words between
    ASCII white space, one after another. Each word goes through the library; frequent words are kept. Whether a tokenizer is
    of this kind is tried on a probe; texts of others go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.by_word = self._apart()

    def _apart(self) -> bool:
        """Whether the probe's ids are those of its words, and no pretoken of it holds white space."""
        split = self.tokenizer.pre_tokenizer
        if split is None or any(c.isspace() for x, _ in split.pre_tokenize_str(PROBE) for c in x) or any(" " in a or not a.strip() for a in self.added):
            return False
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        return ids(PROBE) == [i for w in PROBE.split() for i in ids(w)]

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as unsigned 32-bit integers in a row."""
        odd = {i for i, w in enumerate(words) if BETWEEN in w or any(a in w for a in self.added)}
        found: list = [None] * len(words)
        for i in odd:
            found[i] = self._alone(words[i])
        plain = [i for i in range(len(words)) if i not in odd]
        for low in range(0, len(plain), 2000):
            some = plain[low : low + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(words[i] for i in some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.between[0]) if len(self.between) == 1 else []
            if len(cuts) != len(some) - 1:  # the separator isn't one id here
                parts = [self._alone(words[i]) for i in some]
            else:
                data, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
                parts = [data[start:end] for start, end in zip([0, *(e + 4 for e in ends)], ends)]
            for i, x in zip(some, parts, strict=True):
                found[i] = x
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of filled texts, each text's followed by ``end_id``, and each text's count of ids."""
        if not self.by_word:
            whole = [[*x.ids, end_id] for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in whole for i in x], np.uint32), np.array([len(x) for x in whole], np.int64)
        codes, words, first = split_words(texts)
        words = words.to_pylist()
        ids = [self.known.get(w) for w in words]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self._encoded([words[i] for i in missing]), strict=True):
            ids[i] = x
            if len(self.known) < KEPT_WORDS:
                self.known[words[i]] = x
        ids.append(np.uint32(end_id).tobytes())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        n = len(first) - 1
        sequence = np.full(len(codes) + n, len(words), np.int64)
        mask = np.ones(len(sequence), bool)
        mask[first[1:] + np.arange(n)] = False
        sequence[mask] = codes
        lengths = length[sequence]
        out = np.frombuffer(b"".join(ids), np.uint32)[spread(start[sequence], lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return out, np.diff(total[np.concatenate(([0], first[1:] + np.arange(1, n + 1)))])


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    return kept(("encoder", path), lambda: WordEncoder(path))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, place: tuple[str, str] | None = None) -> DataFrame:
    """Encode whole texts and write the shards; returns the manifest with each shard's base, in order.

    ``place`` names two columns of ``docs``, both numbers, to order documents by instead of their ids.
    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is empty (its one id is ``end_id``).
    Documents are ordered by doc_id (nulls first), then by a hash of the text and the text, so repeated ids and
    repeated rows keep one order; a hash beside the id also lets a range cut through rows of one id. A very long text is
    encoded whole, in one slice of its own; its size is bounded by what a string column can hold.
    No rows: no shards and an empty manifest.
    """
    spark = docs.sparkSession
    part, number = (F.col(c).cast("long") for c in place) if place else (F.lit(0).cast("long"), F.col("doc_id").cast("long"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), part.alias("_part"), number.alias("_no"), F.xxhash64("text").alias("_h"))
    keys = [F.asc_nulls_first("_part"), F.asc_nulls_first("_no"), F.asc("_h")]
    ranged = docs.repartitionByRange(parts_for(docs), *keys[0 if place else 1 :]).sortWithinPartitions(*keys, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own = encoder(tokenizer)
        width = 2 if own.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, out, counts, ids, first = uuid.uuid4().hex, None, [], [], None
        for batch in slices(batches, "text", keeps=True):
            if out is None:
                out = store.open_output_stream(f"{top}/{name}.bin")
                first = tuple(batch.column(c)[0].as_py() for c in ("_part", "_no", "_h"))
            values, n = own.encode(filled(batch.column("text")), end_id)
            out.write(values.astype(f"<u{width}").tobytes())
            counts.append(n)
            ids.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype("<i8")
        for end, data in ((".idx", offsets.tobytes()), (".ids", _packed(pa.concat_arrays(ids)))):
            with store.open_output_stream(f"{top}/{name}{end}") as f:
                f.write(data)
        yield pa.RecordBatch.from_pydict(
            {"shard": [name], "first_part": pa.array([first[0]], pa.int64()), "first_id": pa.array([first[1]], pa.int64()), "first_hash": pa.array([first[2]], pa.int64()), "n_docs": pa.array([len(offsets) - 1], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64()), "width": pa.array([width], pa.int32())}
        )

    manifest = cut(ranged.mapInArrow(write, MANIFEST), "shards")
    # One row for each shard: a window over all of them, not over documents.
    order = Window.orderBy(F.asc_nulls_first("first_part"), F.asc_nulls_first("first_id"), "first_hash", "shard")
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    _delete_orphans(spark, folder, {r[0] for r in manifest.select("shard").toLocalIterator()})
    return cut(based.withColumn("no", F.row_number().over(order)), "manifest")


def _packed(ids: pa.Array) -> bytes:
    """Document ids with the smallest 64-bit integer for null."""
    return ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype("<i8").tobytes()


def _delete_orphans(spark: SparkSession, folder: str, named: set[str]) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path):
        for x in store.listStatus(path):
            if x.getPath().getName().rpartition(".")[0].lstrip(".").partition(".")[0] not in named:
                store.delete(x.getPath(), False)


def mapped(store, path: str, dtype: str) -> np.ndarray:
    """A whole file as an array: memory-mapped where the store is a local or mounted folder, else read."""
    from pyarrow import fs

    if not store.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.readall(), dtype)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shards back: a row for each document with its start in the corpus, its count of ids and their checksum
    (unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers).

    Repeated documents are rows each, in the order they were written; a null id is null again. A document without tokens has its end id alone.
    An empty manifest gives no rows; files that it doesn't name are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{top}/{row['shard']}"
                ids, offsets, doc_ids = mapped(store, f"{at}.bin", f"<u{row['width']}"), mapped(store, f"{at}.idx", "<i8"), mapped(store, f"{at}.ids", "<i8")
                for low in range(0, len(doc_ids), 50_000):
                    high = min(low + 50_000, len(doc_ids))
                    sums = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(low, high)]
                    some = np.asarray(doc_ids[low:high])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array([row["shard"]] * (high - low)), "no": pa.array(np.full(high - low, row["no"]), pa.int64()),
                            "doc_id": pa.array(some, pa.int64(), mask=some == np.iinfo(np.int64).min),
                            "start": pa.array(row["base"] + np.asarray(offsets[low:high]), pa.int64()), "n_tokens": pa.array(np.diff(offsets[low : high + 1]), pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )

    n = max(manifest.count(), 1)
    return manifest.select("shard", F.col("no").cast("long").alias("no"), "base", "width").repartition(n).mapInArrow(read, DOCS)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "tokens")
    manifest = write_shards(docs, folder, tokenizer_path(), end_id=2)
    return read_shards(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
