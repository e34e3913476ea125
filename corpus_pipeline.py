"""A training corpus from ``documents``: quality rules, near-duplicate join, decontamination, mixing, token files."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm import decontaminate, jaccard_join, mixing, quality, token_files
from lexiqua.llm._common import delete, new_folder, new_path, scratch

#: Near duplicates share 80 % of their five-word shingles.
WORDS, PERCENT = 5, 80


#: Scratch of the stage before, for each thread.
_before: ContextVar[tuple[str, ...]] = ContextVar("before", default=())


def _stage(first: bool = False) -> Callable:
    """A stage that deletes the scratch of the one before, whose rows are written by then."""

    def around(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:
                delete(spark, list(_before.get()))
            _before.set(())
            with scratch() as made:
                out = f(spark, docs, sf_dir)
            _before.set(tuple(made))
            return out

        return run

    return around


@_stage(first=True)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines above their host's limit."""
    return quality.cleaned(docs)


@_stage()
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard_join.one_of_each(docs, WORDS, PERCENT)


@_stage()
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage()
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each epoch of their source."""
    return mixing.mixed_documents(docs)


@_stage()
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in its order, which is that of the numbered files and of the rows in them; a row for each document in them, read back."""
    folder = new_folder(spark, "tokens")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", file.alias("file"), F.col("_metadata.row_index").alias("row"))
    manifest = token_files.write_shards(placed, folder, token_files.tokenizer_path(), end_id=2, place=("file", "row"))
    return token_files.read_shards(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", without_benchmarks), ("mixing", mixed), ("token files", tokens)]
#: SQL has no tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
