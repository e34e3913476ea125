"""Notes on ranges of lines in files: reading, listing, search, refreshed texts; and a store of pending rows."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.sources import ranges as line_ranges

SCHEMA = "schema_version INT, repo STRING, generated_at STRING, documents ARRAY<STRUCT<id:STRING,path:STRING,range:STRUCT<start:INT,`end`:INT>,title:STRING,tags:ARRAY<STRING>,notes:ARRAY<STRING>,text:STRING>>"


class NotesError(RuntimeError):
    """A notes file that is missing, not JSON, or not an object with documents."""


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a notes file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise NotesError(f"{path} does not exist")
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    shape = raw.select(F.col("v").isNull().alias("bad"), F.schema_of_variant("v").startswith("OBJECT").alias("object")).first()
    if shape is None or shape.bad:
        raise NotesError(f"{path} is not valid JSON")
    if not shape.object:
        raise NotesError(f"{path} holds no object")
    return raw.select(F.explode(F.from_json("value", SCHEMA)["documents"]).alias("d")).select("d.*")


def listing(notes: DataFrame) -> DataFrame:
    place = F.concat(F.col("path"), F.lit(":"), F.col("range.start").cast("string"), F.lit("-"), F.col("range.end").cast("string"))
    return notes.select("id", "title", place.alias("place"), "tags")


def search(notes: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows that hold the term, in any case, in any of their text columns."""
    columns = columns or ["id", "title", "path", "text", "tags", "notes"]
    return notes.filter(F.contains(F.lower(_joined(columns)), F.lit(term.lower())))


def _joined(columns: list[str]) -> Column:
    return F.concat_ws(" ", *columns)


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def lines_of(spark: SparkSession, folder: str, ranges: DataFrame | None = None) -> DataFrame:
    """``path, no, line`` of the files below a folder; see ``ranges.lines``."""
    return line_ranges.lines(spark, folder, ranges)


def ranges_of(notes: DataFrame) -> DataFrame:
    """``path, start, end`` that the notes are on; a range without an end is one line, one without a start begins at 1."""
    start = F.coalesce("range.start", F.lit(1))
    return notes.select(_plain_path(F.col("path")).alias("path"), start.alias("start"), F.coalesce("range.end", start).alias("end"))


def _plain_path(c: Column) -> Column:
    """A path from the folder on, without dots in front."""
    return F.regexp_replace(c, r"^(?:\./+)+", "")


def refreshed(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """Notes with the text of their range, clamped to the file's end, and ``errors`` where the file or range isn't there.

    Notes find their file by its whole path below the folder of ``lines``. Notes of one id and equal ids of several notes are rows each.
    """
    start = F.coalesce("range.start", F.lit(1))
    numbered = notes.withColumn("_no", F.monotonically_increasing_id())
    asked = numbered.select("_no", _plain_path(F.col("path")).alias("_path"), start.alias("_start"), F.coalesce("range.end", start).alias("_end"))
    met = asked.join(lines, (F.col("_path") == F.col("path")) & F.col("no").between(F.col("_start"), F.col("_end")))
    found = met.groupBy("_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("_text"))
    out = numbered.join(found, "_no", "left")
    errors = F.when(F.col("_text").isNull(), F.array(F.concat(F.lit("no such lines: "), F.coalesce("path", F.lit(""))))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("errors", errors).withColumn("text", F.coalesce("_text", "text")).drop("_no", "_text")


def matching_lines(lines: DataFrame, wanted: str) -> DataFrame:
    """Lines that are the wanted text when trimmed; where there is none, lines that hold it."""
    tiered = lines.withColumn("tier", F.when(F.trim("line") == wanted.strip(), 1).when(F.contains("line", F.lit(wanted.strip())), 2)).filter("tier IS NOT NULL")
    best = tiered.groupBy("path").agg(F.min("tier").alias("_best")).withColumnRenamed("path", "_path")
    return tiered.join(best, (F.col("path") == F.col("_path")) & (F.col("tier") == F.col("_best"))).drop("_path", "_best")


def planned_replacements(layers: DataFrame, old: str, new: str, regex: bool = False, layer: str | None = None, selected: list[int] | None = None) -> DataFrame:
    """``no, layer, para, line, old, new`` for each line of layered documents (``layers: array<struct<name, actions: array<array<string>>>>``) that
    would change, numbered in order; with ``selected``, only of these numbers."""
    rows = layers.select(F.posexplode("layers").alias("at", "l")).select("at", F.col("l.name").alias("layer"), F.posexplode("l.actions").alias("para", "lines")).select("at", "layer", "para", F.posexplode("lines").alias("line", "old"))
    rows = rows if layer is None else rows.filter(F.col("layer") == layer)
    changed = F.regexp_replace("old", F.lit(old), F.lit(new)) if regex else F.replace("old", F.lit(old), F.lit(new))
    planned = rows.withColumn("new", changed).filter("new <> old").withColumn("no", F.row_number().over(Window.orderBy("at", "para", "line")) - 1)
    planned = planned.select("no", "layer", "para", "line", "old", "new")
    return planned if selected is None else planned.filter(F.col("no").isin(selected) if selected else F.lit(False))


LAYERED = "entry STRING, language STRING, layers ARRAY<STRUCT<name: STRING, actions: ARRAY<ARRAY<STRING>>>>"


def apply_replacements(spark: SparkSession, path: str, old: str, new: str, regex: bool = False, layer: str | None = None, selected: list[int] | None = None, out: str | None = None, inplace: bool = False, dry_run: bool = False) -> dict:
    """Apply planned replacements to a layered document: ``{"applied": n, "written_to": path or None}``.

    In place, the file as it was is kept beside it with ``.bak`` behind its name. A dry run, or neither ``out`` nor ``inplace``, writes
    nothing. Of a document that someone edits by hand, so the driver holds it and its changes.
    """
    text = spark.read.text(path, wholetext=True).first()
    whole = json.loads(text[0]) if text else {}
    docs = spark.createDataFrame([(json.dumps(whole),)], "v string").select(F.from_json("v", LAYERED).alias("d")).select("d.layers")
    plan = planned_replacements(docs, old, new, regex, layer, selected).collect()
    named = {x.get("name"): x for x in reversed(whole.get("layers", []))}
    for r in plan:
        named[r.layer]["actions"][r.para][r.line] = r.new
    to = None if dry_run or not plan else path if inplace else out
    if to is not None:
        if inplace:
            write_text(spark, f"{path}.bak", text[0])
        write_text(spark, to, json.dumps(whole, indent=2, ensure_ascii=False))
    return {"applied": len(plan), "written_to": to}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file: under another name first, then in its place by one rename, so that readers see the old one or the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    store = at.getFileSystem(configuration)
    stream = store.create(staged, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), configuration).rename(store.makeQualified(staged), store.makeQualified(at), how)


def refresh(spark: SparkSession, path: str, folder: str) -> dict:
    """Rewrite a notes file with the texts of its ranges as the files below ``folder`` have them now, the time (``generated_at``, UTC) and ``_refresh_errors``."""
    notes = load_notes(spark, path)
    rows = {r.id: r for r in refreshed(notes, lines_of(spark, folder, ranges_of(notes))).select("id", "text", "errors").collect()}
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    errors = []
    for doc in data.get("documents", []):
        r = rows.get(doc.get("id"))
        if r is not None and not r.errors:
            doc["text"] = r.text
        errors += [f"{doc.get('id', '?')}: {e}" for e in (r.errors if r is not None else ["no id"])]
    data |= {"generated_at": datetime.now(UTC).isoformat(), "_refresh_errors": errors}
    write_text(spark, path, json.dumps(data, indent=2, ensure_ascii=False))
    return data


PENDING = "id STRING, created_at STRING, parsed STRUCT<old: STRING, new: STRING, apply: BOOLEAN, dry_run: BOOLEAN, regex: BOOLEAN, layer: STRING, path: STRING>"


def load_pending(spark: SparkSession, path: str) -> DataFrame:
    """The store of pending changes; an absent one is made, and one that can't be read is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        write_text(spark, path, "[]")
    listed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"ARRAY<STRUCT<{PENDING}>>").alias("l"))
    return listed.select(F.explode("l").alias("p")).filter("p.id IS NOT NULL").select("p.*")


def save_pending(store: DataFrame, path: str) -> None:
    """Write the store back; changes that wait for a person are few."""
    rows = [json.loads(r[0]) for r in store.orderBy("created_at", "id").select(F.to_json(F.struct(*store.columns))).collect()]
    write_text(store.sparkSession, path, json.dumps(rows, indent=2, ensure_ascii=False))


def get_by_id(store: DataFrame, id_: str) -> DataFrame:
    return store.filter(F.col("id") == id_).limit(1)


def upsert(store: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` replace those of the store with their key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def without(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def gathered(files: DataFrame, each: int = 32_000, total: int = 128_000) -> DataFrame:
    """Of ``path, size, ord`` the files within both budgets, taken in order; one that doesn't fit is skipped and later ones may fit.

    The fold is sequential by nature; it runs over a list of paths and sizes, not over contents.
    """
    listed = files.filter(F.col("size") <= each).agg(F.array_sort(F.collect_list(F.struct("ord", "path", "size"))).alias("f"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("paths"))
    fits = lambda a, f: a["used"] + f["size"] <= total
    fold = F.aggregate("f", start, lambda a, f: F.struct((a["used"] + F.when(fits(a, f), f["size"]).otherwise(0)).cast("long").alias("used"), F.when(fits(a, f), F.concat(a["paths"], F.array(f["path"]))).otherwise(a["paths"]).alias("paths")), lambda a: a["paths"])
    return listed.select(F.posexplode(fold).alias("no", "path"))
