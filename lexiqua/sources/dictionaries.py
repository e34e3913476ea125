"""JSON dictionaries as tables: one row for each entry, its senses in one shape whatever the file holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENSE = "struct<gloss:string,formula:string,exec:string,definition:string,synonyms:array<string>,start_year:int,end_year:int>"
#: Kinds of relation that entries may state.
RELATIONS = ["is a", "type of", "class of", "category of", "related to", "see also", "synonyms"]


def read_entries(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``file, ord, key, listed, senses, raw`` of all ``*.json`` in a folder; ``listed`` entries are those of list-shaped files, keyed by place.

    A value is a text (one sense with that gloss), an object (one sense) or a list of either. Files that can't be parsed
    have no entries. Order is that of file names, then of places. Each file is one value, as a JSON document has to be: files of
    megabytes, as many as there are; a corpus of records belongs into JSON lines.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=recursive)
    files = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.try_parse_json("value").alias("v"))
    items = spark.sql("SELECT file, e.pos AS ord, coalesce(e.key, cast(e.pos AS string)) AS key, e.key IS NULL AS listed, e.value AS raw FROM {files}, LATERAL variant_explode(v) AS e", files=files)
    get = lambda x, name, kind: F.try_variant_get(x, f"$.{name}", kind)

    def sense(x):
        plain = F.schema_of_variant(x) == "STRING"
        year = get(x, "year", "int")
        return F.struct(
            F.when(plain, F.try_variant_get(x, "$", "string")).otherwise(get(x, "gloss", "string")).alias("gloss"), get(x, "formula", "string").alias("formula"), get(x, "exec", "string").alias("exec"), get(x, "definition", "string").alias("definition"),
            get(x, "synonyms", "array<string>").alias("synonyms"), F.coalesce(get(x, "start_year", "int"), year).alias("start_year"), F.coalesce(get(x, "end_year", "int"), year).alias("end_year"),
        ).cast(SENSE)

    is_list = F.schema_of_variant("raw").startswith("ARRAY")
    many = F.transform(F.try_variant_get("raw", "$", "array<variant>"), sense)
    return items.withColumn("senses", F.when(is_list, many).otherwise(F.array(sense(F.col("raw"))))).select("file", "ord", "key", "listed", "senses", "raw")


def subject_definitions(entries: DataFrame) -> DataFrame:
    """The last entry of each lower-cased key; list-shaped files have none."""
    last = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("file"), F.desc("ord")))
    return entries.filter(~F.col("listed")).withColumn("term", F.lower("key")).withColumn("_n", last).filter("_n = 1").select("term", "file", "senses")


def knowledge(entries: DataFrame) -> DataFrame:
    """Entries of all files merged by key: ``term, definitions, formulas, execs, sources``, each in order of appearance."""
    keyed = entries.withColumn("term", F.when(F.col("listed"), F.regexp_replace("file", r"\.json$", "")).otherwise(F.col("key")))
    each = keyed.select("term", "file", "ord", F.posexplode("senses").alias("no", "s"))
    gather = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("file", "ord", "no", c.alias("x"))))), lambda r: r["x"])
    told = F.flatten(gather(F.filter(F.array("s.definition", "s.gloss"), lambda x: x.isNotNull())))
    return each.groupBy("term").agg(told.alias("definitions"), gather(F.col("s.formula")).alias("formulas"), gather(F.col("s.exec")).alias("execs"), F.array_sort(F.collect_set("file")).alias("sources"))


def relations(entries: DataFrame) -> DataFrame:
    """``term, kind, value`` of the relations that entries, or their senses, state."""
    is_list = F.schema_of_variant("raw").startswith("ARRAY")
    each = entries.select(F.col("key").alias("term"), F.explode(F.when(is_list, F.try_variant_get("raw", "$", "array<variant>")).otherwise(F.array("raw"))).alias("v"))

    def stated(kind: str):
        at = f"$['{kind}']"
        values = F.coalesce(F.try_variant_get("v", at, "array<string>"), F.array(F.try_variant_get("v", at, "string")))
        return F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    all_kinds = F.flatten(F.array(*map(stated, RELATIONS)))
    return each.filter(F.schema_of_variant("v").startswith("OBJECT")).select("term", F.explode(all_kinds).alias("r")).select("term", "r.kind", "r.value")


def year_spans(entries: DataFrame) -> DataFrame:
    """``file, key, start, end`` of senses with both years."""
    return entries.select("file", "key", F.explode("senses").alias("s")).filter("s.start_year IS NOT NULL AND s.end_year IS NOT NULL").select("file", "key", F.col("s.start_year").alias("start"), F.col("s.end_year").alias("end"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def concepts(entries: DataFrame) -> DataFrame:
    """The last value of each lower-cased key, as JSON; the objects in list-shaped files give their own keys."""
    plain = entries.filter(~F.col("listed")).select("file", "ord", F.lit(0).alias("pos"), "key", "raw")
    objects = entries.filter(F.col("listed") & F.schema_of_variant("raw").startswith("OBJECT"))
    inner = entries.sparkSession.sql("SELECT file, ord, e.pos, e.key, e.value AS raw FROM {o}, LATERAL variant_explode(raw) AS e", o=objects)
    both = plain.unionByName(inner).withColumn("concept", F.lower("key")).select("file", "ord", "pos", "concept", F.to_json("raw").alias("value"))
    return both.groupBy("concept").agg(F.max_by(F.struct("file", "value"), F.struct("file", "ord", "pos")).alias("l")).select("concept", "l.file", "l.value")


def definitions(entries: DataFrame) -> DataFrame:
    """``term, senses`` of the terms that are defined: their definitions as senses of a gloss alone."""
    return knowledge(entries).filter(F.size("definitions") > 0).select("term", F.transform("definitions", lambda d: F.struct(d.alias("gloss"))).alias("senses"))


def read_json(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """``pos, key, value`` (a variant) of one JSON document; of a list the places are keys. A missing file has no rows if it is ``optional``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        if not optional:
            raise FileNotFoundError(path)
        return spark.sql("SELECT 0 AS pos, '' AS key, parse_json('null') AS value LIMIT 0")
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return spark.sql("SELECT e.pos, coalesce(e.key, cast(e.pos AS string)) AS key, e.value FROM {w}, LATERAL variant_explode(v) AS e", w=whole)


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """``word, subject`` of an object of lists; none if the file is missing."""
    return read_json(spark, path).select(F.col("key").alias("word"), F.explode(F.try_variant_get("value", "$", "array<string>")).alias("subject"))


def read_list(spark: SparkSession, path: str, schema: str, within: str | None = None) -> DataFrame:
    """``ord`` and the fields of ``schema`` of a list of objects (templates, code relationships), or of the list ``within`` an object."""
    rows = read_json(spark, path)
    if within is not None:
        rows = spark.sql("SELECT e.pos, e.value FROM {r} AS r, LATERAL variant_explode(r.value) AS e", r=rows.filter(F.col("key") == within))
    return rows.select(F.col("pos").alias("ord"), F.from_json(F.to_json("value"), schema).alias("o")).select("ord", "o.*")
