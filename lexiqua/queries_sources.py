"""Queries over sources and sinks: files are written from the supplied tables to a scratch folder and read back, with SQL for the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.operators import lookup
from lexiqua.plans import sessions
from lexiqua.queries import _RANKED, _session, _t, query
from lexiqua.sources import dictionaries, notes


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; it goes when the driver's JVM ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(found or f'file://{tempfile.gettempdir()}/lexiqua-shared').rstrip('/')}/files-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def _dictionaries(spark: SparkSession, sf_dir: str) -> str:
    """A JSON dictionary for each type of part (its names, each with the first part's size), a list-shaped file, and one that is broken."""
    part = _t(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.min_by("p_size", "p_partkey").alias("size"), F.min_by("p_brand", "p_partkey").alias("brand"))
    sense = F.struct(F.concat(F.lit("A part of size "), F.col("size").cast("string")).alias("gloss"), F.concat(F.col("size").cast("string"), F.lit(" * x")).alias("formula"), F.array("brand").alias("synonyms"), F.col("size").alias("start_year"), (F.col("size") + 9).alias("end_year"), F.col("brand").alias("is a"))
    files = part.groupBy("p_type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_name", F.array(sense).alias("s")))))).alias("j"))
    folder = _folder(spark)
    for r in files.collect():  # a file for each of a few types
        notes.write_text(spark, f"{folder}/{r.p_type.lower()}.json", r.j)
    notes.write_text(spark, f"{folder}/listed.json", json.dumps([{"Red Ring": "one"}, {"gloss": "two", "New": 3}]))
    notes.write_text(spark, f"{folder}/broken.json", "{bad json")
    return folder


_FIRST = "e AS (SELECT lower(p_type) || '.json' AS file, p_name AS key, arg_min(p_size, p_partkey) AS size, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1, 2)"


@query(f"WITH {_FIRST} SELECT file, key, 'A part of size ' || size AS gloss, brand AS synonyms FROM e UNION ALL SELECT 'listed.json', '0', NULL, NULL UNION ALL SELECT 'listed.json', '1', 'two', NULL")
def src1_dictionary_files(spark, sf_dir):
    e = dictionaries.read_entries(spark, _dictionaries(spark, sf_dir))
    first = F.get("senses", F.lit(0))
    return e.select("file", "key", first["gloss"].alias("gloss"), F.array_join(first["synonyms"], ",").alias("synonyms"))


@query(f"WITH {_FIRST} SELECT key AS term, array_to_string(list('A part of size ' || size ORDER BY file), '|') AS definitions, array_to_string(list(size || ' * x' ORDER BY file), '|') AS formulas, array_to_string(list(file ORDER BY file), '|') AS sources FROM e GROUP BY key UNION ALL SELECT 'listed', 'two', '', 'listed.json'")
def src2_knowledge(spark, sf_dir):
    """SRC-2 and AGG-5: files below a folder merged by term."""
    k = dictionaries.knowledge(dictionaries.read_entries(spark, _dictionaries(spark, sf_dir), recursive=True))
    return k.select("term", *(F.array_join(c, "|").alias(c) for c in ("definitions", "formulas", "sources")))


@query(f"WITH {_FIRST} SELECT lower(key) AS term, max(file) AS file, 'A part of size ' || arg_max(size, file) AS gloss FROM e GROUP BY 1")
def src3_subject_definitions(spark, sf_dir):
    d = dictionaries.subject_definitions(dictionaries.read_entries(spark, _dictionaries(spark, sf_dir)))
    return d.select("term", "file", F.get("senses", F.lit(0))["gloss"].alias("gloss"))


@query(f"WITH {_FIRST}, a AS (SELECT lower(key) AS concept, file, 'A part of size ' || size AS gloss FROM e UNION ALL SELECT * FROM (VALUES ('red ring', 'listed.json', NULL), ('gloss', 'listed.json', NULL), ('new', 'listed.json', NULL)) v) SELECT concept, max(file) AS file, arg_max(coalesce(gloss, ''), file) AS gloss FROM a GROUP BY 1")
def src4_concepts(spark, sf_dir):
    c = dictionaries.concepts(dictionaries.read_entries(spark, _dictionaries(spark, sf_dir)))
    return c.select("concept", "file", F.coalesce(F.get_json_object("value", "$[0].gloss"), F.lit("")).alias("gloss"))


@query(f"WITH {_FIRST} SELECT key AS term, count(*) AS senses, 'A part of size ' || arg_min(size, file) AS first FROM e GROUP BY 1 UNION ALL SELECT 'listed', 1, 'two'")
def src5_definitions(spark, sf_dir):
    d = dictionaries.definitions(dictionaries.read_entries(spark, _dictionaries(spark, sf_dir)))
    return d.select("term", F.size("senses").cast("long").alias("senses"), F.get("senses", F.lit(0))["gloss"].alias("first"))


@query("SELECT DISTINCT p_type AS word, p_brand AS subject FROM part")
def src6_thesaurus(spark, sf_dir):
    """SRC-6: one JSON file; one that isn't there has no rows."""
    words = _t(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    folder = _folder(spark)
    notes.write_text(spark, f"{folder}/t.json", words.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "b"))))).first()[0])
    return dictionaries.read_thesaurus(spark, f"{folder}/t.json").unionByName(dictionaries.read_thesaurus(spark, f"{folder}/none.json"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS term, CAST(n_regionkey AS INT) AS region FROM nation")
def src6_relationships(spark, sf_dir):
    """SRC-6: a list of objects inside an object."""
    rows = _t(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("l"))
    folder = _folder(spark)
    notes.write_text(spark, f"{folder}/r.json", rows.select(F.to_json(F.struct(F.transform("l", lambda x: F.struct(x["n_name"].alias("term"), x["n_regionkey"].alias("region"))).alias("relationships")))).first()[0])
    return dictionaries.read_list(spark, f"{folder}/r.json", "term STRING, region INT", "relationships").select(F.col("ord").cast("long").alias("ord"), "term", "region")


@query("SELECT DISTINCT lower(p_name) AS word FROM part")
def src7_word_list(spark, sf_dir):
    words = _t(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" "))).unionAll(spark.createDataFrame([("",), ("  ",)], "w string"))
    path = f"{_folder(spark)}/words"
    words.write.text(path)
    return dictionaries.word_list(spark, path)


def _notes(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A notes file on ranges of a file with a nation on each line, and the folder of that file. Note 24 is of a file that isn't there."""
    names = [r[0] for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    folder = _folder(spark)
    notes.write_text(spark, f"{folder}/src/nations.txt", "\n".join(names) + "\n")
    docs = [{"id": str(i), "path": "nations.txt" if i < 24 else "none.txt", "range": {"start": i + 1, "end": i + 3}, "title": n, "tags": [n[-1]], "notes": [], "text": "old"} for i, n in enumerate(names)]
    notes.write_text(spark, f"{folder}/notes.json", json.dumps({"schema_version": 1, "repo": "r", "generated_at": "x", "documents": docs}))
    return f"{folder}/notes.json", f"{folder}/src"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, CASE WHEN n_nationkey < 24 THEN 'nations.txt' ELSE 'none.txt' END || ':' || (n_nationkey + 1) || '-' || (n_nationkey + 3) AS place, right(n_name, 1) AS tags FROM nation")
def src8_notes_listed(spark, sf_dir):
    """SRC-8 and PRJ-7."""
    return notes.listing(notes.load_notes(spark, _notes(spark, sf_dir)[0])).withColumn("tags", F.array_join("tags", ","))


_LINES = "SELECT CAST(a.n_nationkey AS VARCHAR) AS id, CASE WHEN a.n_nationkey < 24 THEN string_agg(b.n_name, chr(10) ORDER BY b.n_nationkey) ELSE 'old' END AS text FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey AND a.n_nationkey + 2 GROUP BY a.n_nationkey"


def _refreshed(spark: SparkSession, path: str, folder: str):
    told = notes.load_notes(spark, path)
    return notes.refreshed(told, notes.lines_of(spark, folder, notes.ranges_of(told)))


@query(f"SELECT *, CASE WHEN id = '24' THEN 1 ELSE 0 END AS errors FROM ({_LINES})")
def src9_line_ranges(spark, sf_dir):
    """SRC-9 and JOIN-13: the lines of each range."""
    path, folder = _notes(spark, sf_dir)
    return _refreshed(spark, path, folder).select("id", "text", F.size("errors").alias("errors"))


@query(_LINES)
def snk2_refreshed_notes(spark, sf_dir):
    """The notes file after it is rewritten."""
    path, folder = _notes(spark, sf_dir)
    data = notes.refresh(spark, path, folder)
    if len(data["_refresh_errors"]) != 1 or data["generated_at"] == "x":
        raise AssertionError("the file's own fields are not refreshed")
    return notes.load_notes(spark, path).select("id", "text")


@query("SELECT CAST(n_nationkey + 1 AS INT) AS no, n_name AS line FROM nation WHERE contains(n_name, '_2')")
def flt9_line_search(spark, sf_dir):
    return notes.matching_lines(notes.lines_of(spark, _notes(spark, sf_dir)[1]), " _2 ").select(F.col("no").cast("int").alias("no"), "line")


@query(
    """WITH RECURSIVE p AS (SELECT 'part/' || p_partkey AS path, p_size * 1000 AS size, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_size * 1000 <= 32000),
g AS (SELECT 0 AS n, 0 AS used, '' AS path, false AS took UNION ALL SELECT p.n, CASE WHEN used + size <= 128000 THEN used + size ELSE used END, p.path, used + size <= 128000 FROM g JOIN p ON p.n = g.n + 1)
SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INT) AS no, path FROM g WHERE took"""
)
def src10_gathered(spark, sf_dir):
    files = _t(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") * 1000).cast("long").alias("size"), F.col("p_partkey").alias("ord"))
    return notes.gathered(files)


@query(f'WITH {_RANKED} SELECT \'s1\' AS session_id, variable, value, score, rank, CASE WHEN variable = \'redwidget1\' THEN true ELSE false END AS explored FROM ranked')
def src11_saved_session(spark, sf_dir):
    """SRC-11, SNK-1 and SES-2: a session saved and loaded, with what is explored."""
    folder = f"{_folder(spark)}/sessions"
    sessions.save(sessions.mark_explored(_session(spark, sf_dir), "redwidget1"), folder)
    return sessions.load(spark, folder, "s1").select("session_id", "variable", "value", "score", F.col("rank").cast("long").alias("rank"), "explored")


@query("SELECT r_name AS id, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE lower(r_name) END AS new FROM region WHERE r_regionkey <> 2")
def src12_pending_store(spark, sf_dir):
    """SRC-12, SNK-3 and FLT-1: a store that isn't there is made; rows are put in, replaced, taken out."""
    path = f"{_folder(spark)}/pending.json"
    kind = notes.load_pending(spark, path).schema["parsed"].dataType
    made = lambda new: F.from_json(F.to_json(F.struct(F.lit("a").alias("old"), new.alias("new"))), kind.simpleString()).alias("parsed")
    region = _t(spark, sf_dir, "region")
    row = lambda df, new: df.select(F.col("r_name").alias("id"), F.lit("2024").alias("created_at"), made(new))
    notes.save_pending(notes.upsert(notes.load_pending(spark, path), row(region, F.lower("r_name"))), path)
    notes.save_pending(notes.upsert(notes.load_pending(spark, path), row(region.filter("r_regionkey = 1"), F.lit("changed"))), path)
    notes.save_pending(notes.without(notes.load_pending(spark, path), region.filter("r_regionkey = 2").select(F.col("r_name").alias("id"))), path)
    store = notes.load_pending(spark, path)
    found = notes.get_by_id(store, region.filter("r_regionkey = 1").first().r_name)
    return store.join(found.select("id"), "id", "left_anti").unionByName(found).select("id", F.col("parsed.new").alias("new"))


def _layered(spark: SparkSession, sf_dir: str) -> str:
    layers = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = layers.orderBy("n_regionkey").collect()
    path = f"{_folder(spark)}/layers.json"
    notes.write_text(spark, path, json.dumps({"entry": "e", "language": "l", "layers": [{"name": f"layer{r.n_regionkey}", "actions": [[x.n_name for x in r.n]]} for r in rows]}))
    return path


_LAYERS = "n AS (SELECT n_regionkey AS place, 'layer' || n_regionkey AS layer, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS line, n_name AS old FROM nation), p AS (SELECT *, CAST(row_number() OVER (ORDER BY place, line) - 1 AS INT) AS no FROM n WHERE contains(old, 'NATION_1'))"


@query(f"WITH {_LAYERS} SELECT no, layer, line, old, replace(old, 'NATION_1', 'N') AS new FROM p WHERE no IN (0, 2, 3)")
def flt10_planned_replacements(spark, sf_dir):
    docs = spark.read.text(_layered(spark, sf_dir), wholetext=True).select(F.from_json("value", notes.LAYERED).alias("d")).select("d.layers")
    return notes.planned_replacements(docs, "NATION_1", "N", selected=[0, 2, 3]).select("no", "layer", "line", "old", "new")


@query(f"WITH {_LAYERS} SELECT n.layer, n.line, CASE WHEN p.no IN (0, 2, 3) THEN replace(n.old, 'NATION_1', 'N') ELSE n.old END AS text, n.old AS before FROM n LEFT JOIN p USING (layer, line)")
def snk4_replaced_in_place(spark, sf_dir):
    """The document after its selected lines are replaced in place, beside what the copy kept of it."""
    path = _layered(spark, sf_dir)
    if notes.apply_replacements(spark, path, "NATION_1", "N", dry_run=True)["written_to"] is not None or notes.apply_replacements(spark, path, "NATION_1", "N", selected=[0, 2, 3], inplace=True)["applied"] != 3:
        raise AssertionError("a dry run wrote, or other lines were replaced")
    lines = lambda p, c: spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", notes.LAYERED)["layers"]).alias("l")).select(F.col("l.name").alias("layer"), F.posexplode(F.col("l.actions")[0]).alias("line", c))
    return lines(path, "text").join(lines(f"{path}.bak", "before"), ["layer", "line"])


@query(f"WITH {_FIRST} SELECT file, key AS place, CAST(size AS INT) AS start, CAST(size + 9 AS INT) AS \"end\" FROM e")
def prj8_year_spans(spark, sf_dir):
    """PRJ-8 and JOIN-5c."""
    return dictionaries.year_spans(dictionaries.read_entries(spark, _dictionaries(spark, sf_dir))).withColumnRenamed("key", "place")


@query(f"WITH {_FIRST} SELECT key AS term, 'is a' AS kind, brand AS value FROM e UNION ALL SELECT key, 'synonyms', brand FROM e")
def src2_relations(spark, sf_dir):
    """The relations that entries state: those of each sense in a list."""
    e = dictionaries.read_entries(spark, _dictionaries(spark, sf_dir)).filter("NOT listed")
    return dictionaries.relations(e)


@query("SELECT lower(p_type) || '.json' AS file, p_partkey AS ord FROM part WHERE p_name = 'red ring' ORDER BY file, ord LIMIT 1")
def flt1_entry_by_key(spark, sf_dir):
    """FLT-1: the first entry whose key is the wanted one as plain words."""
    e = _t(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit(".json")).alias("file"), F.col("p_partkey").alias("ord"), F.concat(F.lit("the "), F.initcap("p_name"), F.lit("_what")).alias("key"))
    return lookup.by_normal_key(e, "RED-ring").select("file", "ord")


@query(f'WITH {_RANKED} SELECT kingdom, phylum, family, "order", variable, type, value FROM ranked WHERE variable = \'redwidget1\' ORDER BY rank LIMIT 1')
def flt6_lineage(spark, sf_dir):
    return sessions.lineage(_session(spark, sf_dir), "redwidget1")
