"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training time 0..1: a piecewise linear curve. Its integral is the source's
weight in the mix; weights share out the budget, and what a source can't give (a document is taken ``max_epochs``
times at most) is shared again by weight among the others. A source's documents stand in an order of their own
(a digest of the id); the words before a document, over the source's target, invert the integrated schedule to the
training time at which the document comes, for each epoch anew. Sorting by that position mixes the sources.

Prefix sums run in two steps, over buckets of about ``BUCKET_ROWS`` documents and inside each bucket, so a source with
a third of all documents is many buckets. Texts are read once, for their size and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, parts_for

BUCKET_ROWS = 1_000
KNOTS = "array<struct<t:double,w:double>>"
WEIGHTS = (5.0, 2.0, 1.0)
#: How far a schedule leans to the start of training (its end if negative), by the place of its weight.
TILTS = (0.5, 0.0, -0.5)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ranked_schedules(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """``source, knots``: by code point, null last, the sources get ``weights`` in turn; each schedule is a line whose integral is the weight."""
    at = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), at)
    named = sources.select("source", pick(weights).alias("w"), pick(tilts).alias("tilt"))
    return named.select("source", F.expr(f"cast(array(named_struct('t', 0D, 'w', w * (1 + tilt)), named_struct('t', 1D, 'w', w * (1 - tilt))) AS {KNOTS})").alias("knots"))


#: Of a source's knots: for each segment its start, width, weights at both ends, and the integral before it.
_SEGMENTS = """aggregate(sequence(1, size(knots) - 1), cast(array() AS array<struct<t:double,h:double,a:double,b:double,before:double>>),
 (s, i) -> concat(s, array(named_struct('t', knots[i-1].t, 'h', knots[i].t - knots[i-1].t, 'a', knots[i-1].w, 'b', knots[i].w,
 'before', CASE WHEN size(s) = 0 THEN 0D ELSE element_at(s, -1).before + (element_at(s, -1).a + element_at(s, -1).b) / 2 * element_at(s, -1).h END))))"""
_INTEGRAL = "aggregate(segments, 0D, (s, x) -> s + (x.a + x.b) / 2 * x.h)"


def targets(sources: DataFrame, schedules: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (``source, n_docs, source_size``) with ``segments``, ``weight`` and ``target``.

    The targets share all words of the sources by weight; none is above ``max_epochs`` times its source. With sources
    in order of the multiple of their weight at which they are full, each has a level that empties what is left; the
    highest of these levels is the one that all others stop at. One row for each source, so its windows are small.
    """
    s = sources.join(schedules.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    s = s.withColumn("segments", F.expr(_SEGMENTS)).withColumn("weight", F.expr(_INTEGRAL)).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.try_divide("cap", "weight").asc_nulls_last(), "source")
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(after)))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.withColumn("target", F.when(F.col("weight") > 0, F.least("cap", F.col("level") * F.col("weight"))).otherwise(0.0)).drop("cap", "level", "total", "knots")


#: Training time at which the fraction ``u`` of a source's integrated schedule is reached: the last segment that begins before it, and a root in it.
_INVERSE = """(u, segments) -> aggregate(filter(segments, x -> x.before <= u * weight AND (x.a + x.b) * x.h > 0), 0D, (s, x) -> x.t + least(x.h,
 coalesce(try_divide(2 * (u * weight - x.before), x.a + sqrt(greatest(0D, x.a * x.a + 2 * (x.b - x.a) / x.h * (u * weight - x.before)))), 0D)))"""


def mix(docs: DataFrame, schedules: DataFrame | None = None, max_epochs: int = 3, cut_last: bool = True) -> DataFrame:
    """One row for each document: ``doc_id, source, size, digest, source_size, target, taken, positions``, range-sorted by first position.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; ``schedules`` has ``source`` and ``knots`` (t rising from 0 to 1; sources
    without a schedule get no words). ``taken`` is the document's words in the mix over all epochs, ``positions`` the training
    times of its epochs (empty if none), ``digest`` a hash of its text. Of the last epoch a prefix of the source's order is
    taken; with ``cut_last`` its last document is taken in part, so a source's taken words are its target rounded, else
    as a whole or not, whichever is nearer. Null text: size 0, never taken in part, and its positions are those of its
    place. Null source: a source of its own. Repeated rows are documents each. A very long text is one document of its size:
    it is taken whole or in part like others. Other columns are not read, whatever their names. No rows: no rows.
    Rows come in the order of training: by first position, those without one last, ties by id.
    Sources share out the budget in one task, a row for each: tens of thousands of them, not one for each document.
    """
    rows = _placed(docs, schedules, max_epochs, cut_last).withColumn("_first", F.try_element_at("positions", F.lit(1)))
    order = F.asc_nulls_last("_first"), F.asc("doc_id"), F.asc("digest")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_first")


def _placed(docs: DataFrame, schedules: DataFrame | None, max_epochs: int, cut_last: bool) -> DataFrame:
    """The rows of ``mix`` in no order."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size"), F.xxhash64("text").alias("digest"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"))
    sized = cut(sized, "sized")
    sources = cut(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), "sources")
    aimed = cut(targets(sources, ranked_schedules(sources) if schedules is None else schedules, max_epochs), "targets").withColumnRenamed("source", "_source")
    rows = sized.join(aimed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.withColumn("_bucket", F.floor(share * F.ceil(F.col("n_docs") / BUCKET_ROWS)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rows = rows.withColumn("_c", F.col("_ahead") + F.col("_inside")).withColumn("_want", F.floor(F.col("target") + 0.5))
    rows = rows.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("_want") / F.col("source_size"))).otherwise(0)).withColumn("_rest", F.col("_want") - F.col("_full") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_c"))) if cut_last else F.when(F.col("_c") * 2 + F.col("size") <= F.col("_rest") * 2, F.col("size")).otherwise(0)
    rows = rows.withColumn("_last", last).withColumn("taken", (F.col("_full") * F.col("size") + F.col("_last")).cast("long"))
    epochs = F.expr(f"transform(filter(sequence(0L, _full), e -> e < _full OR _last > 0), e -> ({_INVERSE.partition('->')[2].replace('u * weight', '((e * source_size + _c) / greatest(1D, target) * weight)')}))")
    return rows.select("doc_id", "source", "size", "digest", "source_size", "target", "taken", epochs.alias("positions"))


def mixed_documents(docs: DataFrame, schedules: DataFrame | None = None, max_epochs: int = 3) -> DataFrame:
    """The mix itself: whole rows of ``docs``, once for each epoch, range-sorted by training position.

    Rows find their places by id and text digest; of repeated rows each finds one place. Null texts and sources are as in
    ``mix``; ties of position go by id; columns stay as they are, whatever their names. No rows: no rows.
    """
    plan = _placed(docs, schedules, max_epochs, cut_last=False)
    key = ["_none", "_id", "_digest"]
    named = lambda df, digest, *more: df.select(F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), digest.alias("_digest"), "source", *more)
    number = lambda df, *more: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("source", *more)))
    rows = number(named(docs, F.xxhash64("text"), F.struct(*docs.columns).alias("_row"))).drop("source")
    places = number(named(plan, F.col("digest"), "positions"), "positions").withColumnRenamed("_n", "_m").drop("source")
    # The numbers are compared as a difference, as another key would shuffle the numbered rows again.
    placed = rows.join(places, key).filter("_n - _m = 0").select("_row", "_id", F.explode("positions").alias("_position"))
    placed = placed.repartitionByRange(parts_for(docs), "_position", "_id").sortWithinPartitions("_position", "_id")
    return placed.select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][r % 3 + 1] AS DOUBLE) AS w, CAST([0.5, 0, -0.5][r % 3 + 1] AS DOUBLE) AS a, source_size * CAST(3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, w, a, least(cap, max(level) OVER () * w) AS target FROM l),
c AS (SELECT doc_id, size, source_size, w, a, target, CAST(floor(target + CAST(0.5 AS DOUBLE)) AS BIGINT) AS want,
 CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS full_epochs FROM c),
g AS (SELECT *, greatest(0, least(size, want - full_epochs * source_size - c)) AS last_words, c / greatest(CAST(1 AS DOUBLE), target) * w AS r FROM f)
SELECT doc_id, size, source_size, target, CAST(full_epochs * size + last_words AS BIGINT) AS taken,
 CASE WHEN full_epochs > 0 OR last_words > 0 THEN round(least(1, 2 * r / (w * (1 + a) + sqrt(greatest(0, w * (1 + a) * (w * (1 + a)) + 2 * (w * (1 - a) - w * (1 + a)) * r)))), 9) END AS first_position
FROM g
"""
}
