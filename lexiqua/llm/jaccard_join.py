"""N-gram Jaccard join, size-aware and heavy-light, to connected components.

A document's set holds its distinct word shingles. Equal sets are one set from the start. Then

* small sets (light) enumerate subsets: two sets of n and m shingles link if they share c(n, m) of them, so they link
  exactly if they share a subset of that size. A subset's sets are chained to its smallest; no check is needed;
* large sets (heavy) scan inverted lists of the first shingles in a global order. Linked sets share one of their
  first n - ceil(t n) + 1 shingles, whatever the order; it puts rare shingles first (counted over all documents) and
  frequent ones later, so lists stay short. Lists of up to ``SHORT_LIST`` sets give candidate pairs. Sets of n and m that
  miss at most a and b of their shingles share l of their first a + l and b + l, so pairs must meet in that many
  lists, and whole sets decide on those that do;
* sets whose first n - ceil(t n) + 1 shingles have longer lists, those of large groups of near copies, are gathered by these lists
  and compared block by block, with overlaps as matrix products. A block pair gives the links of a spanning forest, never
  all pairs.

The boundary between small and large is the size at which the cost of all subsets and lists, by the sizes in the corpus,
is least. Links make components; a document's component is the smallest id in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, mixed, scratch, settled, slices, split_words, translated
from lexiqua.llm.components import components

#: Sets in an inverted list that gives pairs; longer lists are compared in blocks.
SHORT_LIST = 32
#: Sets in a block.
BLOCK = 1024
#: Shingles whose hash is in this lowest part of all hashes are counted, to know which are frequent; for each unit of 1 - t, the
#: part of a set that its prefix is.
COUNTED = 1.9
#: Shingles of a prefix beyond the least: a pair must share one more than these, at least.
EXTRA = 2
#: The most frequent shingles that all executors get (8 bytes each). The order may be any; beyond these it knows fewer.
FREQUENT = 2_000_000
#: Rows of ids (about 24 bytes each) that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The largest size for which subsets are considered, and what an entry of an inverted list costs against a subset's.
MOST_SMALL, LIST_COST = 24, 4.0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_F = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its set: sorted distinct 64-bit hashes of its k-word shingles (of all its words, if fewer)."""
    codes, words, first = split_words(translated(texts, _LOWER))
    value = mixed(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)))[codes] if len(words) else np.zeros(0, np.uint64)
    n = len(value) - k + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = value[:n]
        for j in range(1, k):
            rolled = mixed(rolled * _F[j % 4] + value[j : j + n])
    sets = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= k:
            s = np.sort(rolled[low : high - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            sets.append(s[keep])
        elif high > low:
            whole = np.array([high - low], np.uint64)
            for at in range(low, high):
                whole = mixed(whole * _F[3] + value[at : at + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def needed(n: int, m: int, percent: int) -> int:
    """Shared shingles that link sets of n and m: 100 * shared >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set that are shown. Linked sets meet in one of the first ``prefix - EXTRA`` of both (all, if that is fewer)."""
    return np.minimum(n - -(-percent * n // 100) + 1 + EXTRA, n)


def _edge(part: float, percent: int) -> int:
    """The hash below which ``part`` of 1 - t of all hashes are; half of all hashes at most, which are those that a signed number holds."""
    return min(int(part * (100 - percent) / 100 * (1 << 64)), (1 << 63) - 1)


def subset_cost(n: int, percent: int) -> int:
    return sum(comb(n, needed(n, m, percent)) for m in partners(n, percent) if needed(n, m, percent) <= min(n, m))


def boundary(sizes: dict[int, int], percent: int, most: int = MOST_SMALL) -> int:
    """The largest size of a small set, by least cost over the numbers of sets of each size up to ``most``."""
    light = lambda n: sizes.get(n, 0) * subset_cost(n, percent)
    heavy = lambda n: sizes.get(n, 0) * LIST_COST * float(prefix(np.array([n]), percent)[0])
    return min(range(most + 1), key=lambda b: (sum(map(light, range(1, b + 1))) + sum(map(heavy, range(b + 1, most + 1))), b))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate([*parts, np.zeros(0, np.uint64)]))))


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = mixed(s ^ _F[0]).sum(dtype=np.uint64), mixed(s ^ _F[2]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def shingled(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id") -> DataFrame:
    """``uid, doc_id, th, n, d1, d2, least``: size, 128-bit digest and the lowest hashes of each document's set, written to the shared folder.

    ``least`` holds the hashes that come first in the global order or after those in order of their hash, and as many as a
    prefix needs; all, if the set is small.
    """
    edge = np.uint64(_edge(COUNTED, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            n = np.array([len(s) for s in sets])
            digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            more = prefix(n, percent)
            low = [s if len(s) <= MOST_SMALL * 2 else s[: max(int(np.searchsorted(s, edge)), p)] for s, p in zip(sets, more.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists(low)], names=["doc_id", "th", "n", "d1", "d2", "least"])

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return cut(known.mapInArrow(run, "doc_id long, th long, n int, d1 long, d2 long, least array<long>").withColumn("uid", F.monotonically_increasing_id()), "shingled")


def _sent(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it is small by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _subsets(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Links of small sets: to the smallest set on the other side of each subset that both sides have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = {"uid": [], "n": [], "m": [], "k1": [], "k2": []}
                for uid, least in zip(batch.column("uid")[low : low + 500].to_pylist(), batch.column("least")[low : low + 500].to_pylist(), strict=True):
                    n = len(least)
                    s = np.array(least, np.int64).view(np.uint64)
                    a, b = mixed(s ^ _F[1]), mixed(s ^ _F[3])
                    for m in partners(n, percent):
                        c = needed(n, m, percent)
                        if m > most or c > min(n, m) or c == n == m:
                            continue
                        picked = np.array(list(combinations(range(n), c)))
                        tag = np.uint64(min(n, m) * 1000 + max(n, m))
                        rows["k1"].append(mixed(a[picked].sum(axis=1, dtype=np.uint64) + tag))
                        rows["k2"].append(mixed(b[picked].sum(axis=1, dtype=np.uint64) + tag))
                        rows["uid"].append(np.full(len(picked), uid))
                        rows["n"].append(np.full(len(picked), n))
                        rows["m"].append(np.full(len(picked), m))
                if rows["uid"]:
                    joined = {c: np.concatenate(x) for c, x in rows.items()}
                    yield pa.RecordBatch.from_pydict({"uid": pa.array(joined["uid"], pa.int64()), "n": pa.array(joined["n"], pa.int32()), "m": pa.array(joined["m"], pa.int32()), "k1": pa.array(_signed(joined["k1"])), "k2": pa.array(_signed(joined["k2"]))})

    keyed = cut(sets.filter(F.col("n") <= most).select("uid", "least").mapInArrow(run, "uid long, n int, m int, k1 long, k2 long"), "subsets")
    side = lambda c: F.min(F.when(c, F.col("uid")))
    least = keyed.groupBy("k1", "k2").agg(F.count("*").alias("c"), side(F.col("n") <= F.col("m")).alias("low"), side(F.col("n") >= F.col("m")).alias("high")).filter("c > 1 AND low IS NOT NULL AND high IS NOT NULL").drop("c")
    hit = keyed.join(least, ["k1", "k2"])
    return hit.select(F.col("uid").alias("u"), F.when(F.col("n") <= F.col("m"), F.col("high")).otherwise(F.col("low")).alias("v")).filter("u <> v").distinct()


def _postings(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], least: int, percent: int) -> DataFrame:
    """``key, uid, n, base``: the first shingles of each large set in the global order (counted ones, rare first, then others; each by
    hash). ``frequent`` has shingles and the powers of two in their counts. ``base`` marks those of which linked sets share one."""
    edge = np.uint64(_edge(COUNTED, percent))
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, power = shared.value
        for batch in batches:
            column = batch.column("least")
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            flat = column.flatten().to_numpy().view(np.uint64)
            rank = np.where(flat >= edge, np.int8(127), np.int8(0))
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                rank = np.where((often[at] == flat) & (flat < edge), power[at], rank)
            n = batch.column("n").to_numpy()
            out = []
            for low, high, p in zip(ends[:-1].tolist(), ends[1:].tolist(), prefix(n, percent).tolist(), strict=True):
                order = np.argsort(rank[low:high], kind="stable")[:p]
                out.append(flat[low:high][order])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), _lists(out)], names=["uid", "n", "keys"])

    found = sets.filter(F.col("n") >= least).select("uid", "n", "least").mapInArrow(run, "uid long, n int, keys array<long>")
    base = F.expr(f"pos <= n - cast(ceil({percent} * n / 100D) AS int)")
    return found.select("uid", "n", F.posexplode("keys").alias("pos", "key")).select("key", "uid", "n", base.alias("base"))


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str) -> DataFrame:
    """``uid, n, items``: whole sets of the wanted documents (``uid, doc_id, th``), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([len(s) for s in sets], pa.int32()), _lists(sets)], names=["uid", "n", "items"])

    named = _sent(wanted.select("uid", F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    texts = docs.join(named, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))).select("uid", "text")
    return cut(texts.mapInArrow(run, "uid long, n int, items array<long>").dropDuplicates(["uid"]), "sets")


def links(a: str, b: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(f"{a}.items", f"{b}.items"))
    return (100 + percent) * shared >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _block_links(sizes: np.ndarray, items: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among the sets of a block pair."""
    g = len(items)
    flat, owner = np.concatenate(items), np.repeat(np.arange(g), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    used = often[column]
    column, owner = (np.cumsum(often) - 1)[column[used]], owner[used]
    shared = np.zeros((g, g), np.float32)
    width = 4096
    for low in range(0, int(often.sum()), width):
        some = slice(*np.searchsorted(column, (low, low + width)))
        one = np.zeros((g, width), np.float32)
        one[owner[some], column[some] - low] = 1
        shared += one @ one.T
    linked = (100 + percent) * shared.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, True)
    label = np.arange(g)
    while True:
        low = np.where(linked, label[None, :], g).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(g))
    return moved, label[moved]


def _blocked(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links inside coarse groups (``id, label``): blocks by size in each group; only blocks whose sizes can link meet."""
    members = sets.join(groups.select(F.col("id").alias("uid"), "label"), "uid")
    # Sizes in classes by a factor below the threshold: linked sets are in the same or the next class.
    step = float(np.log(100 / percent)) * 1.000001
    members = members.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / step).cast("long"))
    counts = members.groupBy("label", "cls").agg(F.count("*").alias("c"))
    members = members.join(counts.withColumn("nb", F.ceil(F.col("c") / BLOCK)).select("label", "cls", "nb"), ["label", "cls"])
    members = members.withColumn("b", F.pmod(F.xxhash64("uid"), F.col("nb")))
    after = counts.select("label", (F.col("cls") - 1).alias("cls"), F.ceil(F.col("c") / BLOCK).alias("na"))
    before = counts.select("label", (F.col("cls") + 1).alias("cls"), F.ceil(F.col("c") / BLOCK).alias("nz"))
    members = members.join(after, ["label", "cls"], "left").join(before, ["label", "cls"], "left")
    same = F.expr("transform(sequence(0L, nb - 1), x -> struct(cls AS ca, least(b, x) AS ba, cls AS cb, greatest(b, x) AS bb))")
    up = F.expr("if(na IS NULL, array(), transform(sequence(0L, coalesce(na, 1L) - 1), x -> struct(cls AS ca, b AS ba, cls + 1 AS cb, x AS bb)))")
    down = F.expr("if(nz IS NULL, array(), transform(sequence(0L, coalesce(nz, 1L) - 1), x -> struct(cls - 1 AS ca, x AS ba, cls AS cb, b AS bb)))")
    pairs = members.select("label", "uid", "n", "items", F.explode(F.concat(same, up, down)).alias("p")).select("label", "p.*", "uid", "n", "items")

    def run(table: pa.Table) -> pa.Table:
        uid = table.column("uid").to_numpy()
        items = [np.asarray(x.values.to_numpy()) for x in table.column("items").combine_chunks()]
        u, v = _block_links(table.column("n").to_numpy().astype(np.int64), items, percent)
        return pa.table({"u": pa.array(uid[u], pa.int64()), "v": pa.array(uid[v], pa.int64())})

    return pairs.groupBy("label", "ca", "ba", "cb", "bb").applyInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: ``doc_id, th`` (hash of its text), ``n_shingles, component_id``.

    ``docs`` needs the id column and ``text``. Null, empty and wordless texts have an empty set and their own id as component.
    Rows of one text (repeated rows, too) are in one component; rows with one id count as separate documents. A null id
    never is a component's id: a component of null ids has a null id. Texts are read whole, and a very long one is a set of
    its size in one worker. Other columns of ``docs`` are not read, whatever their names. No rows: no rows.
    """
    with scratch() as made:
        return settled(_components(docs.select(id_col, "text"), k, percent, id_col), "components", made)


def _components(docs: DataFrame, k: int, percent: int, id_col: str) -> DataFrame:
    all_sets = shingled(docs, k, percent, id_col)
    full = all_sets.filter("n > 0")
    same = full.groupBy("d1", "d2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    same = cut(same, "same")
    extra = full.join(_sent(same.filter("copies > 1").select("d1", "d2", "rep")), ["d1", "d2"]).filter("uid <> rep").select("uid")
    sets = full.join(_sent(cut(extra, "copies")), "uid", "left_anti")
    sizes = {r[0]: r[1] for r in sets.filter(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
    most = boundary(sizes, percent)
    edge = _edge(COUNTED, percent)
    lowest = F.explode(F.filter("least", lambda x: (x >= 0) & (x < edge))).alias("key")
    counts = sets.filter(F.col("n") > most).select(lowest).groupBy("key").count().filter(F.col("count") > SHORT_LIST)
    counts = cut(counts, "counts")
    top = counts if counts.count() <= FREQUENT else counts.orderBy(F.desc("count"), "key").limit(FREQUENT)
    found = np.fromiter((tuple(r) for r in top.select("key", F.floor(F.log2("count"))).toLocalIterator()), np.dtype([("key", np.int64), ("power", np.int8)]))
    found.sort(order="key")
    frequent = found["key"].copy().view(np.uint64), found["power"].copy()
    postings = _postings(sets, frequent, -(-percent * (most + 1) // 100), percent)
    lists = postings.groupBy("key").agg(F.count("*").alias("c"), F.min(F.when(F.col("base"), F.col("uid"))).alias("first")).filter("c > 1")
    listed = cut(postings.join(lists, "key"), "lists")
    long = listed.filter(F.col("c") > SHORT_LIST)
    deep = cut(long.groupBy("uid").agg(F.count("*").cast("int").alias("deep")), "deep")
    short = listed.filter(F.col("c") <= SHORT_LIST).select("key", "uid", "n").join(_sent(deep), "uid", "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    a, b = short.alias("a"), short.alias("b")
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.uid") < F.col("b.uid"))).filter((100 * low >= percent * high) & (high > most))
    met = met.groupBy(F.col("a.uid").alias("x"), F.col("b.uid").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny"), F.least("a.deep", "b.deep").alias("deep")).agg(F.count("*").alias("met"))
    # A pair may also meet in the long lists that both are in. It is compared there only if it meets in one that is in both bases.
    first = lambda n: f"least({n} - cast(ceil({percent} * {n} / 100D) AS int) + {1 + EXTRA}, {n})"
    share = f"cast(ceil({percent} * (nx + ny) / {100 + percent}D) AS int)"
    pairs = cut(met.filter(f"met + deep >= least({first('nx')} - (nx - {share}), {first('ny')} - (ny - {share}))").select("x", "y"), "pairs")
    groups = components(long.filter("base").select(F.col("uid").alias("u"), F.col("first").alias("v")))
    groups = cut(groups.union(groups.select(F.col("label").alias("id"), "label").distinct()), "groups")
    wanted = pairs.select(F.col("x").alias("uid")).union(pairs.select(F.col("y").alias("uid"))).union(groups.select(F.col("id").alias("uid"))).distinct()
    whole = _full_sets(docs, cut(full.select("uid", "doc_id", "th").join(wanted, "uid"), "wanted"), k, id_col)
    checked = pairs.join(whole.alias("a"), F.col("x") == F.col("a.uid")).join(whole.alias("b"), F.col("y") == F.col("b.uid")).filter(links("a", "b", percent)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    edges = checked.union(_subsets(sets, most, percent)).union(_blocked(whole, groups, percent))
    label = components(edges)
    named = same.join(label, F.col("rep") == F.col("id"), "left").withColumn("label", F.coalesce("label", "rep"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(least, "label").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "component_id")
    joined = all_sets.join(of_set, (F.col("n") > 0) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    return joined.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component: that whose id is the component's.

    Of rows with that id, one row stays (the smallest text hash). Documents without words and components of null ids stay
    whole. All columns stay as they are, whatever their names. No rows: no rows.
    """
    found = jaccard_components(docs, k, percent)
    gone = found.filter("n_shingles > 0 AND doc_id <> component_id OR doc_id IS NULL AND component_id IS NOT NULL").select("doc_id", "th")
    double = found.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("th").alias("_least")).filter("c > 1")
    double = cut(double.select(F.col("doc_id").alias("_twice"), "_least"), "double")
    gone = _sent(cut(gone.distinct(), "gone").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.xxhash64("text").alias("_x"))
    kept = rows.join(gone, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_th")), "left_anti")
    if not double.isEmpty():
        again = kept.join(F.broadcast(double) if double.count() <= BROADCAST_ROWS else double, F.col("_i") == F.col("_twice"), "left")
        once = again.filter("_twice IS NOT NULL").filter(F.col("_x") == F.col("_least")).dropDuplicates(["_i"])
        kept = again.filter("_twice IS NULL").unionByName(once)
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"""
ORACLES = {
    "op9_jaccard_join": rf"""
WITH RECURSIVE {_SHINGLES},
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b USING (k) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
 GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 190 * count(*) >= 90 * (x.n + y.n)),
r AS (SELECT doc_id AS u, doc_id AS c FROM w UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.u = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
}
