"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiqua.llm._common import cut


#: An id of more links than this, and than this part of all, is a hub: there is at most one for each such part.
HUB_LINKS, HUB_PART = 1_000, 1e-5


def _joined(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``links`` with ``m`` of their ``u``, from ``least`` (``u, m, c``: links of u). Hubs are broadcast, as they are few by their part of all
    links, so no hub makes a task large."""
    if total <= HUB_LINKS:
        return links.join(least.drop("c"), "u")
    least = cut(least, "least")
    hub = F.col("c") > max(HUB_LINKS, total * HUB_PART)
    if least.filter(hub).isEmpty():
        return links.join(least.drop("c"), "u")
    hubs = F.broadcast(least.filter(hub).drop("c"))
    rest = links.join(hubs.drop("m"), "u", "left_anti").join(least.filter(~hub).drop("c"), "u")
    return links.join(hubs, "u").unionByName(rest)


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("c"))
    return _joined(both, least, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    joined = _joined(down, least, total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``u, v`` (long) links to ``id, label``: for each id in a link that isn't the smallest of its component, the smallest.

    Each round writes its links to the shared folder, so lineage stays short. Links stay links of two ids, and a round
    makes no more of them; a hub's links are spread by partial sums and a broadcast.
    """
    now, seen = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"), None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
        seen, now = mark, cut(_small(_large(now, mark[0]), mark[0]), "links")
    raise RuntimeError("components did not settle")
