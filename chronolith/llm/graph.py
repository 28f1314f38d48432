"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


#: A key with more than this share of all rows, and at least so many, is a hub: there are few of them.
HUB_SHARE, HUB_LEAST = 0.002, 1000


def by_hub(rows: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with ``least``, which has a row and a ``degree`` for each key of them.

    The rows of a hub would all meet in one task; there are 1 / HUB_SHARE hubs at most, so these are sent to all instead.
    """
    limit = max(HUB_LEAST, int(HUB_SHARE * total))
    if total <= limit:
        return rows.join(least.drop("degree"), key)
    high = F.broadcast(least.where(F.col("degree") > limit).drop("degree"))
    rest = rows.join(F.broadcast(high.select(key)), key, "left_anti").join(least.where(F.col("degree") <= limit).drop("degree"), key)
    return rows.join(high, key).unionByName(rest)


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    near = by_hub(both, least, "u", 2 * total).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    moved = by_hub(edges, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links of longs -> ``(node, root)`` with the smallest node reached, roots left out.

    Every round is two aggregations with partial sums and two joins, in which hubs are not dealt by their key, so that
    one of any degree is spread over tasks; a round's result is checkpointed. An empty link table
    gives an empty result; loops and repeated links do no harm.
    """
    now = cut(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        now = cut(_small(cut(_large(now, state[0]), state[0]), state[0]), state[0])
        if (then := _state(now)) == state:
            break
        state = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
