"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, keep


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _hang(links: DataFrame) -> DataFrame:
    """Each link's far end is hung on the least neighbour of its near end."""
    least = _least(links)
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has links: root is the least node reachable.  links has u and v, of one ordered type; order and repeats don't matter.

    Large and small stars in turn: the links of each node are moved to its least neighbour until all are stars.  Each round
    is written to the shared folder.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = keep(links, "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _hang(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(_least(large).select("u", F.col("m").alias("v"))).distinct()
        before, links = links, keep(small, "links")
        forget(before)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
