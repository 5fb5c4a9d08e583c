"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import stash


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links(a, b)``: the component is its smallest node.

    Each round turns every node's links to the smallest neighbour, first for larger neighbours, then for smaller ones,
    and writes the links to the shared folder; it ends when a round changes nothing. Only two sums come to the driver.
    Links to itself and repeated ones do no harm; no links give no rows.
    """
    edges = stash(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = stash(larger.filter("u <> v"), "larger")
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u")
        turned = smaller.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stash(turned.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "smaller")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (now["n"], now["s"]):
            break
        before = (now["n"], now["s"])
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
