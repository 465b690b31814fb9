"""Connected components of a table of links, by alternating large and small stars, with checkpoints in the shared folder.

Each round groups by one end and takes a minimum (which Spark combines before the shuffle), and joins it back to the links; a hot
end is split by adaptive skew handling. The driver sees two numbers a round; rounds end when one changes no link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node, component: the smallest id that a node reaches; a row for each end of a link."""
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before, links = links, cut(small)
        last, state = state, _state(links)
        # of equal numbers of links, both without repeats, the tables are equal if none is new; only then is that asked
        if last == state and links.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    tops = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
