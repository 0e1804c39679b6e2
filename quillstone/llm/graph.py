"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import dealt, written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b): comp is the smallest node it reaches.

    Each round every node takes the smallest label next to it, then the label of its label; labels are written
    to the shared folder after each, and those before deleted.  Joins are on plain keys, so a hub's rows can be split by adaptive execution;
    none is a broadcast, as labels grow with the links.
    """
    spark, since = links.sparkSession, len(common.made) + 1
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(dealt(labels.select(F.col("node").alias("b"), "comp")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        once = labels.join(dealt(near), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = written(once.join(dealt(jump), "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        common.drop(spark, since, but=1)
        if new.where("old <> comp").limit(1).count() == 0:
            common.drop(spark, since - 1, but=1)
            return labels
