"""Connected components of a link table, all in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for each end of ``links`` (``a, b``): the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours, then that
    label's own label, so chains halve.  A round's labels are a table in the
    shared folder; only the number of changes comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("low"))
        own = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        following = stored(lower.join(own, "low").select("node", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("label")).alias("moved")), "labels")
        forget(labels)
        labels = following.select("node", "label")
        if not following.filter("moved").limit(1).count():
            return labels
