"""Connected components of links, on the executors.

Each round takes the least label among a node's neighbours and then the label
of its label, so paths shorten by more than half each time; a round's labels
are written to the shared folder, which cuts lineage and survives lost
executors.  The driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, stored


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node of the links (a, b)."""
    spark = links.sparkSession
    edges, edges_path = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels, path = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        step = near.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("comp"), "was")
        old = path
        step, path = stored(step, "labels")
        release(spark, old)
        labels = step.select("node", "comp")
        if step.where("comp <> was").limit(1).count() == 0:
            release(spark, edges_path)
            return labels
