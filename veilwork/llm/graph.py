"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tables import shared_dir, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex of each component, for edges (a, b) of longs.

    Every round passes the smallest label on to the neighbours and then to the label's own label, so that
    chains shorten by half. Edges and labels are tables of their own in each round: a vertex with very many
    edges is split by the join. The number of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("label", "near").alias("next"), "label").checkpoint()
        if lower.where("next < label").isEmpty():
            return labels
        jump = lower.select(F.col("v").alias("next"), F.col("next").alias("further"))
        labels = (
            lower.join(jump, "next", "left")
            .select("v", F.least("next", F.coalesce("further", "next")).alias("label"))
            .checkpoint()
        )
