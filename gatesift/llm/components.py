"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`vertex` and `label`, the smallest vertex it is connected with, for every vertex of an edge.

    Every round each vertex takes the smallest label among its neighbours, then the label of its label, so that
    distances halve. Each round is written before the next. A vertex with many edges is met by partial minima.
    """
    both = saved(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = saved(both.groupBy(F.col("x").alias("vertex")).agg(F.min("y").alias("m")).select("vertex", F.least("vertex", "m").alias("label")))
    while True:
        told = both.join(labels, F.col("x") == F.col("vertex")).select(F.col("y").alias("vertex"), "label")
        least = labels.select("vertex", F.col("label").alias("was"), "label").unionByName(told.withColumn("was", F.lit(None).cast(labels.schema["label"].dataType)))
        least = least.groupBy("vertex").agg(F.max("was").alias("was"), F.min("label").alias("label"))
        jump = least.select(F.col("vertex").alias("_v"), F.col("label").alias("_l"))
        now = saved(least.join(jump, F.col("label") == F.col("_v")).select("vertex", F.col("_l").alias("label"), (F.col("_l") != F.col("was")).alias("changed")))
        labels = now.select("vertex", "label")
        if not now.filter("changed").limit(1).count():
            return labels
