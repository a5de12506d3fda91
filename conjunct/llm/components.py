"""Connected components of a graph of 64-bit ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunct.llm.shared import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): a common label for the nodes of each component; nodes without an edge don't appear.

    Each round sends every node to the least node among itself and its neighbours and contracts the graph. Ids should be
    hashes: with random ids the number of nodes falls by a constant factor a round. Nothing is collected but counts;
    each round's tables are written to the shared folder, and joins read written tables, so that AQE can split hot keys.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).filter("a != b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "least")
        if labels is None:
            new = least.select("node", F.col("to").alias("label"))
        else:
            to = least.select(F.col("node").alias("label"), "to")
            new = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        kept = materialize(new, "labels")
        if labels is not None:
            forget(spark, labels.written_to)
        labels = kept
        one = edges.join(least.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
        two = one.join(least.withColumnRenamed("node", "b"), "b").select("x", F.col("to").alias("y"))
        shrunk = materialize(two.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(spark, edges.written_to)
        forget(spark, least.written_to)
        edges = shrunk
    forget(spark, edges.written_to)
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels
