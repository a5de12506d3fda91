"""Rules of tree ensembles over 0/1 items: the positive prefixes of root-to-node paths as itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunct.operators import itemsets
from conjunct.plans.store import written


def tree_paths(nodes: DataFrame, max_depth: int = 30) -> DataFrame:
    """(tree, node, positive, negative) of every node but the root that some 0/1 row can reach.

    nodes has (tree, node, left, right, feature, threshold); leaves have left = -1. A split at a threshold in [0, 1)
    sends absent items left and present ones right; other thresholds send all rows one way. Branches that need an item
    both present and absent are dropped. Levels are joined one after the other, max_depth times at most.
    """
    split = nodes.filter("left >= 0").select("tree", F.col("node").alias("at"), "left", "right", "feature", "threshold")
    empty = F.array().cast("array<int>")
    level = nodes.filter("node = 0").select("tree", F.col("node").alias("at"), empty.alias("positive"), empty.alias("negative"))
    out = None
    for _ in range(max_depth):
        held = level.join(split, ["tree", "at"])
        item, tests = F.array("feature"), (F.col("threshold") >= 0) & (F.col("threshold") < 1)
        plus, minus = F.array_union("positive", item), F.array_union("negative", item)
        sides = F.array(
            F.struct(F.col("left").alias("at"), F.col("positive"), F.when(tests, minus).otherwise(F.col("negative")).alias("negative"), ((F.col("threshold") >= 0) & ~F.isnan("threshold")).alias("open")),
            F.struct(F.col("right").alias("at"), F.when(tests, plus).otherwise(F.col("positive")).alias("positive"), F.col("negative"), (F.col("threshold") < 1).alias("open")),
        )
        level = held.select("tree", F.explode(sides).alias("s")).select("tree", "s.*").filter(F.col("open") & ~F.arrays_overlap("positive", "negative")).drop("open")
        level = written(level, "paths")
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
    if out is None:
        out = level
    return out.select("tree", F.col("at").alias("node"), F.array_sort("positive").alias("positive"), F.array_sort("negative").alias("negative"))


def path_rules(nodes: DataFrame, item_tid: DataFrame, least: int, max_len: int, max_depth: int = 30) -> DataFrame:
    """(itemset, support, trees, paths) of the paths without negative tests, with support and length in bounds."""
    pure = tree_paths(nodes, max_depth).filter((F.size("negative") == 0) & (F.size("positive") > 0) & (F.size("positive") <= max_len))
    rules = pure.groupBy(F.col("positive").alias("itemset")).agg(F.countDistinct("tree").alias("trees"), F.count(F.lit(1)).alias("paths"))
    met = itemsets.transform_patterns(rules, item_tid).filter(F.col("support") >= least)
    return rules.join(met, "itemset").select("itemset", "support", "trees", "paths")


def projections(nodes: DataFrame, item_tid: DataFrame, least: int, max_len: int, max_depth: int = 30) -> DataFrame:
    """(itemset, support) of the positive parts of all paths, negative tests left out."""
    parts = tree_paths(nodes, max_depth).filter((F.size("positive") > 0) & (F.size("positive") <= max_len)).select(F.col("positive").alias("itemset")).distinct()
    return itemsets.transform_patterns(parts, item_tid).filter(F.col("support") >= least)
