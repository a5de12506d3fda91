"""Frequent and closed itemsets as joins: transactions are long tables (tid, item), patterns arrays of sorted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunct.plans.store import written


def min_support(n: int, share: float = 0.015, least: int = 3) -> int:
    return max(least, -(-int(round(share * n * 1_000_000)) // 1_000_000))


def normalize(tx: DataFrame, items: str = "items") -> DataFrame:
    """Items sorted and distinct; null rows count as empty."""
    return tx.withColumn(items, F.array_sort(F.array_distinct(F.coalesce(items, F.array().cast(tx.schema[items].dataType)))))


def long_form(tx: DataFrame, items: str = "items") -> DataFrame:
    """(tid, item), distinct."""
    return tx.select("tid", F.explode(F.array_distinct(items)).alias("item"))


def baskets(item_tid: DataFrame) -> DataFrame:
    """(tid, items) of the long form."""
    return item_tid.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))


def item_index(item_tid: DataFrame) -> DataFrame:
    """(item, support, first_tid, last_tid): the vertical index in summary; its rows are item_tid itself."""
    return item_tid.groupBy("item").agg(F.count(F.lit(1)).alias("support"), F.min("tid").alias("first_tid"), F.max("tid").alias("last_tid"))


def frequent_items(item_tid: DataFrame, least: int) -> DataFrame:
    return item_tid.groupBy("item").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)


#: Sets of a level that are broadcast at most; their number doesn't grow with the rows, for each has a share of them.
FEW = 100_000


def encoded(item_tid: DataFrame, least: int) -> tuple[DataFrame, list]:
    """(tid, items) with items as sorted numbers, and the frequent items in order: number i is the i-th of them.

    Items under the support are left out. At most (items of a row) / (share of the support) items are frequent, so their
    names fit on the driver whatever the number of rows.
    """
    names = sorted(r["item"] for r in frequent_items(item_tid, least).select("item").collect())
    kind = item_tid.schema["item"].dataType
    numbers = item_tid.sparkSession.createDataFrame(list(enumerate(names)), f"number int, item {kind.simpleString()}")
    return item_tid.join(F.broadcast(numbers), "item").groupBy("tid").agg(F.array_sort(F.collect_set("number")).alias("items")), names


def grown(rows: DataFrame, kept: list[tuple[DataFrame, bool]]) -> DataFrame:
    """rows(items, ...) with itemset, one row for each set that is one item longer than the kept levels.

    Each row grows its own sets by items after their last one; sets whose shorter ones aren't kept are not made. No row
    leaves its task.
    """
    values = [c for c in rows.columns if c != "items"]
    level = rows.select(*values, "items", F.posexplode("items").alias("_at", "_item")).select(*values, "items", "_at", F.array("_item").alias("itemset"))
    for sets, small in kept:
        sets = sets.select("itemset")
        level = level.join(F.broadcast(sets) if small else sets, "itemset", "left_semi")
        level = level.select(*values, "items", "_at", "itemset", F.posexplode(F.slice("items", F.col("_at") + 2, F.size("items"))).alias("_d", "_item"))
        level = level.select(*values, "items", (F.col("_at") + F.col("_d") + 1).alias("_at"), F.concat("itemset", F.array("_item")).alias("itemset"))
    return level.drop("items", "_at")


def levels(rows: DataFrame, least: int, longest: int, aggs: list[Column] = (), write=written) -> list[DataFrame]:
    """For each length up to `longest` the frequent itemsets of rows(items, ...): (itemset, s, and the aggregates).

    Supports and aggregates of a level come from one aggregation, and all that shuffles are a task's partial sums. write
    (table, tag) -> table keeps each level; the number of its sets decides whether it is broadcast to the next.
    """
    out, kept = [], []
    for k in range(1, longest + 1):
        level = grown(rows, kept).groupBy("itemset").agg(F.count(F.lit(1)).alias("s"), *aggs).filter(F.col("s") >= least)
        level = write(level, f"level{k}")
        out.append(level)
        if not (n := level.count()):
            break
        kept.append((level, n <= FEW))
    return out


def named(df: DataFrame, names: list, column: str = "itemset") -> DataFrame:
    """df with the names of encoded() for the numbers in an itemset column."""
    held = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    return df.withColumn(column, F.transform(column, lambda i: F.get(held, i)))


def closures_of(found: list[DataFrame], longest: int) -> DataFrame:
    """(itemset, support, closure) of the sets of at most `longest` items, from the levels up to one item more.

    An item belongs to a set's closure if the set with it is as frequent. Only the dictionary's rows are joined.
    """
    own = reduce_union([x.select("itemset", F.col("s").alias("support")) for x in found[:longest]])
    longer = [x.select("s", F.explode("itemset").alias("_more"), "itemset") for x in found[1 : longest + 1]]
    if not longer:
        return own.withColumn("closure", F.col("itemset"))
    more = reduce_union(longer).select(F.array_remove("itemset", F.col("_more")).alias("itemset"), F.col("s").alias("support"), "_more")
    full = own.join(more, ["itemset", "support"], "left").groupBy("itemset", "support").agg(F.collect_set("_more").alias("_more"))
    return full.select("itemset", "support", F.array_sort(F.array_union("itemset", "_more")).alias("closure"))


def closed_of(found: list[DataFrame], longest: int) -> DataFrame:
    """The rows of the levels up to `longest` whose sets no set of one item more equals in support."""
    own = reduce_union(found[:longest])
    if len(found) < 2:
        return own
    longer = reduce_union([x.select("s", "itemset") for x in found[1 : longest + 1]])
    below = longer.select(F.explode(F.transform("itemset", lambda i: F.array_remove("itemset", i))).alias("itemset"), "s").distinct()
    return own.join(below, ["itemset", "s"], "left_anti")


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_tids(item_tid: DataFrame, least: int, max_len: int) -> DataFrame:
    """(itemset, tid) of every frequent itemset of at most max_len items, level by level."""
    rows, names = encoded(item_tid, least)
    rows = written(rows, "rows")
    found = levels(rows, least, max_len)
    kept = [(x, True) for x in found]
    parts = [grown(rows, kept[:k]).join(F.broadcast(x.select("itemset")), "itemset", "left_semi").select("itemset", "tid") for k, x in enumerate(found)]
    return named(reduce_union(parts), names).withColumn("itemset", F.col("itemset").cast(f"array<{item_tid.schema['item'].dataType.simpleString()}>"))


def supports(pattern_tid: DataFrame) -> DataFrame:
    return pattern_tid.groupBy("itemset").agg(F.count(F.lit(1)).alias("support"))


def closures(pattern_tid: DataFrame, item_tid: DataFrame) -> DataFrame:
    """(itemset, support, closure): the items that all transactions of given patterns have, whatever the patterns are."""
    covered = pattern_tid.join(item_tid, "tid").groupBy("itemset", "item").agg(F.count(F.lit(1)).alias("n"))
    full = covered.join(supports(pattern_tid), "itemset").filter(F.col("n") == F.col("support"))
    return full.groupBy("itemset", "support").agg(F.array_sort(F.collect_list("item")).alias("closure"))


def closed(pattern_tid: DataFrame, item_tid: DataFrame) -> DataFrame:
    """(itemset, support) of patterns that are their own closure; a closure beyond the length cap drops its set."""
    return closures(pattern_tid, item_tid).filter(F.size("closure") == F.size("itemset")).select("itemset", "support")


def closure_step(found: list[DataFrame]) -> DataFrame:
    """(itemset, canonical, closure) of each set of two items or more, grown from its prefix by its last item.

    canonical: no item before the last one, outside the prefix, is in the closure; so each closed set is reached once.
    """
    sets = closures_of(found, len(found) - 1).filter(F.size("itemset") > 1)
    last = F.element_at("itemset", -1)
    early = F.exists(F.array_except("closure", "itemset"), lambda x: x < last)
    return sets.select("itemset", "support", (~early).alias("canonical"), F.filter("closure", lambda x: F.array_contains("itemset", x) | (x > last)).alias("closure"))


def contain_join(patterns: DataFrame, item_tid: DataFrame) -> DataFrame:
    """(itemset, tid) of transactions that have all items of a pattern.

    A pattern meets only the transactions that have its rarest item; the others are looked up in the transaction itself.
    """
    counts = item_tid.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    parts = patterns.select("itemset").distinct().select("itemset", F.explode("itemset").alias("item"))
    order = F.struct(F.coalesce("_n", F.lit(0)), F.col("item"))
    rare = parts.join(counts, "item", "left").groupBy("itemset").agg(F.min_by("item", order).alias("_rare"))
    held = baskets(item_tid).select("tid", "items", F.explode("items").alias("_rare"))
    return rare.join(held, "_rare").filter(F.size(F.array_except("itemset", "items")) == 0).select("itemset", "tid")


def contain_join_nested(patterns: list[list], item_tid: DataFrame) -> DataFrame:
    """contain_join() of a few given patterns (a list at hand) by testing each transaction against each; no join at all."""
    kind = item_tid.schema["item"].dataType.simpleString()
    sets = F.array(*[F.array(*[F.lit(x) for x in p]).cast(f"array<{kind}>") for p in patterns]) if patterns else F.array().cast(f"array<array<{kind}>>")
    met = baskets(item_tid).select("tid", F.explode(F.filter(sets, lambda p: F.size(F.array_except(p, F.col("items"))) == 0)).alias("itemset"))
    return met.select("itemset", "tid")


def transform_patterns(patterns: DataFrame, item_tid: DataFrame) -> DataFrame:
    """(itemset, support) of a fixed dictionary on other rows; patterns that occur nowhere stay with 0."""
    met = contain_join(patterns, item_tid).groupBy("itemset").agg(F.count(F.lit(1)).alias("support"))
    return patterns.select("itemset").distinct().join(met, "itemset", "left").select("itemset", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def propagate(level: DataFrame) -> DataFrame:
    """Candidates one item longer than the given sets of one length, all of whose subsets are among them."""
    size = F.size("itemset")
    a, b = level.select(F.col("itemset").alias("a")), level.select(F.col("itemset").alias("b"))
    prefix = lambda c: F.slice(c, 1, F.size(c) - 1)
    joined = a.join(b, (prefix(F.col("a")) == prefix(F.col("b"))) & (F.element_at("a", -1) < F.element_at("b", -1)))
    made = joined.select(F.concat("a", F.array(F.element_at("b", -1))).alias("itemset"))
    subsets = made.select("itemset", F.explode(F.transform("itemset", lambda x: F.array_remove("itemset", x))).alias("subset"))
    met = subsets.join(level.select(F.col("itemset").alias("subset")), "subset").groupBy("itemset").count()
    return met.filter(F.col("count") == size).select("itemset")


def key(itemset: str | Column = "itemset") -> Column:
    return F.array_join(itemset, ",")
