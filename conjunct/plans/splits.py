"""Row and group splits.

A seeded permutation is the order of the keys' SHA-256 with the seed, which any engine can recompute; places in it come
from counts of hash ranges and ranks inside each range, so no list of keys reaches the driver or a single task. The two
registered_ functions follow numpy's permutations of the study's registered seeds; they hold all keys on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits that make a range of the hash order.
DIGITS = 3


def _placed(keys: DataFrame, order: str, ranges: str) -> DataFrame:
    """keys with place, its rank (from 0) in `order`, given a column of ranges that `order` respects."""
    sizes = keys.groupBy(ranges).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(ranges, before.alias("_before"))  # one row a range
    rank = F.row_number().over(Window.partitionBy(ranges).orderBy(order)) - 1
    return keys.withColumn("_rank", rank).join(F.broadcast(offsets), ranges).withColumn("place", (F.col("_rank") + F.col("_before")).cast("long")).drop("_rank", "_before")


def permuted(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, place) of the distinct keys in a seeded order."""
    keys = df.select(key).distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    return _placed(keys.withColumn("_range", F.substring("_h", 1, DIGITS)), "_h", "_range").select(key, "place")


def ordinal(df: DataFrame, key: str, ranges: int = 4096) -> DataFrame:
    """df with place, the rank (from 0) of its row by an integer key that doesn't repeat."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn("place", F.lit(None).cast("long"))
    width = (high - low) // ranges + 1
    return _placed(df.withColumn("_range", F.expr(f"(`{key}` - {low}) div {width}")), key, "_range").drop("_range")


def parts(place: Column, n: int, folds: int) -> Column:
    """Which of `folds` parts a place is in, whose sizes differ by one at most, the larger first."""
    each, more = divmod(n, folds)
    cut = more * (each + 1)
    return F.when(place < cut, F.floor(place / (each + 1))).otherwise(more + F.floor((place - cut) / max(each, 1))).cast("int")


def kfold(df: DataFrame, key: str, seed: int, folds: int = 3) -> DataFrame:
    """df with fold: the permuted keys cut into parts whose sizes differ by one at most."""
    order = permuted(df, key, seed)
    n = df.select(key).distinct().count()
    return df.join(order.select(key, parts(F.col("place"), n, folds).alias("fold")), key)


def group_split(df: DataFrame, group: str, seed: int, share: float = 0.1) -> DataFrame:
    """df with role: test for a share of the groups (rounded up), train for the others."""
    order = permuted(df, group, seed)
    held = int(np.ceil(round(share * df.select(group).distinct().count(), 9)))
    return df.join(order.select(group, F.when(F.col("place") < held, "test").otherwise("train").alias("role")), group)


def group_folds(df: DataFrame, group: str, seed: int, folds: int = 3) -> DataFrame:
    """df with fold, where all rows of a group are in one fold and folds have as many groups, but for one."""
    return kfold(df, group, seed, folds)


def prepare_split(df: DataFrame, group: str, seed: int, share: float = 0.1, folds: int = 3) -> DataFrame:
    """df with role and, for the training rows, fold; both by group."""
    both = group_split(df, group, seed, share)
    held = group_folds(both.filter("role = 'train'").select(group).distinct(), group, seed, folds)
    return both.join(held, group, "left")


def restore_rows(split: DataFrame, row: str) -> DataFrame:
    """The rows of a split without its columns, as they were; a row id that repeats is an error."""
    seen = split.groupBy(row).agg(F.count(F.lit(1)).alias("_n"))
    whole = split.join(seen, row).withColumn(row, F.when(F.col("_n") == 1, F.col(row)).otherwise(F.raise_error(F.lit("a row id repeats")).cast(split.schema[row].dataType)))
    return whole.drop("role", "fold", "_n")


def split_endpoint(df: DataFrame, key: str, seed: int, share: float = 0.1) -> DataFrame:
    """df with role train, validation or test: the last two have a share of the rows each, rounded down but one at least."""
    n = df.count()
    held = max(1, int(share * n))
    place = F.col("place")
    role = F.when(place < n - 2 * held, "train").when(place < n - held, "validation").otherwise("test")
    return df.join(permuted(df, key, seed).select(key, role.alias("role")), key)


def registered_kfold(df: DataFrame, key: str, seed: int, folds: int = 3) -> DataFrame:
    """df with fold: a permutation of the sorted keys cut into parts whose sizes differ by one at most."""
    keys = np.array([r[0] for r in df.select(key).distinct().orderBy(key).collect()])
    parts = np.array_split(np.random.default_rng(seed).permutation(len(keys)), folds)
    rows = [(keys[i].item(), f) for f, part in enumerate(parts) for i in part]
    return df.join(df.sparkSession.createDataFrame(rows, df.select(key).schema.add("fold", "integer")), key)


def registered_group_split(df: DataFrame, group: str, seed: int, share: float = 0.1) -> DataFrame:
    """df with role: test for a share of the sorted groups (rounded up), train for the others."""
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    order = np.random.RandomState(seed).permutation(len(groups))
    held = {groups[i] for i in order[: int(np.ceil(share * len(groups)))]}
    rows = [(g, "test" if g in held else "train") for g in groups]
    return df.join(df.sparkSession.createDataFrame(rows, df.select(group).schema.add("role", "string")), group)


def hash_fold(key: str, folds: int = 3) -> Column:
    """A split that needs no driver: the key modulo the number of folds."""
    return F.pmod(F.col(key), F.lit(folds)).cast("int")
