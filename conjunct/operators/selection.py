"""Choices over grids and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cv_choice(scores: DataFrame, by: list[str], folds: int, points: int) -> DataFrame:
    """Per group the point of least mean rmse, the smallest index of equal ones, only where folds * points scores are there."""
    mean = scores.groupBy(*by, "point").agg(F.avg("rmse").alias("mean_rmse"), F.count("rmse").alias("n"))
    best = mean.groupBy(*by).agg(F.min(F.struct(F.round("mean_rmse", 9).alias("r"), "point")).alias("b"), F.sum("n").alias("n"))
    return best.filter(F.col("n") == folds * points).select(*by, F.col("b.point").alias("point"), F.col("b.r").alias("mean_rmse"))


def one_se(scores: DataFrame, by: list[str], folds: int = 3) -> DataFrame:
    """Per group the first point whose mean is within one standard error of the least."""
    mean = scores.groupBy(*by, "point").agg(F.avg("rmse").alias("m"), (F.stddev_samp("rmse") / folds**0.5).alias("se"))
    least = mean.groupBy(*by).agg(F.min(F.struct("m", "point", "se")).alias("b"))
    limit = least.select(*by, (F.col("b.m") + F.col("b.se")).alias("limit"), F.col("b.point").alias("cv_min"))
    return mean.join(limit, by).filter(F.round(F.col("m"), 9) <= F.round(F.col("limit"), 9)).groupBy(*by, "cv_min").agg(F.min("point").alias("one_se"))


def rank_cv(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Competition rank, the highest value first."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value))))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def stop_rule(df: DataFrame, by: list[str], level: str, value: str, drop: float) -> DataFrame:
    """Change of a value from the level before, and whether it fell by more than `drop`."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(level))
    return df.withColumn("change", F.col(value) - before).withColumn("stop", F.coalesce(F.col("change") < -drop, F.lit(False)))


def paired_drop(df: DataFrame, by: list[str], level: str, seed: str, value: str, first: int, drop: float) -> DataFrame:
    """(by, level, paired_drop, worse): mean fall from level `first`, paired by seed, and in how many seeds it is `drop` or more."""
    base = df.filter(F.col(level) == first).select(*by, seed, F.col(value).alias("_base"))
    fall = F.col("_base") - F.col(value)
    return df.join(base, [*by, seed]).groupBy(*by, level).agg(F.avg(fall).alias("paired_drop"), F.count_if(fall >= drop).alias("worse"))


def compact_select(scores: DataFrame, by: list[str], folds: int = 3) -> DataFrame:
    """(by, size, alpha) from scores(by, size, alpha, fold, rmse): each size takes its best alpha, the best size gives the
    limit (its mean and standard error), and the smallest size within it is chosen."""
    mean = scores.groupBy(*by, "size", "alpha").agg(F.avg("rmse").alias("m"), (F.stddev_samp("rmse") / folds**0.5).alias("se"))
    best = mean.groupBy(*by, "size").agg(F.min(F.struct("m", "alpha", "se")).alias("b")).select(*by, "size", "b.*")
    limit = best.groupBy(*by).agg(F.min(F.struct("m", "se")).alias("b")).select(*by, (F.col("b.m") + F.col("b.se")).alias("limit"))
    within = best.join(limit, by).filter(F.round(F.col("m"), 9) <= F.round(F.col("limit"), 9))
    return within.groupBy(*by).agg(F.min("size").alias("size"), F.min_by("alpha", "size").alias("alpha"))


def whole_paths(df: DataFrame, by: list[str], point: str, verified, points: int) -> DataFrame:
    """The rows of groups that have each of `points` points once, all of them verified."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(point).alias("_points"), F.count_if(verified).alias("_ok"))
    whole = n.filter((F.col("_n") == points) & (F.col("_points") == points) & (F.col("_ok") == points)).select(*by)
    return df.join(whole, by, "left_semi")
