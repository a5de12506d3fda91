"""Scores of a pattern dictionary against dual vectors: one join and one aggregation for any number of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunct.functions import scalar as S
from conjunct.operators.itemsets import key


def parts(names: list[str]) -> list[Column]:
    """Aggregates for each vector v: its sum, and the sums of its positive and negative parts (v, v_pos, v_neg)."""
    out = []
    for v in names:
        out += [F.sum(v).alias(v), F.sum(F.greatest(F.col(v), F.lit(0.0))).alias(f"{v}_pos"), F.sum(F.greatest(-F.col(v), F.lit(0.0))).alias(f"{v}_neg")]
    return out


def sums(pattern_tid: DataFrame, vectors: DataFrame, names: list[str]) -> DataFrame:
    """(itemset, s, and per vector v: v, v_pos, v_neg): support, sum, and sums of positive and negative parts."""
    return pattern_tid.join(vectors.select("tid", *names), "tid").groupBy("itemset").agg(F.count(F.lit(1)).alias("s"), *parts(names))


def centered(response: DataFrame) -> DataFrame:
    """(tid, alpha): y less its mean, by a join with the one-row mean."""
    return response.crossJoin(F.broadcast(response.agg(F.avg("y").alias("_mean")))).select("tid", (F.col("y") - F.col("_mean")).alias("alpha"))


def lambda_max(scored: DataFrame, v: str = "alpha") -> DataFrame:
    """One row: lambda_max and its pattern (of equal scores, to nine digits, the first itemset); 0 and null of nothing."""
    best = scored.select(F.abs(v).alias("c"), "itemset").orderBy(F.desc(F.round("c", 9)), "itemset").limit(1)
    return best.agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("lambda_max"), F.max(key()).alias("pattern"))


def top_k(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k highest scores; of equal ones (to nine digits) the smallest itemsets."""
    return scored.orderBy(F.desc(F.round(score, 9)), "itemset").limit(k)


def screened(scored: DataFrame, lam: float, radius: float, n: int, v: str = "alpha", mode: str = "both", second: tuple[str, float, float] | None = None) -> DataFrame:
    """scored with bound_u and bound_v, without patterns that a bound excludes: bound + pad < lam, strictly.

    Modes none, vprune, uscreen, both: by the bound of the pattern, of its subtree, or either. second (vector, radius,
    squared distance of the two references) adds a second ball: the pattern's bound is then that of both balls' common
    points, the subtree's the lesser of the two.
    """
    s = F.col("s")
    u, mass = S.ball_bound(F.col(v), s, radius, n), S.mass_bound(F.col(f"{v}_pos"), F.col(f"{v}_neg"), s, radius, n)
    if second:
        w, r2, distance2 = second
        u = S.two_ball_bound(F.col(v), F.col(w), s, radius, r2, distance2, n, pad=False)
        mass = F.least(mass, S.mass_bound(F.col(f"{w}_pos"), F.col(f"{w}_neg"), s, r2, n))
    both = scored.withColumn("bound_u", u).withColumn("bound_v", mass)
    out = {c: F.col(c) + S.roundoff_pad(F.col(c)) < lam for c in ("bound_u", "bound_v")}
    if mode in ("vprune", "both"):
        both = both.filter(~out["bound_v"])
    if mode in ("uscreen", "both"):
        both = both.filter(~out["bound_u"])
    return both


def working_set_screen(working: DataFrame, lam: float, radius: float, n: int, v: str = "alpha") -> DataFrame:
    """The columns of a working set that stay: those whose own bound doesn't exclude them."""
    return screened(working, lam, radius, n, v, "uscreen")


def cheap_reference(item_tid: DataFrame, vector: DataFrame, lam: float, v: str = "alpha") -> DataFrame:
    """One row: bound, scale and the number of items. Every itemset lies under an item, whose mass bounds its correlation,
    so scale * vector is feasible for the whole dictionary."""
    by = sums(item_tid.select(F.array("item").alias("itemset"), "tid"), vector, [v])
    bound = F.coalesce(F.max(F.greatest(f"{v}_pos", f"{v}_neg")), F.lit(0.0))
    got = by.agg(bound.alias("bound"), F.count(F.lit(1)).alias("items"))
    return got.select("bound", F.least(F.lit(1.0), F.try_divide(F.lit(lam), F.col("bound") + S.roundoff_pad(F.col("bound")))).alias("scale"), "items")


def dual_scan(scored: DataFrame, lam: float, kappa: float, v: str = "alpha") -> DataFrame:
    """One row over the whole dictionary: largest correlation, conjugate penalty, violators and their worst excess."""
    over = F.greatest(F.abs(v) - lam, F.lit(0.0))
    return scored.agg(
        F.coalesce(F.max(F.abs(v)), F.lit(0.0)).alias("max_corr"),
        F.coalesce(F.sum(over * over) / (2 * kappa), F.lit(0.0)).alias("penalty"),
        F.count_if(F.abs(v) > lam).alias("violators"),
        F.coalesce(F.max(over), F.lit(0.0)).alias("worst"),
    )


def price_scan(scored: DataFrame, lam: float, have: DataFrame, k: int, v: str = "alpha") -> DataFrame:
    """The k violators of largest correlation that the working set (itemset) lacks."""
    fresh = scored.join(have.select("itemset"), "itemset", "left_anti").withColumn("score", F.abs(v)).filter(F.col("score") > lam)
    return top_k(fresh, "score", k)
