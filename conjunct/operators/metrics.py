"""Prediction and recovery metrics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conjunct.functions.scalar import xlogy

RELATIONS = ("exact", "strict_subset", "strict_superset", "partial_overlap", "disjoint")


def deviance_term(y: Column, mu: Column, floor: float = 1e-12) -> Column:
    """2 (y ln(y / mu) - y + mu) with mu floored, never negative."""
    m = F.greatest(mu, F.lit(floor))
    return F.greatest(2 * (xlogy(y, y / m) - y + m), F.lit(0.0))


def deviance_residual(y: Column, mu: Column) -> Column:
    return F.signum(y - mu) * F.sqrt(deviance_term(y, mu))


def pearson_residual(y: Column, mu: Column) -> Column:
    m = F.greatest(mu, F.lit(1e-12))
    return (y - m) / F.sqrt(m)


def prediction_metrics(df: DataFrame, by: list[str], null: str = "train_mean", floor: float = 1e-6) -> DataFrame:
    """rmse, mae, deviance, null_deviance, pr2, r2 of (y, mu, train_mean) by groups; undefined ratios are null.

    null: whose mean the null model predicts, train_mean or test_mean.
    """
    test = df.groupBy(*by).agg(F.avg("y").alias("test_mean"))
    both = df.join(test, by)
    base = F.col(null)
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((F.col("y") - F.col("mu")) ** 2)).alias("rmse"),
        F.avg(F.abs(F.col("y") - F.col("mu"))).alias("mae"),
        F.sum(deviance_term(F.col("y"), F.col("mu"), floor)).alias("deviance"),
        F.sum(deviance_term(F.col("y"), base, floor)).alias("null_deviance"),
        F.sum((F.col("y") - F.col("mu")) ** 2).alias("sse"),
        F.sum((F.col("y") - F.col("test_mean")) ** 2).alias("sst"),
    )
    pr2 = F.when(F.col("null_deviance") > 0, 1 - F.col("deviance") / F.col("null_deviance"))
    return out.withColumn("pr2", pr2).withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")))


def raw_deviance(y: Column, mu: Column, floor: float = 1e-6) -> Column:
    """A deviance term that isn't clipped: 2 (y ln(y / mu) - y + mu) with mu floored."""
    m = F.greatest(mu, F.lit(floor))
    return 2 * (xlogy(y, y / m) - y + m)


def _over(a: Column, b: Column) -> Column:
    """1 - a / b, null where b is 0."""
    return F.when(b != 0, 1 - a / b)


def metrics_endpoint(df: DataFrame, by: list[str]) -> DataFrame:
    """r2, rmse, mae, pr2 (null model: the rows' mean) and pr2_train (null model: train_mean). Deviances are clipped as
    totals; undefined ratios are null."""
    y, mu = F.col("y"), F.col("mu")
    both = df.join(df.groupBy(*by).agg(F.avg("y").alias("test_mean")), by)
    total = lambda m: F.greatest(F.sum(raw_deviance(y, m)), F.lit(0.0))
    out = both.groupBy(*by).agg(
        F.sum((y - mu) ** 2).alias("sse"),
        F.sum((y - F.col("test_mean")) ** 2).alias("sst"),
        F.sqrt(F.avg((y - mu) ** 2)).alias("rmse"),
        F.avg(F.abs(y - mu)).alias("mae"),
        total(mu).alias("dev"),
        total(F.col("test_mean")).alias("null"),
        total(F.col("train_mean")).alias("null_train"),
    )
    c = F.col
    return out.select(*by, _over(c("sse"), c("sst")).alias("r2"), "rmse", "mae", _over(c("dev"), c("null")).alias("pr2"), _over(c("dev"), c("null_train")).alias("pr2_train"))


def metrics_recheck(df: DataFrame, by: list[str]) -> DataFrame:
    """r2 by raw predictions and pr2_train alone, recomputed from saved rows."""
    return metrics_endpoint(df, by).select(*by, "r2", "pr2_train")


def metrics_legacy(df: DataFrame, by: list[str]) -> DataFrame:
    """r2, pr2, mae, rmse, deviance of the older definition: the null mean is the rows' own, both means are at least 1e-6,
    terms aren't negative, and the null deviance is at least 1e-12."""
    y, mu = F.col("y"), F.col("mu")
    both = df.join(df.groupBy(*by).agg(F.avg("y").alias("test_mean")), by)
    out = both.groupBy(*by).agg(
        F.sum((y - mu) ** 2).alias("sse"),
        F.sum((y - F.col("test_mean")) ** 2).alias("sst"),
        F.avg(F.abs(y - mu)).alias("mae"),
        F.sqrt(F.avg((y - mu) ** 2)).alias("rmse"),
        F.sum(deviance_term(y, mu, 1e-6)).alias("deviance"),
        F.sum(deviance_term(y, F.col("test_mean"), 1e-6)).alias("null"),
    )
    return out.select(*by, _over(F.col("sse"), F.col("sst")).alias("r2"), (1 - F.col("deviance") / F.greatest("null", F.lit(1e-12))).alias("pr2"), "mae", "rmse", "deviance")


def metrics_train(df: DataFrame, by: list[str], clip: float = 20.0) -> DataFrame:
    """nll, deviance, pr2, mae, rmse of (y, eta) with eta clipped; pr2 is 0 where the null deviance vanishes."""
    y, eta = F.col("y"), F.greatest(F.least("eta", F.lit(clip)), F.lit(-clip))
    both = df.join(df.groupBy(*by).agg(F.avg("y").alias("test_mean")), by).withColumn("_eta", eta).withColumn("_mu", F.exp("_eta"))
    mu = F.col("_mu")
    out = both.groupBy(*by).agg(
        F.sum(mu - y * F.col("_eta")).alias("nll"),
        F.sum(deviance_term(y, mu)).alias("deviance"),
        F.sum(deviance_term(y, F.col("test_mean"))).alias("null"),
        F.avg(F.abs(y - mu)).alias("mae"),
        F.sqrt(F.avg((y - mu) ** 2)).alias("rmse"),
    )
    return out.select(*by, "nll", "deviance", F.when(F.col("null") <= 1e-30, 0.0).otherwise(1 - F.col("deviance") / F.col("null")).alias("pr2"), "mae", "rmse")


def recovery(active: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets of itemsets, by the columns `by` of both."""
    by = by or []
    a, t = active.select(*by, "itemset").distinct().withColumn("_a", F.lit(1)), truth.select(*by, "itemset").distinct().withColumn("_t", F.lit(1))
    both = a.join(t, [*by, "itemset"], "full")
    n = both.groupBy(*by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_a").isNull()).alias("fn"))
    return prf(n)


def prf(n: DataFrame) -> DataFrame:
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def recovery_by_order(active: DataFrame, truth: DataFrame, longest: int) -> DataFrame:
    """truths, nz, tp, fp, fn, precision, recall and f1 for each length up to `longest`; undefined ratios are null."""
    size = F.size("itemset").alias("len")
    a, t = active.select("itemset").distinct(), truth.select("itemset").distinct()
    both = a.withColumn("_a", F.lit(1)).join(t.withColumn("_t", F.lit(1)), "itemset", "full")
    n = both.groupBy(size).agg(F.count("_t").alias("truths"), F.count("_a").alias("nz"), F.count(F.col("_a") + F.col("_t")).alias("tp"))
    plan = active.sparkSession.range(1, longest + 1).select(F.col("id").cast("int").alias("len"))
    n = plan.join(n, "len", "left").na.fill(0)
    tp, nz, truths = F.col("tp"), F.col("nz"), F.col("truths")
    ratios = {"precision": F.try_divide(tp, nz), "recall": F.try_divide(tp, truths), "f1": F.try_divide(2 * tp, nz + truths)}
    return n.withColumn("fp", nz - tp).withColumn("fn", truths - tp).withColumns(ratios)


def recovery_extended(active: DataFrame, truth: DataFrame, item_tid: DataFrame, tops: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(kind, hits, precision, recall, f1, top10, ...) of active(itemset, w), for the kinds exact, closure and superset.

    exact: the truth itself is selected; closure: its closure among the transactions is (truths that occur nowhere are
    their own); superset: some selected set contains it. topK is the recall of the K largest |w| alone, ties by itemset.
    """
    from conjunct.operators import itemsets

    picked = active.select("itemset", F.abs("w").alias("w")).distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("w", 6)), "itemset")))
    t = truth.select("itemset").distinct()
    around = itemsets.closures(itemsets.contain_join(t, item_tid), item_tid).select("itemset", F.col("closure").alias("target"))
    closed = t.join(around, "itemset", "left").select(F.coalesce("target", F.col("itemset")).alias("target")).distinct()
    parts = t.select(F.col("itemset").alias("target"), F.explode("itemset").alias("x")).join(picked.select(F.explode("itemset").alias("x"), "itemset", "rank"), "x")
    above = parts.groupBy("target", "itemset", "rank").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("target")).groupBy("target").agg(F.min("rank").alias("rank"))
    exact = t.select(F.col("itemset").alias("target"))
    equal = picked.select(F.col("itemset").alias("target"), "rank")
    out = None
    for kind, targets, met in (("exact", exact, equal), ("closure", closed, equal), ("superset", exact, above)):
        r = F.col("rank")
        got = targets.join(met, "target", "left").agg(F.count("rank").alias("hits"), F.count(F.lit(1)).alias("truths"), *[F.count_if(r <= k).alias(f"t{k}") for k in tops])
        got = got.withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    n = picked.count()
    p, r = F.col("hits") / max(1, n), F.col("hits") / F.greatest("truths", F.lit(1))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select("kind", "hits", p.alias("precision"), r.alias("recall"), f1.alias("f1"), *[(F.col(f"t{k}") / F.greatest("truths", F.lit(1))).alias(f"top{k}") for k in tops])


def agreement(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """Two selections (by, itemset, w) compared: same_set, jaccard, sizes, only_one, only_two, and the largest difference
    of coefficients that both have (0 without any)."""
    a, b = one.select(*by, "itemset", F.col("w").alias("_a")), two.select(*by, "itemset", F.col("w").alias("_b"))
    both = a.join(b, [*by, "itemset"], "full")
    n = both.groupBy(*by).agg(
        F.count("_a").alias("n_one"),
        F.count("_b").alias("n_two"),
        F.count(F.col("_a") + F.col("_b")).alias("common"),
        F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("difference"),
    )
    only1, only2 = F.col("n_one") - F.col("common"), F.col("n_two") - F.col("common")
    jaccard = F.col("common") / F.greatest(F.col("n_one") + F.col("n_two") - F.col("common"), F.lit(1))
    return n.select(*by, ((only1 == 0) & (only2 == 0)).alias("same_set"), jaccard.alias("jaccard"), "n_one", "n_two", only1.alias("only_one"), only2.alias("only_two"), "difference")


def structural_overall(audited: DataFrame) -> DataFrame:
    """(relation, n, fraction, non_disjoint) of structural_audit()'s rows, relations without rows included."""
    total = audited.count()
    n = audited.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    plan = audited.sparkSession.createDataFrame([(x,) for x in RELATIONS], "relation string")
    n = plan.join(n, "relation", "left").na.fill(0, ["n"])
    apart = n.agg(F.max(F.when(F.col("relation") == "disjoint", F.col("n")))).first()[0]
    return n.select("relation", "n", (F.col("n") / max(1, total)).alias("fraction"), F.lit(1 - apart / max(1, total)).alias("non_disjoint"))


def structural_audit(active: DataFrame, truth: DataFrame) -> DataFrame:
    """(itemset, relation): exact, strict_subset, strict_superset, partial_overlap or disjoint, the first that any truth gives.

    Truths meet selected sets through shared items, so that only pairs that overlap are made.
    """
    a = active.select("itemset").distinct()
    t = truth.select(F.col("itemset").alias("truth")).distinct()
    pairs = a.select("itemset", F.explode("itemset").alias("x")).join(t.select("truth", F.explode("truth").alias("x")), "x").groupBy("itemset", "truth").agg(F.count(F.lit(1)).alias("n"))
    rank = (
        F.when((F.col("n") == F.size("itemset")) & (F.col("n") == F.size("truth")), 0)
        .when(F.col("n") == F.size("itemset"), 1)
        .when(F.col("n") == F.size("truth"), 2)
        .otherwise(3)
    )
    best = pairs.groupBy("itemset").agg(F.min(rank).alias("rank"))
    names = F.array(*[F.lit(x) for x in RELATIONS])
    return a.join(best, "itemset", "left").select("itemset", F.get(names, F.coalesce("rank", F.lit(4))).alias("relation"))


def five_seed(df: DataFrame, by: list[str], value: str, seeds: int = 5) -> DataFrame:
    """n, mean and sample SD; mean and SD only where each of the seeds is there exactly once with a value."""
    seen = F.countDistinct(F.when(F.col(value).isNotNull(), F.col("seed")))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), seen.alias("_seeds"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    whole = (F.col("n") == seeds) & (F.col("_seeds") == seeds)
    return out.select(*by, "n", F.when(whole, F.col("_mean")).alias("mean"), F.when(whole, F.col("_sd")).alias("sample_sd"))


def exclusion(df: DataFrame, by: list[str]) -> DataFrame:
    """Counter identities and the exclusion rate of paths: counts are summed before the ratio; null without traversals."""
    d = F.col("nodes") - F.col("pruned_support") - F.col("pruned_canonical") - F.col("pruned_v")
    sums = df.withColumn("visited", d).groupBy(*by).agg(F.sum(F.col("visited") - F.col("screened_u")).alias("remaining"), F.sum(F.col("eligible") * F.col("traversals")).alias("all_visits"), F.min("visited").alias("least_visited"))
    rate = F.when(F.col("all_visits") > 0, 1 - F.col("remaining") / F.col("all_visits"))
    return sums.select(*by, "remaining", "all_visits", rate.alias("rate"), (F.col("least_visited") >= 0).alias("valid"))


def point_counters(df: DataFrame, by: list[str]) -> DataFrame:
    """Counters of one search each, with what follows from them: visited (nodes less those pruned), remaining, all_visits,
    rate (null without traversals), and whether the identities hold."""
    visited = F.col("nodes") - F.col("pruned_support") - F.col("pruned_canonical") - F.col("pruned_v")
    out = df.withColumn("visited", visited).withColumn("remaining", F.col("visited") - F.col("screened_u")).withColumn("all_visits", F.col("eligible") * F.col("traversals"))
    valid = (F.least("nodes", "pruned_support", "pruned_canonical", "pruned_v", "screened_u") >= 0) & (F.col("remaining") >= 0) & (F.col("remaining") <= F.col("all_visits"))
    return out.select(*by, "visited", "remaining", "all_visits", F.when(F.col("all_visits") > 0, 1 - F.col("remaining") / F.col("all_visits")).alias("rate"), valid.alias("valid"))


def valid_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Whether counts may serve as a denominator: no screening, nothing negative, eligible = nodes - support - canonical."""
    least = F.least("nodes", "eligible", "pruned_support", "pruned_canonical")
    same = F.col("eligible") == F.col("nodes") - F.col("pruned_support") - F.col("pruned_canonical")
    return df.select(*by, ((least >= 0) & (F.col("pruned_v") == 0) & (F.col("screened_u") == 0) & same).alias("valid"))


def annotate_modal(df: DataFrame, by: list[str], profile: str) -> DataFrame:
    """The most frequent profile of each group; of equal counts the first in order; with the number of ties."""
    n = df.filter(F.col(profile).isNotNull()).groupBy(*by, profile).agg(F.count(F.lit(1)).alias("count"))
    top = n.groupBy(*by).agg(F.max("count").alias("count"), F.sum("count").alias("resolved"))
    ties = n.join(top, [*by, "count"])
    return ties.groupBy(*by, "count", "resolved").agg(F.min(profile).alias("modal"), F.count(F.lit(1)).alias("ties"))


def mean_std(grouped, value: str) -> DataFrame:
    """n, mean and the sample SD of grouped rows, which for a single value is 0 (sd_or_zero) or undefined (sd)."""
    sd = F.stddev_samp(value)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(sd, F.lit(0.0)).alias("sd_or_zero"), sd.alias("sd"))


def coverage(jobs: DataFrame, completed: Column, failed: Column, invalid: Column, pending: Column) -> DataFrame:
    """One row: how many planned jobs are in each state, and whether none is pending."""
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("expected"), F.count_if(completed).alias("completed"), F.count_if(failed).alias("failed"), F.count_if(pending).alias("pending"), F.count_if(invalid).alias("invalid"), (F.count_if(~pending) == n).alias("accounted"))


def mismatches(df: DataFrame, saved: str, again: str, rtol: float = 1e-10, atol: float = 1e-8) -> DataFrame:
    """Rows whose recomputed value isn't close to the saved one; null equals null alone."""
    a, b = F.col(saved), F.col(again)
    same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    return df.filter(~same)
