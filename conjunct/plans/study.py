"""Further registered queries: splits, models given their coefficients, recovery, study summaries. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conjunct.functions import scalar
from conjunct.operators import itemsets, metrics, scoring, selection
from conjunct.operators.itemsets import key
from conjunct.plans import path, splits
from conjunct.plans.queries import _ALL, _BI, _CL, _CNT, _FULL, _GRID, _MS, _PARTS, _PRED, _RUNS, _Y, Baskets, counters, grid_scores, predictions, query, r4, runs, selected_parts
from conjunct.plans.store import written
from conjunct.sources.tables import basket_items, basket_response, read

SEED = 42


def _r(digits: int, **columns) -> list:
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


# ---- splits. A permutation is the order of sha256(seed:key), so SQL makes the same one.

def _perm(of: str, id_: str) -> str:
    return f"select {id_}, row_number() over (order by sha256('{SEED}:' || {id_})) - 1 as place, count(*) over () as n from (select distinct {id_} from {of})"


_FOLD = "case when place < (n % 3) * (n // 3 + 1) then place // (n // 3 + 1) else n % 3 + (place - (n % 3) * (n // 3 + 1)) // greatest(n // 3, 1) end"


@query(f"with {_Y}, pm as ({_perm('y', 'tid')}) select tid, cast({_FOLD} as int) as fold from pm")
def kfold(spark, sf_dir):
    return splits.kfold(basket_response(spark, sf_dir), "tid", SEED).select("tid", "fold")


_ROLE = f"pm as ({_perm('orders', 'o_custkey')}), gr as (select o_custkey, case when place < ceil(round(0.1 * n, 9)) then 'test' else 'train' end as role from pm)"
_GFOLD = f"{_ROLE}, pf as ({_perm('(select o_custkey from gr where role = ' + chr(39) + 'train' + chr(39) + ')', 'o_custkey')}), gf as (select o_custkey, cast({_FOLD} as int) as fold from pf)"


def orders_of(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


@query(f"with {_ROLE} select o_orderkey, o_custkey, role from orders join gr using (o_custkey)")
def group_split(spark, sf_dir):
    return splits.group_split(orders_of(spark, sf_dir), "o_custkey", SEED).select("o_orderkey", "o_custkey", "role")


@query(f"with pf as ({_perm('orders', 'o_custkey')}) select o_orderkey, cast({_FOLD} as int) as fold from orders join pf using (o_custkey)")
def group_folds(spark, sf_dir):
    return splits.group_folds(orders_of(spark, sf_dir), "o_custkey", SEED).select("o_orderkey", "fold")


@query(f"with {_GFOLD} select o_orderkey, o_custkey, role, fold from orders join gr using (o_custkey) left join gf using (o_custkey)")
def prepare_split(spark, sf_dir):
    return splits.prepare_split(orders_of(spark, sf_dir), "o_custkey", SEED).select("o_orderkey", "o_custkey", "role", "fold")


@query("select o_orderkey, o_custkey from orders")
def restore_rows(spark, sf_dir):
    """What a split is made of, put together again."""
    return splits.restore_rows(splits.prepare_split(orders_of(spark, sf_dir), "o_custkey", SEED), "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"with {_Y}, pm as ({_perm('y', 'tid')}), h as (select *, greatest(1, cast(floor(0.1 * n) as bigint)) as held from pm) select tid, case when place < n - 2 * held then 'train' when place < n - held then 'validation' else 'test' end as role from h")
def split_endpoint(spark, sf_dir):
    return splits.split_endpoint(basket_response(spark, sf_dir), "tid", SEED).select("tid", "role")


@query(f"with {_GFOLD}, f as (select unnest([0, 1, 2]) as k), s as (select k, gf.fold <> k as fit, o_custkey from orders join gf using (o_custkey), f) select k as fold, count(case when fit then 1 end) as n_fit, count(case when not fit then 1 end) as n_validation, count(distinct case when fit then o_custkey end) as fit_groups, count(distinct case when not fit then o_custkey end) as validation_groups, count(distinct o_custkey) = count(distinct case when fit then o_custkey end) + count(distinct case when not fit then o_custkey end) as apart from s group by 1")
def split_audit(spark, sf_dir):
    """Sizes of each fold's two sides in rows and groups, and whether no group is on both."""
    rows = splits.prepare_split(orders_of(spark, sf_dir), "o_custkey", SEED).filter("role = 'train'")
    each = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("fit", F.col("fold") != F.col("k"))
    fit, held = F.when(F.col("fit"), F.col("o_custkey")), F.when(~F.col("fit"), F.col("o_custkey"))
    n = each.groupBy(F.col("k").alias("fold")).agg(F.count(fit).alias("n_fit"), F.count(held).alias("n_validation"), F.countDistinct(fit).alias("fit_groups"), F.countDistinct(held).alias("validation_groups"), F.countDistinct("o_custkey").alias("_all"))
    return n.withColumn("apart", F.col("_all") == F.col("fit_groups") + F.col("validation_groups")).drop("_all")


@query("with c as (select o_orderkey % 3 as fold, o_orderkey // 4096 as chunk, count(*) as rows, sha256(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey)) as h from orders group by 1, 2) select fold, sum(rows)::bigint as rows, sha256(string_agg(h, ',' order by chunk)) as fingerprint from c group by 1")
def split_fingerprint(spark, sf_dir):
    """A digest of the digests of each fold's id ranges, so no fold's ids meet in one row."""
    o = read(spark, sf_dir, "orders").groupBy(F.pmod("o_orderkey", F.lit(3)).alias("fold"), F.expr("o_orderkey div 4096").alias("chunk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    chunks = o.agg(F.count(F.lit(1)).alias("rows"), F.sha2(text, 256).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "h"))), lambda x: x["h"]), ",")
    return chunks.groupBy("fold").agg(F.sum("rows").alias("rows"), F.sha2(listed, 256).alias("fingerprint"))


@query(f"with {_BI}, {_Y}, tr as (select tid, y from y where tid % 10 < 7) select tid, y, row_number() over (order by tid) - 1 as place, cast(greatest(3, ceil(round(0.015 * count(*) over (), 6))) as bigint) as min_support, sha256(string_agg(item, ',' order by item)) as digest from tr join bi using (tid) group by tid, y")
def scan_dataset_pruning(spark, sf_dir):
    """The training rows with their place in the training order, the support recomputed on them, and each row's digest."""
    train = basket_response(spark, sf_dir).filter("tid % 10 < 7")
    rows = splits.ordinal(train.join(itemsets.baskets(basket_items(spark, sf_dir)), "tid"), "tid")
    least = itemsets.min_support(train.count())
    return rows.select("tid", "y", "place", F.lit(least).cast("long").alias("min_support"), F.sha2(key("items"), 256).alias("digest"))


@query("""with raw as (select l_orderkey as tid, l_partkey as item, count(*) as copies from lineitem group by 1, 2), roles as (select o_orderkey as tid, case when o_orderkey % 10 < 7 then 'train' else 'test' end as role from orders)
select 'repeated_item' as issue, count(*) as n from raw where copies > 1
union all select 'item_out_of_range', count(*) from raw where not exists (select 1 from part where p_partkey = item)
union all select 'row_without_split', count(*) from (select distinct tid from raw) r where not exists (select 1 from roles where roles.tid = r.tid)
union all select 'row_in_two_splits', count(*) from (select tid from roles group by 1 having count(distinct role) > 1)
union all select 'bad_response', count(*) from (select l_orderkey, sum(l_quantity) as y from lineitem group by 1) where y is null or isnan(y) or y < 0""")
def validate_data(spark, sf_dir):
    """How many rows break each rule of a dataset: items of a row distinct and known, splits a partition, responses valid."""
    raw = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tid"), F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("copies"))
    roles = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid"), F.when(F.col("o_orderkey") % 10 < 7, "train").otherwise("test").alias("role"))
    y = basket_response(spark, sf_dir)
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    broken = {
        "repeated_item": raw.filter("copies > 1"),
        "item_out_of_range": raw.join(parts, "item", "left_anti"),
        "row_without_split": raw.select("tid").distinct().join(roles, "tid", "left_anti"),
        "row_in_two_splits": roles.groupBy("tid").agg(F.countDistinct("role").alias("n")).filter("n > 1"),
        "bad_response": y.filter(F.col("y").isNull() | F.isnan("y") | (F.col("y") < 0)),
    }
    return itemsets.reduce_union([df.agg(F.lit(name).alias("issue"), F.count(F.lit(1)).alias("n")) for name, df in broken.items()])


# ---- metric definitions that differ

_RAW6 = "2 * (case when y = 0 then 0 else y * ln(y / greatest({m}, 1e-6)) end - y + greatest({m}, 1e-6))"
_TE = "te as (select grp, avg(y) as test_mean from pr group by 1)"
_R2 = "round(1 - sum(power(y - mu, 2)) / sum(power(y - test_mean, 2)), 6)"


@query(f"with {_PRED}, {_TE} select grp, {_R2} as r2, round(sqrt(avg(power(y - mu, 2))), 5) as rmse, round(avg(abs(y - mu)), 5) as mae, round(1 - greatest(sum({_RAW6.format(m='mu')}), 0) / greatest(sum({_RAW6.format(m='test_mean')}), 0), 6) as pr2, round(1 - greatest(sum({_RAW6.format(m='mu')}), 0) / greatest(sum({_RAW6.format(m='train_mean')}), 0), 6) as pr2_train from pr join te using (grp) group by 1")
def metrics_endpoint(spark, sf_dir):
    m = metrics.metrics_endpoint(predictions(spark, sf_dir), ["grp"])
    return m.select("grp", *_r(6, r2="r2", pr2="pr2", pr2_train="pr2_train"), *_r(5, rmse="rmse", mae="mae"))


@query(f"with {_PRED}, {_TE} select grp, {_R2} as r2, round(1 - greatest(sum({_RAW6.format(m='mu')}), 0) / greatest(sum({_RAW6.format(m='train_mean')}), 0), 6) as pr2_train from pr join te using (grp) group by 1")
def metrics_recheck(spark, sf_dir):
    return metrics.metrics_recheck(predictions(spark, sf_dir), ["grp"]).select("grp", *_r(6, r2="r2", pr2_train="pr2_train"))


_CLIP6 = f"greatest({_RAW6}, 0)"


@query(f"with {_PRED}, {_TE} select grp, {_R2} as r2, round(1 - sum({_CLIP6.format(m='mu')}) / greatest(sum({_CLIP6.format(m='test_mean')}), 1e-12), 6) as pr2, round(avg(abs(y - mu)), 5) as mae, round(sqrt(avg(power(y - mu, 2))), 5) as rmse, round(sum({_CLIP6.format(m='mu')}), 3) as deviance from pr join te using (grp) group by 1")
def metrics_legacy(spark, sf_dir):
    m = metrics.metrics_legacy(predictions(spark, sf_dir), ["grp"])
    return m.select("grp", *_r(6, r2="r2", pr2="pr2"), *_r(5, mae="mae", rmse="rmse"), *_r(3, deviance="deviance"))


_CLIP12 = _CLIP6.replace("1e-6", "1e-12")


@query(f"with {_PRED}, e as (select grp, y, greatest(least(ln(mu) / 4, 20), -20) as eta from pr), {_TE}, m as (select grp, y, eta, exp(eta) as mu, test_mean from e join te using (grp)) select grp, round(sum(mu - y * eta), 2) as nll, round(sum({_CLIP12.format(m='mu')}), 2) as deviance, round(1 - sum({_CLIP12.format(m='mu')}) / sum({_CLIP12.format(m='test_mean')}), 6) as pr2, round(avg(abs(y - mu)), 5) as mae, round(sqrt(avg(power(y - mu, 2))), 5) as rmse from m group by 1")
def metrics_train(spark, sf_dir):
    m = metrics.metrics_train(predictions(spark, sf_dir).withColumn("eta", F.ln("mu") / 4), ["grp"])
    return m.select("grp", *_r(2, nll="nll", deviance="deviance"), *_r(6, pr2="pr2"), *_r(5, mae="mae", rmse="rmse"))


# ---- a model with given coefficients: intercept, objective, dual, gap, radius, optimality

LAMBDA, KAPPA = 50.0, 0.05
_W = "w as (select * from (values ('R:AMERICA', 0.2), ('P:1-URGENT', -0.3)) t(p, w))"
_Z = f"{_W}, z as (select y.tid, y.y, coalesce(sum(w.w), 0) as z from y join bi using (tid) left join w on w.p = bi.item group by 1, 2)"
_IB = "ib as (select ln(sum(y)) - (max(z) + ln(sum(exp(z)) / exp(max(z)))) as b, count(*) as n, sum(y) as t from z)"
_MU = "mu as (select tid, y, b + z as eta, exp(b + z) as mu from z, ib)"
_ALPHA = "al as (select tid, y, mu, eta, y - mu as alpha from mu)"
_S2 = "s2 as (select pt.p, sum(alpha) as a, sum(mu - al.y) as g from pt semi join cp using (p) join al using (tid) group by 1)"
_MODEL = f"{_ALL}, {_CL}, {_Z}, {_IB}, {_MU}, {_ALPHA}, {_S2}"


class Given:
    """A model of two items on the orders, its intercept the best one for them."""

    W = [("R:AMERICA", 0.2), ("P:1-URGENT", -0.3)]

    def __init__(self, spark, sf_dir):
        self.b = Baskets(spark, sf_dir)
        w = spark.createDataFrame(self.W, "item string, w double")
        hits = self.b.items.join(F.broadcast(w), "item").groupBy("tid").agg(F.sum("w").alias("z"))
        self.z = self.b.y.join(hits, "tid", "left").select("tid", "y", F.coalesce("z", F.lit(0.0)).alias("z"))
        r = self.z.agg(F.ln(F.sum("y")) - scalar.logsumexp("z")).first()
        self.intercept = r[0]

    def rows(self) -> DataFrame:
        """(tid, y, eta, mu, alpha)"""
        eta = F.lit(self.intercept) + F.col("z")
        return self.z.select("tid", "y", eta.alias("eta"), F.exp(eta).alias("mu"), (F.col("y") - F.exp(eta)).alias("alpha"))

    def scored(self) -> DataFrame:
        """(itemset, s, alpha) of the closed dictionary for the model's dual vector."""
        vector = self.rows().select("tid", "alpha")
        rows = self.b.rows().join(vector, "tid").select("items", "alpha")
        found = itemsets.levels(rows, self.b.least, self.b.max_len + 1, scoring.parts(["alpha"]), written)
        return itemsets.named(itemsets.closed_of(found, self.b.max_len), self.b.names)

    def primal(self) -> float:
        w = [v for _, v in self.W]
        loss = self.rows().agg(F.sum(F.col("mu") - F.col("y") * F.col("eta"))).first()[0]
        return loss + LAMBDA * sum(abs(v) for v in w) + KAPPA / 2 * sum(v * v for v in w)

    def dual(self) -> tuple[float, float]:
        """The loss's and the penalty's conjugate."""
        t = F.col("mu")
        loss = self.rows().agg(F.sum(scalar.xlogy(t, t) - t)).first()[0]
        over = F.greatest(F.abs("alpha") - LAMBDA, F.lit(0.0))
        return loss, (self.scored().agg(F.sum(over * over)).first()[0] or 0.0) / (2 * KAPPA)


@query(f"with {_BI}, {_Y}, {_Z}, {_IB} select round(b, 7) as intercept from ib")
def profile_intercept(spark, sf_dir):
    """log of the responses' sum less log-sum-exp of the linear part."""
    return spark.createDataFrame([(round(Given(spark, sf_dir).intercept, 7),)], "intercept double")


_PRIMAL = f"select sum(mu - y * eta) + {LAMBDA} * (select sum(abs(w)) from w) + {KAPPA} / 2 * (select sum(w * w) from w) from al"
_LSTAR = "select sum(mu * ln(mu) - mu) from al"
_USTAR = f"select sum(power(greatest(abs(a) - {LAMBDA}, 0), 2)) / (2 * {KAPPA}) from s2"


@query(f"with {_BI}, {_Y}, {_Z}, {_IB}, {_MU}, {_ALPHA} select round(({_PRIMAL}), 2) as objective")
def objective(spark, sf_dir):
    return spark.createDataFrame([(round(Given(spark, sf_dir).primal(), 2),)], "objective double")


@query(f"{_MODEL} select round(({_LSTAR}), 2) as loss, round(({_USTAR}) / 1e6, 4) as penalty_m, round((-({_LSTAR}) - ({_USTAR})) / 1e6, 4) as dual_m")
def dual_value(spark, sf_dir):
    loss, penalty = Given(spark, sf_dir).dual()
    return spark.createDataFrame([(round(loss, 2), round(penalty / 1e6, 4), round((-loss - penalty) / 1e6, 4))], "loss double, penalty_m double, dual_m double")


@query(f"with {_BI}, {_Y}, {_Z}, {_IB}, {_MU}, {_ALPHA} select tid, round(alpha, 6) as alpha from al")
def dual_feasible(spark, sf_dir):
    """y less the means that have the responses' sum; the sum's round-off goes to a row of the largest mean."""
    rows = Given(spark, sf_dir).rows()
    r = rows.agg(F.sum("alpha").alias("off"), F.max(F.struct("mu", "tid")).alias("top")).first()
    fixed = F.when(F.col("tid") == r["top"]["tid"], F.col("alpha") - r["off"]).otherwise(F.col("alpha"))
    return rows.select("tid", F.round(fixed, 6).alias("alpha"))


_GAP = f"({_PRIMAL}) + ({_LSTAR}) + ({_USTAR})"


@query(f"{_MODEL} select round(greatest({_GAP}, 0) / 1e6, 4) as gap_m")
def gap(spark, sf_dir):
    g = Given(spark, sf_dir)
    return spark.createDataFrame([(round(max(0.0, g.primal() + sum(g.dual())) / 1e6, 4),)], "gap_m double")


@query(f"{_MODEL}, g as (select greatest({_GAP}, 0) as g, (select greatest(max(mu), 0) from al) as most, (select sum(y) from y) as t), s as (select g, least(t, most + g + sqrt(g * (g + 2 * most))) as scale from g) select round(scale, 3) as scale, round(sqrt(2 * scale * g) / 1e3, 4) as radius_k from s")
def radius(spark, sf_dir):
    """Radius of a ball around the dual vector that holds the optimum, and its scale."""
    g = Given(spark, sf_dir)
    rows = g.rows().agg(F.max(F.col("y") - F.col("alpha")).alias("most")).first()
    d, most = max(0.0, g.primal() + sum(g.dual())), max(0.0, rows["most"])
    scale = min(g.b.total, most + d + (d * (d + 2 * most)) ** 0.5)
    return spark.createDataFrame([(round(scale, 3), round((2 * scale * d) ** 0.5 / 1e3, 4))], "scale double, radius_k double")


@query(f"{_MODEL}, v as (select case when w.w is null then greatest(abs(g) - {LAMBDA}, 0) else abs(g + {KAPPA} * w.w + {LAMBDA} * sign(w.w)) end as v from s2 left join w using (p)) select round(greatest((select max(v) from v), abs((select sum(mu - y) from al))) / (select n from ib), 6) as kkt")
def kkt_residual(spark, sf_dir):
    """Largest violation of the optimality conditions over the whole dictionary and the intercept, per row."""
    g = Given(spark, sf_dir)
    w = spark.createDataFrame([([i], v) for i, v in g.W], "itemset array<string>, w double")
    slope = -F.col("alpha")  # the gradient of the loss; the ridge term is added for the working set
    held = F.abs(slope + KAPPA * F.col("w") + LAMBDA * F.signum("w"))
    worst = g.scored().join(F.broadcast(w), "itemset", "left").agg(F.max(F.when(F.col("w").isNull(), F.greatest(F.abs(slope) - LAMBDA, F.lit(0.0))).otherwise(held))).first()[0]
    sums = g.rows().agg(F.abs(F.sum(F.col("mu") - F.col("y")))).first()[0]
    return spark.createDataFrame([(round(max(worst or 0.0, sums) / g.b.n, 6),)], "kkt double")


@query(f"with {_BI}, {_Y}, {_MS}, m as (select item, sum(greatest(y - m, 0)) as ap, sum(greatest(m - y, 0)) as an from bi join y using (tid), ms group by 1), b as (select max(greatest(ap, an)) as bound, count(*) as items from m) select round(bound, 4) as bound, round(least(1, {LAMBDA} / bound), 8) as scale, items from b")
def cheap_reference(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    got = scoring.cheap_reference(b.items, b.y.select("tid", (F.col("y") - b.mean).alias("alpha")), LAMBDA)
    return got.select(*_r(4, bound="bound"), *_r(8, scale="scale"), "items")


_U3 = "abs(a) + 3.0 * sqrt(greatest(s - s * s / cast(n as double), 0))"


@query(f"{_FULL}, ws as (select * from sc order by round(abs(a), 9) desc, p limit 60) select p from ws, ms, lm where {_U3} >= 0.6 * lam")
def ws_screen(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    scored = written(b.scored().withColumn("score", F.abs("alpha")), "scored")
    lam = 0.6 * (scored.agg(F.max("score")).first()[0] or 0.0)
    return scoring.working_set_screen(scoring.top_k(scored, "score", 60), lam, 3.0, b.n).select(key().alias("p"))


_V3 = "greatest(ap, an) + 3.0 * sqrt(least(s, n / 2.0) - least(s, n / 2.0) * least(s, n / 2.0) / n)"


@query(f"{_FULL}, k as (select {_U3} >= 0.5 * lam as u, {_V3} >= 0.5 * lam as v from sc, ms, lm) select mode, count(case when (u or mode not in ('uscreen', 'both')) and (v or mode not in ('vprune', 'both')) then 1 end) as kept from k, (select unnest(['none', 'vprune', 'uscreen', 'both']) as mode) group by 1")
def dfs_modes(spark, sf_dir):
    """How many patterns each mode of the screened search keeps."""
    b = Baskets(spark, sf_dir)
    scored = written(b.scored(), "scored")
    lam = 0.5 * (scored.agg(F.max(F.abs("alpha"))).first()[0] or 0.0)
    return itemsets.reduce_union([scoring.screened(scored, lam, 3.0, b.n, mode=m).agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("kept")) for m in ("none", "vprune", "uscreen", "both")])


# ---- dictionaries

@query(f"{_ALL}, {_CL} select p, s as support from cp")
def mine_closed_ext(spark, sf_dir):
    """The closed dictionary by another miner, MLlib's frequent-pattern trees, and the closure test on its output."""
    from pyspark.ml.fpm import FPGrowth

    b = Baskets(spark, sf_dir)
    rows = itemsets.named(b.rows().select("items"), b.names, "items") if b.rows() is not None else None
    n = max(1, rows.count())
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (b.least - 0.5) / n)).fit(rows).freqItemsets
    found = written(found.filter(F.size("items") <= b.max_len + 1).select(F.array_sort("items").alias("itemset"), F.col("freq").alias("s")), "miner")
    by = [found.filter(F.size("itemset") == k) for k in range(1, b.max_len + 2)]
    return itemsets.closed_of(by, b.max_len).select(key().alias("p"), F.col("s").alias("support"))


_SPLIT = "string_split(p, ',') as i, string_split(closure, ',') as c"


@query(f"{_ALL}, {_CL}, q as (select p, s, {_SPLIT} from clo where len > 1), e as (select p, s, i, unnest(c) as x from q), f as (select p, s, count(case when not list_contains(i, x) and x < i[-1] then 1 end) = 0 as canonical, string_agg(case when list_contains(i, x) or x > i[-1] then x end, ',' order by x) as closure from e group by 1, 2) select p, s as support, canonical, closure from f")
def closure_canonical(spark, sf_dir):
    """The closure of each grown set by items after its last one, and whether no earlier item belongs to it."""
    b = Baskets(spark, sf_dir)
    found = itemsets.closure_step(b.levels())
    return itemsets.named(itemsets.named(found, b.names), b.names, "closure").select(key().alias("p"), "support", "canonical", key("closure").alias("closure"))


@query(f"with {_CNT} select arm, path, nodes >= 0 and eligible >= 0 and pruned_support >= 0 and pruned_canonical >= 0 and pruned_v - 3 = 0 and screened_u * 0 = 0 and eligible = nodes - pruned_support - pruned_canonical as valid from cnt")
def validate_counts(spark, sf_dir):
    """Counts of bare enumerations: those with all rows closed satisfy the identity."""
    bare = counters(spark, sf_dir).withColumn("pruned_v", F.lit(0)).withColumn("screened_u", F.lit(0))
    return metrics.valid_counts(bare, ["arm", "path"])


@query(f"with {_CNT}, d as (select *, nodes - pruned_support - pruned_canonical - pruned_v as visited from cnt) select arm, path, visited, visited - screened_u as remaining, eligible * traversals as all_visits, round(case when traversals > 0 then 1 - (visited - screened_u) / (eligible * traversals) end, 8) as rate, visited - screened_u >= 0 and visited - screened_u <= eligible * traversals and screened_u >= 0 as valid from d")
def fit_counters(spark, sf_dir):
    return metrics.point_counters(counters(spark, sf_dir), ["arm", "path"]).withColumn("rate", F.round("rate", 8))


# ---- recovery

_TRU = "tru as (select unnest(['N:NATION_1,R:AMERICA', 'P:1-URGENT', 'N:NATION_2', 'P:2-HIGH,R:EUROPE']) as t)"
_SELP = "sel as (select p, abs(a) as w, row_number() over (order by round(abs(a), 6) desc, p) as rk from sc qualify rk <= 60)"


def truths(spark) -> DataFrame:
    rows = [["N:NATION_1", "R:AMERICA"], ["P:1-URGENT"], ["N:NATION_2"], ["P:2-HIGH", "R:EUROPE"]]
    return spark.createDataFrame([(r,) for r in rows], "itemset array<string>")


def selected(b: Baskets) -> DataFrame:
    """(itemset, w): the sixty closed sets of the largest correlations."""
    scored = b.scored().withColumn("w", F.abs("alpha"))
    return written(scored.orderBy(F.desc(F.round("w", 6)), "itemset").limit(60).select("itemset", "w"), "selected")


@query(f"{_FULL}, {_SELP}, {_TRU}, j as (select coalesce(len(string_split(p, ',')), len(string_split(t, ','))) as len, p, t from sel full join tru on p = t), c as (select l.len, count(t) as truths, count(p) as nz, count(case when p is not null and t is not null then 1 end) as tp from (select unnest([1, 2, 3]) as len) l left join j on j.len = l.len group by 1) select cast(len as int) as len, truths, nz, tp, nz - tp as fp, truths - tp as fn, case when nz > 0 then tp / nz end as precision, case when truths > 0 then tp / truths end as recall, case when nz + truths > 0 then 2 * tp / (nz + truths) end as f1 from c")
def recovery_by_order(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return metrics.recovery_by_order(selected(b), truths(spark), b.max_len)


@query(f"""{_FULL}, {_SELP}, {_TRU}, tl as (select t, string_split(t, ',') as l from tru), tx as (select tid, list(item) as items from bi group by 1),
tc as (select t, tid, items from tl join tx on list_has_all(items, l)), cv as (select t, x, count(*) as c from (select t, unnest(items) as x from tc) group by 1, 2), ct as (select t, count(*) as c from tc group by 1),
cl as (select t, string_agg(x, ',' order by x) as target from cv join ct using (t) where cv.c = ct.c group by 1), ctar as (select distinct coalesce(target, tru.t) as target from tru left join cl using (t)),
hit as (select 'exact' as kind, t as target, (select min(rk) from sel where p = t) as rk from tru union all select 'closure', target, (select min(rk) from sel where p = target) from ctar union all select 'superset', t, (select min(rk) from sel where list_has_all(string_split(p, ','), l)) from tl),
n as (select kind, count(rk) as hits, count(*) as truths, count(case when rk <= 10 then 1 end) as a, count(case when rk <= 20 then 1 end) as b, count(case when rk <= 50 then 1 end) as c, (select count(*) from sel) as nz from hit group by 1),
pr as (select *, hits / nz as precision, hits / truths as recall from n)
select kind, hits, round(precision, 8) as precision, round(recall, 8) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 8) as f1, a / truths as top10, b / truths as top20, c / truths as top50 from pr""")
def recovery_extended(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    m = metrics.recovery_extended(selected(b), truths(spark), b.items)
    return m.select("kind", "hits", *_r(8, precision="precision", recall="recall", f1="f1"), "top10", "top20", "top50")


_AUDIT = "i as (select p, len, unnest(string_split(p, ',')) as x from sup), ti as (select t, len(string_split(t, ',')) as tl, unnest(string_split(t, ',')) as x from tru), o as (select p, len, t, tl, count(*) as n from i join ti using (x) group by all), r as (select p, min(case when n = len and n = tl then 0 when n = len then 1 when n = tl then 2 else 3 end) as r from o group by 1), rel as (select unnest(['exact', 'strict_subset', 'strict_superset', 'partial_overlap', 'disjoint']) as relation, unnest([0, 1, 2, 3, 4]) as k)"


@query(f"{_ALL}, {_TRU}, {_AUDIT}, c as (select coalesce(r, 4) as k, count(*) as n from sup left join r using (p) group by 1), t as (select count(*) as t from sup) select relation, coalesce(n, 0) as n, round(coalesce(n, 0) / t, 8) as fraction, round(1 - (select coalesce(max(n), 0) from c where k = 4) / t, 8) as non_disjoint from rel left join c using (k), t")
def structural_overall(spark, sf_dir):
    audited = written(metrics.structural_audit(Baskets(spark, sf_dir).frequent(), truths(spark)), "audited")
    return metrics.structural_overall(audited).withColumns({c: F.round(c, 8) for c in ("fraction", "non_disjoint")})


_CONF = "sel as (select l_linenumber as config, l_orderkey % 5 as seed, l_partkey as x, l_returnflag as arm, avg(l_discount) as w from lineitem where l_returnflag in ('R', 'A') group by 1, 2, 3, 4), ag as (select coalesce(a.config, b.config) as config, coalesce(a.seed, b.seed) as seed, count(a.x) as n_one, count(b.x) as n_two, count(case when a.x = b.x then 1 end) as common, coalesce(max(abs(a.w - b.w)), 0) as difference from (select * from sel where arm = 'R') a full join (select * from sel where arm = 'A') b on a.config = b.config and a.seed = b.seed and a.x = b.x group by 1, 2)"


def agreements(spark, sf_dir) -> DataFrame:
    """Two arms' selections of parts, with their mean discount as coefficient, by line number and seed."""
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    sel = li.groupBy(F.col("l_linenumber").alias("config"), F.pmod("l_orderkey", F.lit(5)).alias("seed"), F.array("l_partkey").alias("itemset"), "l_returnflag").agg(F.avg("l_discount").alias("w"))
    return metrics.agreement(*[sel.filter(F.col("l_returnflag") == f) for f in ("R", "A")], ["config", "seed"])


@query(f"with {_CONF} select config, seed, n_one = common and n_two = common as same_set, round(common / (n_one + n_two - common), 8) as jaccard, n_one, n_two, n_one - common as only_one, n_two - common as only_two, round(difference, 8) as difference from ag")
def jaccard_agreement(spark, sf_dir):
    return agreements(spark, sf_dir).withColumns({c: F.round(c, 8) for c in ("jaccard", "difference")})


@query(f"with {_CONF} select config, count(*) as seeds, count(case when n_one = common and n_two = common then 1 end) as same_sets, round(avg(common / (n_one + n_two - common)), 8) as jaccard_mean, round(min(common / (n_one + n_two - common)), 8) as jaccard_min, round(max(difference), 8) as difference from ag group by 1")
def agreement_summary(spark, sf_dir):
    a = agreements(spark, sf_dir)
    return a.groupBy("config").agg(F.count(F.lit(1)).alias("seeds"), F.count_if("same_set").alias("same_sets"), F.round(F.avg("jaccard"), 8).alias("jaccard_mean"), F.round(F.min("jaccard"), 8).alias("jaccard_min"), F.round(F.max("difference"), 8).alias("difference"))


@query(f"with {_PARTS}, j as (select coalesce(act.seed, tru.seed) as seed, act.x as a, tru.x as t from act full join tru on act.seed = tru.seed and act.x = tru.x), c as (select seed, count(case when a is not null and t is not null then 1 end) as tp, count(case when t is null then 1 end) as fp, count(case when a is null then 1 end) as fn from j group by 1) select seed, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def recovery(spark, sf_dir):
    """Exact recovery of whole item sets, by seed."""
    m = metrics.recovery(*selected_parts(spark, sf_dir), ["seed"])
    return m.select("seed", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("with n as (select o_custkey, count(case when o_orderstatus = 'F' then 1 end) as tp, count(case when o_orderstatus = 'O' then 1 end) as fp, count(case when o_orderstatus = 'P' then 1 end) as fn from orders group by 1) select o_custkey, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 8) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 8) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 8) as f1 from n")
def prf(spark, sf_dir):
    """Guarded ratios: 0 where nothing was selected or nothing was there."""
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(c) for c, s in (("tp", "F"), ("fp", "O"), ("fn", "P"))])
    return metrics.prf(n).select("o_custkey", *_r(8, precision="precision", recall="recall", f1="f1"))


# ---- ranks, choices, summaries

@query(f"{_FULL} select p, round(abs(a), 4) as weight, row_number() over (order by round(abs(a), 6) desc, p) as rank from sc")
def rank_by_abs_coef(spark, sf_dir):
    """Every term's place by the size of its coefficient, ties by itemset. A dictionary's size doesn't follow the rows'."""
    scored = Baskets(spark, sf_dir).scored()
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("alpha"), 6)), "itemset"))
    return scored.select(key().alias("p"), r4(F.abs("alpha")).alias("weight"), rank.alias("rank"))


_KA = "g2 as (select o_orderpriority as endpoint, o_custkey % 4 as size, o_custkey % 3 as alpha, o_orderkey % 3 as fold, avg(o_totalprice) as rmse from orders group by 1, 2, 3, 4), m as (select endpoint, size, alpha, avg(rmse) as m, stddev_samp(rmse) / sqrt(3) as se from g2 group by 1, 2, 3), bk as (select endpoint, size, arg_min(alpha, m) as alpha, min(m) as m, arg_min(se, m) as se from m group by 1, 2), lim as (select endpoint, min(m) + arg_min(se, m) as lim from bk group by 1)"


@query(f"with {_KA} select endpoint, min(size) as size, arg_min(alpha, size) as alpha from bk join lim using (endpoint) where round(m, 9) <= round(lim, 9) group by 1")
def compact_select(spark, sf_dir):
    """The smallest size within one standard error of the best over a grid of sizes and penalties; each size has its best penalty."""
    o = read(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_orderpriority").alias("endpoint"), F.pmod("o_custkey", F.lit(4)).alias("size"), F.pmod("o_custkey", F.lit(3)).alias("alpha"), F.pmod("o_orderkey", F.lit(3)).alias("fold")).agg(F.avg("o_totalprice").alias("rmse"))
    return selection.compact_select(g, ["endpoint"])


@query(f"with {_RUNS}, m as (select endpoint, method, avg(rmse) as m from runs group by 1, 2) select endpoint, arg_min(method, struct_pack(m := round(m, 9), k := method)) as method, round(min(m), 7) as mean from m group by 1")
def best_candidate(spark, sf_dir):
    """The candidate of least mean score, the first of equal ones."""
    m = runs(spark, sf_dir).groupBy("endpoint", "method").agg(F.avg("rmse").alias("m"))
    return m.groupBy("endpoint").agg(F.min_by("method", F.struct(F.round("m", 9), F.col("method"))).alias("method"), F.round(F.min("m"), 7).alias("mean"))


@query(f"{_FULL} select p, round(a / 1e5, 8) as coefficient, len(string_split(p, ',')) as length from sc order by round(abs(a), 6) desc, p")
def sort_terms(spark, sf_dir):
    """Terms as they are exported: the largest coefficients first, ties by itemset."""
    return Baskets(spark, sf_dir).scored().orderBy(F.desc(F.round(F.abs("alpha"), 6)), "itemset").select(key().alias("p"), F.round(F.col("alpha") / 1e5, 8).alias("coefficient"), F.size("itemset").cast("long").alias("length"))


@query(f"with {_GRID}, m as (select endpoint, point, avg(rmse) as v from g group by 1, 2), d as (select endpoint, point, v - lag(v) over (partition by endpoint order by point) as change from m), b as (select endpoint, fold, rmse as base from g where point = 0), q as (select endpoint, point, avg(base - rmse) as paired, count(case when base - rmse >= 500 then 1 end) as worse from g join b using (endpoint, fold) group by 1, 2) select endpoint, point, round(change, 7) as change, round(paired, 7) as paired_drop, worse, coalesce(change < -1000, false) or (paired >= 1000 and worse >= 2) as stop from d join q using (endpoint, point)")
def stop_rule(spark, sf_dir):
    """A level is bad if it falls from the one before, or from the first one in most seeds, paired by seed."""
    g = grid_scores(spark, sf_dir)
    m = g.groupBy("endpoint", "point").agg(F.avg("rmse").alias("v"))
    fell = selection.stop_rule(m, ["endpoint"], "point", "v", 1000.0)
    pairs = selection.paired_drop(g, ["endpoint"], "point", "fold", "rmse", 0, 500.0)
    both = fell.join(pairs, ["endpoint", "point"])
    stop = F.col("stop") | ((F.col("paired_drop") >= 1000) & (F.col("worse") >= 2))
    return both.select("endpoint", "point", F.round("change", 7).alias("change"), F.round("paired_drop", 7).alias("paired_drop"), "worse", stop.alias("stop"))


_R3 = "r3 as (select o_orderpriority as endpoint, year(o_orderdate) as level, c_mktsegment as method, o_orderkey % 5 as seed, avg(o_totalprice) as rmse, count(*) as nz from orders join customer on c_custkey = o_custkey group by 1, 2, 3, 4)"


def runs3(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.groupBy(F.col("o_orderpriority").alias("endpoint"), F.year("o_orderdate").cast("long").alias("level"), F.col("c_mktsegment").alias("method"), F.pmod("o_orderkey", F.lit(5)).alias("seed")).agg(F.avg("o_totalprice").alias("rmse"), F.count(F.lit(1)).alias("nz"))


@query(f"with {_R3} select endpoint, level, method, count(*) as completed, count(*) = 5 as whole, round(avg(rmse), 6) as rmse_mean, round(stddev_samp(rmse), 5) as rmse_sd, round(avg(nz), 6) as nz_mean, round(stddev_samp(nz), 6) as nz_sd from r3 group by 1, 2, 3")
def group_stats(spark, sf_dir):
    """Means and sample SDs of completed seeds by three keys; one seed has no SD, and a condition is whole with five."""
    g = runs3(spark, sf_dir).groupBy("endpoint", "level", "method")
    n = F.count(F.lit(1))
    return g.agg(n.alias("completed"), (n == 5).alias("whole"), F.round(F.avg("rmse"), 6).alias("rmse_mean"), F.round(F.stddev_samp("rmse"), 5).alias("rmse_sd"), F.round(F.avg("nz"), 6).alias("nz_mean"), F.round(F.stddev_samp("nz"), 6).alias("nz_sd"))


@query(f"with {_RUNS}, b as (select endpoint, seed, rmse as base from runs where method = 'BUILDING' and rmse > 150000) select endpoint, method, count(*) as attempted, count(case when rmse > 150000 then 1 end) as verified, count(case when rmse > 150000 then 1 end) = 5 as complete, round(avg(case when rmse > 150000 then rmse end), 6) as mean, round(stddev_samp(case when rmse > 150000 then rmse end), 5) as sd, count(case when rmse > 150000 and method <> 'BUILDING' then base end) as pairs, round(avg(case when rmse > 150000 and method <> 'BUILDING' then 1 - rmse / base end), 8) as reduction from runs left join b using (endpoint, seed) group by 1, 2")
def summarize_counts(spark, sf_dir):
    """Attempts, verified runs, their mean and SD, and their reduction against the base arm where that seed has both."""
    r = runs(spark, sf_dir)
    ok = F.when(F.col("rmse") > 150000, F.col("rmse"))
    base = r.filter("method = 'BUILDING' and rmse > 150000").select("endpoint", "seed", F.col("rmse").alias("base"))
    paired = F.when((F.col("rmse") > 150000) & (F.col("method") != "BUILDING"), F.col("base"))
    g = r.join(base, ["endpoint", "seed"], "left").groupBy("endpoint", "method")
    return g.agg(F.count(F.lit(1)).alias("attempted"), F.count(ok).alias("verified"), (F.count(ok) == 5).alias("complete"), F.round(F.avg(ok), 6).alias("mean"), F.round(F.stddev_samp(ok), 5).alias("sd"), F.count(paired).alias("pairs"), F.round(F.avg(1 - F.col("rmse") / paired), 8).alias("reduction"))


@query("select c_nationkey, c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean, round(coalesce(stddev_samp(c_acctbal), 0), 6) as sd_or_zero, round(stddev_samp(c_acctbal), 6) as sd from customer group by 1, 2")
def mean_std(spark, sf_dir):
    """Mean and sample SD; of a single value the SD is 0 by one convention and undefined by the other."""
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment")
    return metrics.mean_std(g, "c_acctbal").withColumns({c: F.round(c, 6) for c in ("mean", "sd_or_zero", "sd")})


_JOBS = "jobs as (select dataset, method from (select distinct o_orderpriority || '/' || (o_custkey % 11) as dataset from orders), (select unnest(['A', 'N', 'R', 'X']) as method)), res as (select o_orderpriority || '/' || (o_custkey % 11) as dataset, l_returnflag as method, count(*) as n, avg(l_discount) as v from lineitem join orders on o_orderkey = l_orderkey group by 1, 2)"


@query(f"with {_JOBS} select count(*) as expected, count(case when v >= 0.045 and v <= 0.08 then 1 end) as completed, count(case when v < 0.045 then 1 end) as failed, count(case when v is null then 1 end) as pending, count(case when v > 0.08 then 1 end) as invalid, count(v) = count(*) as accounted from jobs left join res using (dataset, method)")
def coverage_status(spark, sf_dir):
    """A plan of datasets by methods against the results that are there."""
    data = F.concat_ws("/", "o_orderpriority", F.pmod("o_custkey", F.lit(11)).cast("string")).alias("dataset")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), data)
    plan = o.select("dataset").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in "ANRX"])))
    res = read(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy("dataset", F.col("l_returnflag").alias("method")).agg(F.avg("l_discount").alias("v"))
    v = F.col("v")
    return metrics.coverage(plan.join(res, ["dataset", "method"], "left"), v.between(0.045, 0.08), v < 0.045, v > 0.08, v.isNull())


@query(f"with {_R3}, cells as (select 'by_year' as tab, cast(level as varchar) as condition, method, seed, unnest(['rmse', 'nz']) as metric, unnest([rmse, nz]) as v from (select level, method, seed, avg(rmse) as rmse, sum(nz)::double as nz from r3 group by 1, 2, 3) union all select 'by_priority', endpoint, method, seed, unnest(['rmse', 'nz']), unnest([rmse, nz]) from (select endpoint, method, seed, avg(rmse) as rmse, sum(nz)::double as nz from r3 group by 1, 2, 3)) select tab, condition, method, metric, count(v) as n, round(case when count(v) = 5 then avg(v) end, 6) as mean, round(case when count(v) = 5 then stddev_samp(v) end, 5) as sample_sd from cells group by 1, 2, 3, 4")
def tables_rebuild(spark, sf_dir):
    """Every cell of two summary tables: condition, method and metric with mean and SD over the five seeds."""
    r = runs3(spark, sf_dir)
    cells = []
    for tab, by in (("by_year", "level"), ("by_priority", "endpoint")):
        m = r.groupBy(F.col(by).cast("string").alias("condition"), "method", "seed").agg(F.avg("rmse").alias("rmse"), F.sum("nz").cast("double").alias("nz"))
        cells.append(m.select(F.lit(tab).alias("tab"), "condition", "method", "seed", F.explode(F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("nz"), F.col("nz"))).alias("metric", "v")))
    out = metrics.five_seed(itemsets.reduce_union(cells), ["tab", "condition", "method", "metric"], "v")
    return out.withColumns({"mean": F.round("mean", 6), "sample_sd": F.round("sample_sd", 5)})


@query(f"with {_GRID}, k as (select endpoint, fold from g group by 1, 2 having count(case when rmse > 225000 then 1 end) = 7 and count(*) = 7 and count(distinct point) = 7) select endpoint, fold, point, round(rmse, 7) as rmse from g semi join k using (endpoint, fold)")
def verified_path_rows(spark, sf_dir):
    """The points of paths that are whole, each point once and verified; other paths are left out altogether."""
    g = grid_scores(spark, sf_dir)
    return selection.whole_paths(g, ["endpoint", "fold"], "point", F.col("rmse") > 225000, 7).select("endpoint", "fold", "point", F.round("rmse", 7).alias("rmse"))


@query("with o as (select o_orderkey, o_totalprice, o_totalprice * case when o_orderkey % 97 = 0 then 1.001 else 1 end as again from orders) select o_orderkey, round(abs(o_totalprice - again), 6) as off from o where abs(o_totalprice - again) > 1e-8 + 1e-10 * abs(again)")
def verify_result(spark, sf_dir):
    """Rows whose recomputed value isn't close to the saved one; no rows means that the evidence holds."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 97 == 0, 1.001).otherwise(1.0)).alias("again"))
    bad = metrics.mismatches(o, "o_totalprice", "again")
    return bad.select("o_orderkey", F.round(F.abs(F.col("o_totalprice") - F.col("again")), 6).alias("off"))


# ---- the path

@query()
def fit_path(spark, sf_dir):
    """Five points of the regularisation path over the closed dictionary, each certified over all of it."""
    b = Baskets(spark, sf_dir)
    d = path.Dictionary(b.items, b.y, b.least, b.max_len)
    return path.as_frame(spark, path.fit_path(d, [1.0, 0.8, 0.6, 0.45, 0.35]))
