"""The registered queries of the pattern engine on the driver's tables, each with the SQL that must give the same rows.

Transactions are orders (SURVEY 7.1); where an operator compares runs, folds or methods, these are columns of orders and
lines. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunct.functions import scalar
from conjunct.operators import itemsets, metrics, scoring, selection
from conjunct.operators.itemsets import key
from conjunct.plans import path, splits
from conjunct.plans.store import written
from conjunct.sources.tables import basket_items, basket_response, latex_rows, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---- common parts: SQL

_BI = """bi as (
  select distinct l_orderkey as tid, 'B:' || p_brand as item from lineitem join part on p_partkey = l_partkey
  union
  select distinct l_orderkey, unnest(['N:' || n_name, 'R:' || r_name, 'P:' || o_orderpriority])
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""
_Y = "y as (select l_orderkey as tid, sum(l_quantity) as y from lineitem group by 1)"
_MS = "ms as (select greatest(3, ceil(round(0.015 * count(*), 6))) as least_s, count(*) as n, avg(y) as m, sum(y) as total from y)"
_B1 = "f1 as (select item, count(*) as s from bi group by 1 having count(*) >= (select least_s from ms)), b1 as (select bi.* from bi semi join f1 using (item))"
_PT = """f2 as (select a.item as i, b.item as j from b1 a join b1 b on a.tid = b.tid and a.item < b.item group by 1, 2 having count(*) >= (select least_s from ms)),
t2 as (select a.item as i, b.item as j, a.tid from b1 a join b1 b on a.tid = b.tid and a.item < b.item semi join f2 on f2.i = a.item and f2.j = b.item),
t3 as (select t2.i, t2.j, b1.item as k, t2.tid from t2 join b1 on b1.tid = t2.tid and b1.item > t2.j),
f3 as (select i, j, k from t3 group by 1, 2, 3 having count(*) >= (select least_s from ms)),
pt as (select item as p, 1 as len, tid from b1 union all select i || ',' || j, 2, tid from t2 union all select i || ',' || j || ',' || k, 3, tid from t3 semi join f3 using (i, j, k)),
sup as (select p, len, count(*) as s from pt group by 1, 2)"""
_CL = """cov as (select pt.p, bi.item, count(*) as c from pt join bi using (tid) group by 1, 2),
clo as (select sup.p, sup.len, sup.s, count(*) as size, string_agg(item, ',' order by item) as closure from cov join sup using (p) where c = s group by 1, 2, 3),
cp as (select p, s from clo where size = len)"""
_SC = "sc as (select pt.p, count(*) as s, sum(y - m) as a, sum(greatest(y - m, 0)) as ap, sum(greatest(m - y, 0)) as an from pt semi join cp using (p) join y using (tid), ms group by 1)"
_ALL = f"with {_BI}, {_Y}, {_MS}, {_B1}, {_PT}"
_FULL = f"{_ALL}, {_CL}, {_SC}, lm as (select max(abs(a)) as lam from sc)"


# ---- common parts: Spark

class Baskets:
    """Orders as transactions; their dictionary is enumerated once and kept in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, max_len: int = 3):
        self.items, self.y = basket_items(spark, sf_dir), basket_response(spark, sf_dir)
        r = self.y.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.sum("y").alias("t")).first()
        self.n, self.mean, self.total, self.max_len = r["n"], r["m"] or 0.0, r["t"] or 0.0, max_len
        self.least, self._rows = itemsets.min_support(self.n), None

    def rows(self) -> DataFrame:
        """(tid, items, y) of orders with a frequent item."""
        if self._rows is None:
            found, self.names = itemsets.encoded(self.items, self.least)
            self._rows = written(found.join(self.y, "tid"), "baskets")
        return self._rows

    def levels(self, vectors: dict[str, Column] | None = None, aggs: list[Column] = (), more: int = 1) -> list[DataFrame]:
        """The levels up to max_len items and `more`, with the sums of vectors over each set's rows, of both signs."""
        vectors = vectors or {}
        rows = self.rows().select("tid", "items", *[c.alias(v) for v, c in vectors.items()])
        return itemsets.levels(rows, self.least, self.max_len + more, [*scoring.parts(list(vectors)), *aggs], written)

    def frequent(self) -> DataFrame:
        """(itemset, support)"""
        return self._named(itemsets.reduce_union(self.levels(more=0))).withColumnRenamed("s", "support")

    def closures(self) -> DataFrame:
        found = itemsets.closures_of(self.levels(), self.max_len)
        return itemsets.named(self._named(found), self.names, "closure")

    def scored(self, vectors: dict[str, Column] | None = None, aggs: list[Column] = ()) -> DataFrame:
        """(itemset, s, sums) of the closed sets; the vector alpha is y less its mean."""
        return self._named(itemsets.closed_of(self.levels(vectors or {"alpha": F.col("y") - self.mean}, aggs), self.max_len))

    def _named(self, found: DataFrame) -> DataFrame:
        return itemsets.named(found, self.names)


def r4(c: Column | str) -> Column:
    return F.round(c, 4)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, y, mu, train_mean): quantities against a price-based guess, by return flag; orders with key mod 3 <> 0 train."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_orderkey", F.col("l_quantity").alias("y"), (1 + F.col("l_extendedprice") / 2000).alias("mu"))
    train = li.filter("l_orderkey % 3 != 0").groupBy("grp").agg(F.avg("y").alias("train_mean"))
    return li.filter("l_orderkey % 3 = 0").join(train, "grp").select("grp", "y", "mu", "train_mean")


_PRED = """tr as (select l_returnflag as grp, avg(l_quantity) as train_mean from lineitem where l_orderkey % 3 <> 0 group by 1),
pr as (select l_returnflag as grp, l_quantity as y, 1 + l_extendedprice / 2000 as mu, train_mean from lineitem join tr on grp = l_returnflag where l_orderkey % 3 = 0)"""
_DEV = "greatest(2 * (case when y = 0 then 0 else y * ln(y / greatest({m}, 1e-6)) end - y + greatest({m}, 1e-6)), 0)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(endpoint, method, seed, rmse): an order's priority, its customer's segment and its key mod 5 with the mean price."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.groupBy(F.col("o_orderpriority").alias("endpoint"), F.col("c_mktsegment").alias("method"), F.pmod("o_orderkey", F.lit(5)).alias("seed")).agg(F.avg("o_totalprice").alias("rmse"))


#: The registered methods of a plan: market segments.
METHODS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_RUNS = "runs as (select o_orderpriority as endpoint, c_mktsegment as method, o_orderkey % 5 as seed, avg(o_totalprice) as rmse from orders join customer on c_custkey = o_custkey group by 1, 2, 3)"


def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(endpoint, fold, point, rmse): mean price by priority, key mod 3 and customer mod 7."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("endpoint"), F.pmod("o_orderkey", F.lit(3)).alias("fold"), F.pmod("o_custkey", F.lit(7)).alias("point")).agg(F.avg("o_totalprice").alias("rmse"))


_GRID = "g as (select o_orderpriority as endpoint, o_orderkey % 3 as fold, o_custkey % 7 as point, avg(o_totalprice) as rmse from orders group by 1, 2, 3)"


def truths(b: Baskets) -> DataFrame:
    """Planted stand-ins for known patterns: nation and region of four nations."""
    rows = [(["N:NATION_1", "R:AMERICA"],)]
    return b.items.sparkSession.createDataFrame(rows, "itemset array<string>")


# ---- 2.A sources and 2.B encodings

@query(f"with {_BI}, {_Y} select tid, string_agg(item, ',' order by item) as items, any_value(y) as y from bi join y using (tid) where tid % 3 <> 0 group by tid")
def scan_arrays(spark, sf_dir):
    rows = itemsets.baskets(basket_items(spark, sf_dir).filter("tid % 3 != 0")).join(basket_response(spark, sf_dir), "tid")
    return rows.select("tid", key("items").alias("items"), "y")


@query(f"with {_BI}, {_Y}, {_MS} select y.tid, y.y, tid % 3 as fold, case when tid % 3 = 0 then 'validation' else 'fit' end as role, cast(ms.least_s as bigint) as min_support from y, ms")
def scan_dataset(spark, sf_dir):
    y = basket_response(spark, sf_dir)
    fold = splits.hash_fold("tid")
    return y.select("tid", "y", fold.alias("fold"), F.when(fold == 0, "validation").otherwise("fit").alias("role"), F.lit(itemsets.min_support(y.count())).cast("long").alias("min_support"))


@query(f"with {_BI} select tid, count(*) as n_items, min(item) as first_item from bi group by 1")
def scan_dataset_counts(spark, sf_dir):
    return basket_items(spark, sf_dir).groupBy("tid").agg(F.count(F.lit(1)).alias("n_items"), F.min("item").alias("first_item"))


@query("select o_orderkey from orders semi join (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')) c on c_custkey = o_custkey")
def lookup_scope(spark, sf_dir):
    chosen = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@query("with t as (select o_orderpriority, avg(case when o_orderstatus = 'F' then o_totalprice end) / 1000 as a, avg(case when o_orderstatus = 'O' then o_totalprice end) / 1000 as b from orders group by 1) select o_orderpriority, o_orderpriority || ' & ' || case when a >= b then format('\\textbf{{{:.3f}}}', a) else format('{:.3f}', a) end || ' & ' || case when b >= a then format('\\textbf{{{:.3f}}}', b) else format('{:.3f}', b) end || ' \\\\' as line from t")
def sink_latex(spark, sf_dir):
    by = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 1000).alias(c) for c, s in (("a", "F"), ("b", "O"))])
    return latex_rows(by, "o_orderpriority", ["a", "b"])


_TOK = "tok as (select o_orderkey as row, unnest([1, 2]) as pos, unnest([case o_orderstatus when 'O' then ' - ' when 'P' then 'P#' else o_orderstatus end, case when o_orderpriority like '1%' then '.' when o_orderpriority like '2%' then '' when o_orderpriority like '3%' then 'KR' when o_orderpriority like '4%' then 'K*' else ' k ' end]) as token from orders)"


def tokens(spark, sf_dir):
    """(row, pos, token): residue-like tokens made of an order's status and priority."""
    p = F.col("o_orderpriority")
    one = F.when(F.col("o_orderstatus") == "O", " - ").when(F.col("o_orderstatus") == "P", "P#").otherwise(F.col("o_orderstatus"))
    two = F.when(p.like("1%"), ".").when(p.like("2%"), "").when(p.like("3%"), "KR").when(p.like("4%"), "K*").otherwise(" k ")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.posexplode(F.array(one, two)).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


@query(f"with {_TOK} select row, pos from tok where trim(token) not in ('', '-', '.')")
def encode_presence(spark, sf_dir):
    return tokens(spark, sf_dir).filter(scalar.present(F.col("token"))).select("row", "pos")


@query(f"with {_TOK} select case when trim(token) = '' then 'missing' when trim(token) in ('-', '.') then 'reference' when regexp_matches(trim(token), '[#~]') then 'indel' when contains(trim(token), '*') then 'stop' when regexp_full_match(trim(token), '[A-Z]') then 'single' when regexp_full_match(trim(token), '[A-Z]{{2,}}') then 'mixture' else 'other' end as issue, count(*) as n from tok group by 1")
def raw_token_issue(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy(scalar.token_issue(F.col("token")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


_RAW = "raw as (select c_custkey, case when c_custkey % 7 = 0 then 'NA' when c_custkey % 11 = 0 then 'nan' else cast(c_acctbal as varchar) end as v from customer)"


def raw_responses(spark, sf_dir):
    v = F.when(F.col("c_custkey") % 7 == 0, "NA").when(F.col("c_custkey") % 11 == 0, "nan").otherwise(F.col("c_acctbal").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))


@query(f"with {_RAW} select c_custkey, try_cast(v as double) as y from raw where try_cast(v as double) >= 0 and not isnan(try_cast(v as double))")
def filter_finite_response(spark, sf_dir):
    y = F.expr("try_cast(v as double)")
    return raw_responses(spark, sf_dir).withColumn("y", y).filter("y >= 0 and not isnan(y)").select("c_custkey", "y")


@query(f"with {_RAW} select count(*) as n, sum(case when try_cast(v as double) is null then 1 else 0 end) as unparsed, sum(case when isnan(try_cast(v as double)) then 1 else 0 end) as not_finite, sum(case when try_cast(v as double) < 0 then 1 else 0 end) as negative from raw")
def validate_response(spark, sf_dir):
    rows = raw_responses(spark, sf_dir).withColumn("y", F.expr("try_cast(v as double)"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNull()).alias("unparsed"), F.count_if(F.isnan("y")).alias("not_finite"), F.count_if(F.col("y") < 0).alias("negative"))


@query(f"with {_Y} select fold, count(*) as rows, count(distinct tid) as tids from (select tid, tid % 3 as fold from y) group by 1")
def validate_folds(spark, sf_dir):
    y = basket_response(spark, sf_dir).withColumn("fold", splits.hash_fold("tid"))
    return y.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("tid").alias("tids"))


@query("select o_custkey as grp, count(distinct o_orderkey % 3) as roles from orders group by 1 having count(distinct o_orderkey % 3) > 1")
def validate_groups(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.countDistinct(F.pmod("o_orderkey", F.lit(3))).alias("roles")).filter("roles > 1")


@query("select l_orderkey as tid, string_agg(distinct cast(l_suppkey as varchar), ',' order by cast(l_suppkey as varchar)) as items from lineitem group by 1")
def normalize_tx(spark, sf_dir):
    raw = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tid")).agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("items"))
    return itemsets.normalize(raw).select("tid", key("items").alias("items"))


@query("select o_custkey, " + ", ".join(f"max(case when o_orderpriority like '{i}%' then 1 else 0 end) as p{i}" for i in range(1, 6)) + " from orders group by 1")
def onehot_matrix(spark, sf_dir):
    wide = read(spark, sf_dir, "orders").withColumn("p", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))).groupBy("o_custkey").pivot("p", [f"p{i}" for i in range(1, 6)]).agg(F.lit(1))
    return wide.na.fill(0)


@query(f"with {_Y} select y.* from y semi join (select o_orderkey as tid from orders where o_orderstatus = 'F') o using (tid)")
def subset_rows(spark, sf_dir):
    return basket_response(spark, sf_dir).join(read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tid")), "tid", "left_semi")


@query("select c_custkey, round(sign(c_acctbal) * greatest(abs(c_acctbal) - 500, 0), 6) + 0.0 as soft, round(ln(greatest(c_acctbal, 1e-12)), 6) as logged from customer")
def soft_threshold(spark, sf_dir):
    c = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(scalar.soft_threshold(c, 500.0), 6).alias("soft"), F.round(scalar.safe_log(c), 6).alias("logged"))


@query("select distinct o_orderpriority, case when o_orderpriority like '3%' then 0 when o_orderpriority like '1%' then 1 else 2 end as priority from orders")
def endpoint_priority(spark, sf_dir):
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select(p, F.when(p.like("3%"), 0).when(p.like("1%"), 1).otherwise(2).alias("priority")).distinct()


@query("select n_nationkey, unnest(generate_series(n_nationkey, n_nationkey + 2) || [n_nationkey + 40]) as cpu from nation")
def parse_cpus(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.concat(k.cast("string"), F.lit("-"), (k + 2).cast("string"), F.lit(","), (k + 40).cast("string"))
    return read(spark, sf_dir, "nation").select(k, F.explode(scalar.expand_ranges(text)).alias("cpu"))


# ---- 2.C matching

@query(f"{_ALL} select p, tid from pt")
def contain_join(spark, sf_dir):
    """Every frequent itemset with every transaction that has it."""
    b = Baskets(spark, sf_dir)
    return itemsets.contain_join(b.frequent(), b.items).select(key().alias("p"), "tid")


@query(f"with {_BI}, pats as (select unnest([['N:NATION_1', 'R:AMERICA'], ['P:1-URGENT', 'R:ASIA'], ['B:Brand#11', 'P:2-HIGH'], ['R:EUROPE']]) as p) select array_to_string(p, ',') as p, tid from pats, (select tid, list(item) as items from bi group by 1) where list_has_all(items, p)")
def contain_join_legacy(spark, sf_dir):
    """The same by nested tests, for a few patterns at hand."""
    few = [["N:NATION_1", "R:AMERICA"], ["P:1-URGENT", "R:ASIA"], ["B:Brand#11", "P:2-HIGH"], ["R:EUROPE"]]
    return itemsets.contain_join_nested(few, basket_items(spark, sf_dir)).select(key().alias("p"), "tid")


@query(f"with {_BI} select n.tid from bi n join bi r using (tid) where n.item = 'N:NATION_1' and r.item = 'R:AMERICA'")
def oracle_matrix(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return itemsets.contain_join(truths(b), b.items).select("tid")


@query(f"{_ALL} select p, cast(s as bigint) as support, round(s / n, 6) as share from sup, ms where len = 2")
def support(spark, sf_dir):
    b = Baskets(spark, sf_dir, 2)
    return b.frequent().filter(F.size("itemset") == 2).select(key().alias("p"), "support", F.round(F.col("support") / b.n, 6).alias("share"))


@query("with m as (select o_custkey, bit_or(1 << cast(substr(o_orderpriority, 1, 1) as int)) as bits from orders group by 1) select bits, count(*) as n, sum(case when bits & 6 = 6 then 1 else 0 end) as has_both from m group by 1")
def bitmask_contain(spark, sf_dir):
    bit = F.expr("shiftleft(1, cast(substring(o_orderpriority, 1, 1) as int))")
    masks = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bit_or(bit).alias("bits"))
    return masks.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bits").bitwiseAND(6) == 6).alias("has_both"))


@query("select count(*) as n from (select distinct l_orderkey from lineitem where l_returnflag = 'R') semi join (select l_orderkey from lineitem where l_returnflag = 'A') using (l_orderkey)")
def intersect_tid(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_orderkey").intersect(li.filter("l_returnflag = 'A'").select("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_BI} select a.item, count(*) as n from bi a join bi b using (tid) where b.item = 'R:AMERICA' and a.item like 'P:%' group by 1")
def pattern_mask(spark, sf_dir):
    bi = basket_items(spark, sf_dir)
    maps = bi.filter("item like 'P:%' or item = 'R:AMERICA'").groupBy("item", F.bitmap_bucket_number("tid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("tid")).alias("bits"))
    region = maps.filter("item = 'R:AMERICA'").select("bucket", F.col("bits").alias("other"))
    both = maps.filter("item like 'P:%'").join(region, "bucket").select("item", "bucket", F.explode(F.array("bits", "other")).alias("bits"))
    met = both.groupBy("item", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return met.groupBy("item").agg(F.sum(F.bitmap_count("bits")).alias("n")).filter("n > 0")


@query(f"with {_BI} select i.item from (select distinct item from bi where item like 'N:%') i where not exists (select 1 from bi a where a.item = i.item and not exists (select 1 from bi r where r.tid = a.tid and r.item = 'R:AMERICA'))")
def is_subset_tid(spark, sf_dir):
    bi = basket_items(spark, sf_dir)
    nations = bi.filter("item like 'N:%'")
    outside = nations.join(bi.filter("item = 'R:AMERICA'").select("tid"), "tid", "left_anti").select("item").distinct()
    return nations.select("item").distinct().join(outside, "item", "left_anti")


@query("with a as (select o_custkey, list_sort(list(distinct o_orderpriority)) as l from orders group by 1) select o_custkey from a where list_has_all(l, ['1-URGENT', '2-HIGH'])")
def is_subsequence(spark, sf_dir):
    sets = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l"))
    return sets.filter(F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), "l")) == 0).select("o_custkey")


@query("select count(distinct a.o_custkey) as groups, count(*) as left_rows from (select o_custkey from orders where o_orderkey % 3 = 0) a semi join (select o_custkey from orders where o_orderkey % 3 <> 0) b using (o_custkey)")
def overlap_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = o.filter("o_orderkey % 3 = 0").join(o.filter("o_orderkey % 3 != 0").select("o_custkey"), "o_custkey", "left_semi")
    return met.agg(F.countDistinct("o_custkey").alias("groups"), F.count(F.lit(1)).alias("left_rows"))


@query(f"with {_BI}, v as (select tid, string_agg(item, ',' order by item) as items from bi group by 1) select tid from v where tid % 3 = 0 and items in (select items from v where tid % 3 <> 0)")
def seen_vector(spark, sf_dir):
    v = itemsets.baskets(basket_items(spark, sf_dir))
    return v.filter("tid % 3 = 0").join(v.filter("tid % 3 != 0").select("items"), "items", "left_semi").select("tid")


@query("select o_orderkey, c_mktsegment, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def metadata_join(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").join(n, "n_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


@query("with s as (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) as ordinal from supplier), c as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as ordinal from customer) select s_suppkey, c_custkey, ordinal from s join c using (ordinal) where s_nationkey = c_nationkey")
def annotation_join(spark, sf_dir):
    ordinal = lambda df, k, n: selection.top_per_group(df.select(k, F.col(n).alias("nk")), ["nk"], [k], 1 << 30).withColumnRenamed("place", "ordinal")
    s = ordinal(read(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")
    c = ordinal(read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")
    return s.join(c, ["nk", "ordinal"]).select("s_suppkey", "c_custkey", "ordinal")


@query(f"with {_RUNS} select a.endpoint, a.seed, a.method, round(a.rmse - b.rmse, 7) as difference from runs a join runs b on a.endpoint = b.endpoint and a.seed = b.seed and b.method = 'BUILDING' where a.method <> 'BUILDING'")
def paired_join(spark, sf_dir):
    r = runs(spark, sf_dir)
    base = r.filter("method = 'BUILDING'").select("endpoint", "seed", F.col("rmse").alias("base"))
    return r.filter("method != 'BUILDING'").join(base, ["endpoint", "seed"]).select("endpoint", "seed", "method", F.round(F.col("rmse") - F.col("base"), 7).alias("difference"))


@query("with a as (select o_custkey, o_orderkey % 2 as arm, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as act, max(o_totalprice) as p from orders group by 1, 2) select x.o_custkey, x.act = y.act as same, round(abs(x.p - y.p), 4) as apart from a x join a y on x.o_custkey = y.o_custkey and x.arm = 0 and y.arm = 1")
def agreement_join(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy("o_custkey", F.pmod("o_orderkey", F.lit(2)).alias("arm")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("act"), F.max("o_totalprice").alias("p"))
    x, y = a.filter("arm = 0"), a.filter("arm = 1").select("o_custkey", F.col("act").alias("act2"), F.col("p").alias("p2"))
    return x.join(y, "o_custkey").select("o_custkey", (F.col("act") == F.col("act2")).alias("same"), r4(F.abs(F.col("p") - F.col("p2"))).alias("apart"))


@query("select l_orderkey, min(l_partkey) as l_partkey from lineitem group by 1 having count(*) = 1")
def exactly_one_lookup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


# ---- 2.D enumeration and search

@query(f"with {_BI} select item, count(*) as support, min(tid) as first_tid, max(tid) as last_tid from bi group by 1")
def item_index(spark, sf_dir):
    return itemsets.item_index(basket_items(spark, sf_dir))


@query(f"with {_BI}, {_Y}, {_MS}, {_B1} select item, s as support from f1")
def frequent_items(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return itemsets.frequent_items(b.items, b.least)


@query(f"{_ALL} select p, cast(len as int) as len, s as support from sup")
def enum_frequent(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return b.frequent().select(key().alias("p"), F.size("itemset").alias("len"), "support")


@query(f"{_ALL}, {_CL} select p, s as support from cp")
def enum_closed(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return b.scored().select(key().alias("p"), F.col("s").alias("support"))


@query(f"{_ALL}, {_CL} select p, s as support, closure from clo")
def closure(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return b.closures().select(key().alias("p"), "support", key("closure").alias("closure"))


@query(f"{_ALL}, {_CL} select (select count(*) from sup) as frequent, (select count(*) from cp) as closed, cast((select least_s from ms) as bigint) as min_support")
def count_dictionary(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    marked = b.closures().withColumn("is_closed", F.size("closure") == F.size("itemset"))
    return marked.agg(F.count(F.lit(1)).alias("frequent"), F.count_if("is_closed").alias("closed"), F.lit(b.least).cast("long").alias("min_support"))


@query(f"{_ALL} select a.i || ',' || a.j || ',' || b.j as p from f2 a join f2 b on a.i = b.i and a.j < b.j semi join f2 c on c.i = a.j and c.j = b.j")
def support_propagation(spark, sf_dir):
    b = Baskets(spark, sf_dir, 2)
    return itemsets.propagate(b.frequent().filter(F.size("itemset") == 2).select("itemset")).select(key().alias("p"))


@query(f"{_ALL} select f2.i || ',' || f2.j as p, count(case when b.tid % 3 = 0 then 1 end) as support from f2 left join bi a on a.item = f2.i left join bi b on b.item = f2.j and b.tid = a.tid group by 1")
def transform_patterns(spark, sf_dir):
    b = Baskets(spark, sf_dir, 2)
    twos = b.frequent().filter(F.size("itemset") == 2).select("itemset")
    return itemsets.transform_patterns(twos, b.items.filter("tid % 3 = 0")).select(key().alias("p"), "support")


@query(f"{_FULL} select round(lam, 4) as lambda_max, (select p from sc, lm where round(abs(a), 6) = round(lam, 6) order by p limit 1) as pattern from lm")
def lambda_max(spark, sf_dir):
    return scoring.lambda_max(Baskets(spark, sf_dir).scored()).select(r4("lambda_max").alias("lambda_max"), "pattern")


@query(f"{_FULL} select round(lam / n, 6) as alpha_max from lm, ms")
def lasso_alpha_max(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return b.scored().agg(F.round(F.max(F.abs("alpha")) / b.n, 6).alias("alpha_max"))


_U = "abs(a) + 3.0 * sqrt(greatest(s - s * s / cast(n as double), 0))"
_V = "greatest(ap, an) + 3.0 * sqrt(least(s, n / 2.0) - least(s, n / 2.0) * least(s, n / 2.0) / n)"


@query(f"{_FULL} select p, round({_U}, 4) as bound_u, round({_V}, 4) as bound_v, round(sqrt(s - s * s / cast(n as double)), 4) as norm from sc, ms")
def node_score(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    s = F.col("s")
    return b.scored().select(key().alias("p"), r4(scalar.ball_bound(F.col("alpha"), s, 3.0, b.n)).alias("bound_u"), r4(scalar.mass_bound(F.col("alpha_pos"), F.col("alpha_neg"), s, 3.0, b.n)).alias("bound_v"), r4(scalar.centered_norm(s, b.n)).alias("norm"))


@query(f"{_FULL} select p, round({_U}, 4) as bound_u from sc, ms, lm where {_U} >= 0.5 * lam and {_V} >= 0.5 * lam")
def dfs_with_spp(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    scored = written(b.scored(), "scored")
    lam = 0.5 * scored.agg(F.max(F.abs("alpha"))).first()[0]
    return scoring.screened(scored, lam, 3.0, b.n).select(key().alias("p"), r4("bound_u").alias("bound_u"))


@query(f"{_FULL} select round(max(abs(a)), 4) as max_corr, round(sum(power(greatest(abs(a) - 0.3 * lam, 0), 2)) / 0.1 / 1e6, 4) as penalty_m, count(case when abs(a) > 0.3 * lam then 1 end) as violators from sc, lm")
def dual_scan(spark, sf_dir):
    scored = written(Baskets(spark, sf_dir).scored(), "scored")
    lam = 0.3 * scored.agg(F.max(F.abs("alpha"))).first()[0]
    return scoring.dual_scan(scored, lam, 0.05).select(r4("max_corr").alias("max_corr"), r4(F.col("penalty") / 1e6).alias("penalty_m"), "violators")


@query(f"{_FULL} select p, round(abs(a), 4) as score from sc, lm where abs(a) > 0.2 * lam and not p like 'P:%' order by round(abs(a), 6) desc, p limit 10")
def price_scan(spark, sf_dir):
    scored = written(Baskets(spark, sf_dir).scored(), "scored")
    lam = 0.2 * scored.agg(F.max(F.abs("alpha"))).first()[0]
    have = scored.filter(F.get("itemset", F.lit(0)).like("P:%"))
    return scoring.price_scan(scored, lam, have, 10).select(key().alias("p"), r4("score").alias("score"))


@query(f"{_FULL} select p, round(abs(a), 4) as score, s as support from sc order by round(abs(a), 6) desc, p limit 20")
def topk_patterns(spark, sf_dir):
    scored = Baskets(spark, sf_dir).scored().withColumn("score", F.abs("alpha"))
    return scoring.top_k(scored, "score", 20).select(key().alias("p"), r4("score").alias("score"), F.col("s").alias("support"))


@query(f"{_ALL}, {_CL}, z as (select pt.p, count(*) as s, sum(y - m) as a1, sum(case when tid % 2 = 0 then y - m else 0 end) as a2 from pt semi join cp using (p) join y using (tid), ms group by 1) select p, round(a1, 4) as a1, round(a2, 4) as a2, s as support from z")
def fused_traversal(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    dev = F.col("y") - b.mean
    return b.scored({"a1": dev, "a2": F.when(F.col("tid") % 2 == 0, dev).otherwise(0.0)}).select(key().alias("p"), r4("a1").alias("a1"), r4("a2").alias("a2"), F.col("s").alias("support"))


_T2 = "greatest(s - s * s / cast(n as double), 0)"


@query(f"""{_FULL}, k as (select p, a, 0.8 * a as a2, sqrt({_T2}) as nrm, -0.2 * a as q, 100.0 as d2, 8.0 as r1, 7.0 as r2 from sc, ms),
t as (select *, (r1 * r1 - r2 * r2 + d2) / (2 * d2) as t, sqrt(greatest(nrm * nrm - q * q / d2, 0)) as side from k),
u as (select *, sqrt(greatest(r1 * r1 - t * t * d2, 0)) as rho from t),
w as (select p,
 case when r1 * r1 + d2 - 2 * r1 * (q / nrm) <= r2 * r2 then a + r1 * nrm when r2 * r2 + d2 + 2 * r2 * (q / nrm) <= r1 * r1 then a2 + r2 * nrm else (a + t * q) + rho * side end as x,
 case when r1 * r1 + d2 - 2 * r1 * (-q / nrm) <= r2 * r2 then -a + r1 * nrm when r2 * r2 + d2 + 2 * r2 * (-q / nrm) <= r1 * r1 then -a2 + r2 * nrm else -(a + t * q) + rho * side end as z from u where nrm > 0)
select p, round(greatest(x, z, 0), 4) as bound from w""")
def two_ball_bound(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    bound = scalar.two_ball_bound(F.col("alpha"), 0.8 * F.col("alpha"), F.col("s"), 8.0, 7.0, 100.0, b.n)
    return b.scored().select(key().alias("p"), r4(bound).alias("bound"))


@query(f"{_FULL} select p, round(sqrt(greatest({_T2} - a * a / 1e6, 0)), 4) as norm from sc, ms")
def projected_norm(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    return b.scored().select(key().alias("p"), r4(scalar.projected_norm(F.col("s"), F.col("alpha"), 1e6, b.n)).alias("norm"))


# ---- 2.E metrics and summaries

@query(f"with {_PRED} select grp, count(*) as n, round(sqrt(avg(power(y - mu, 2))), 4) as rmse, round(avg(abs(y - mu)), 4) as mae, round(sum({_DEV.format(m='mu')}), 3) as deviance, round(sum({_DEV.format(m='train_mean')}), 3) as null_deviance, round(1 - sum({_DEV.format(m='mu')}) / sum({_DEV.format(m='train_mean')}), 6) as pr2, round(1 - sum(power(y - mu, 2)) / (sum(y * y) - count(*) * avg(y) * avg(y)), 6) as r2 from pr group by 1")
def metrics_baseline(spark, sf_dir):
    m = metrics.prediction_metrics(predictions(spark, sf_dir), ["grp"])
    return m.select("grp", "n", r4("rmse").alias("rmse"), r4("mae").alias("mae"), F.round("deviance", 3).alias("deviance"), F.round("null_deviance", 3).alias("null_deviance"), F.round("pr2", 6).alias("pr2"), F.round("r2", 6).alias("r2"))


@query(f"with {_PRED}, te as (select grp, avg(y) as test_mean from pr group by 1) select grp, round(1 - sum({_DEV.format(m='mu')}) / sum({_DEV.format(m='test_mean')}), 6) as pr2_test, round(1 - sum({_DEV.format(m='mu')}) / sum({_DEV.format(m='train_mean')}), 6) as pr2_train from pr join te using (grp) group by 1")
def metrics_grouped(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = metrics.prediction_metrics(p, ["grp"], "test_mean").select("grp", F.round("pr2", 6).alias("pr2_test"))
    return a.join(metrics.prediction_metrics(p, ["grp"]).select("grp", F.round("pr2", 6).alias("pr2_train")), "grp")


@query(f"with {_PRED} select grp, round(sum({_DEV.format(m='mu').replace('1e-6', '1e-12')}), 3) as deviance, round(sum(sign(y - mu) * sqrt({_DEV.format(m='mu').replace('1e-6', '1e-12')})), 3) as signed, round(sum((y - mu) / sqrt(mu)), 3) as pearson from pr group by 1")
def poisson_deviance(spark, sf_dir):
    y, mu = F.col("y"), F.col("mu")
    return predictions(spark, sf_dir).groupBy("grp").agg(F.round(F.sum(metrics.deviance_term(y, mu)), 3).alias("deviance"), F.round(F.sum(metrics.deviance_residual(y, mu)), 3).alias("signed"), F.round(F.sum(metrics.pearson_residual(y, mu)), 3).alias("pearson"))


@query(f"with {_BI}, {_Y}, {_MS}, {_B1}, {_PT}, tru as (select 'N:NATION_1,R:AMERICA' as t union all select 'P:1-URGENT'), i as (select p, len, unnest(string_split(p, ',')) as x from sup), ti as (select t, len(string_split(t, ',')) as tl, unnest(string_split(t, ',')) as x from tru), o as (select p, len, t, tl, count(*) as n from i join ti using (x) group by all), r as (select p, min(case when n = len and n = tl then 0 when n = len then 1 when n = tl then 2 else 3 end) as r from o group by 1) select ['exact', 'strict_subset', 'strict_superset', 'partial_overlap', 'disjoint'][1 + coalesce(r, 4)] as relation, count(*) as n from sup left join r using (p) group by 1")
def structural_audit(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    truth = spark.createDataFrame([(["N:NATION_1", "R:AMERICA"],), (["P:1-URGENT"],)], "itemset array<string>")
    return metrics.structural_audit(b.frequent(), truth).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_FULL}, r as (select p, abs(a) as c, row_number() over (order by round(abs(a), 6) desc, p) as rank, p like 'B:%' as hit from sc) select k, round(count(case when hit and rank <= k then 1 end) / least(k, count(*)), 6) as precision, round(count(case when hit and rank <= k then 1 end) / count(case when hit then 1 end), 6) as recall from r, (select unnest([8, 10, 20, 50]) as k) group by k")
def rank_metrics(spark, sf_dir):
    scored = Baskets(spark, sf_dir).scored().withColumn("hit", F.get("itemset", F.lit(0)).like("B:%"))
    scored = written(scored, "scored")
    all_, hits = scored.count(), scored.filter("hit").count()
    top = scoring.top_k(scored.withColumn("score", F.abs("alpha")), "score", 50)
    place = selection.top_per_group(top.withColumn("one", F.lit(1)), ["one"], [F.desc(F.round("score", 6)), "itemset"], 50)
    ks = place.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (8, 10, 20, 50)]))).filter("place <= k")
    got = ks.groupBy("k").agg(F.count_if("hit").alias("got"))
    return got.select("k", F.round(F.col("got") / F.least("k", F.lit(all_)), 6).alias("precision"), F.round(F.col("got") / hits, 6).alias("recall"))


_PARTS = "act as (select distinct l_orderkey % 5 as seed, l_partkey as x from lineitem where l_returnflag = 'R'), tru as (select distinct l_orderkey % 5 as seed, l_partkey as x from lineitem where l_returnflag = 'A')"


def selected_parts(spark, sf_dir):
    """The parts of all lines of either flag by seed: there are as many parts as the input has, so the sets never fill up."""
    li = read(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(5)).alias("seed"), F.array("l_partkey").alias("itemset"), "l_returnflag")
    return [li.filter(F.col("l_returnflag") == f).select("seed", "itemset").distinct() for f in ("R", "A")]


_CNT = "cnt as (select o_orderpriority as arm, o_custkey % 10 as path, count(*) * 20 as nodes, count(*) as pruned_support, count(case when o_orderstatus = 'F' then 1 end) as pruned_canonical, 3 as pruned_v, count(case when o_orderstatus = 'O' then 1 end) as screened_u, 18 * count(*) as eligible, o_custkey % 10 as traversals from orders group by 1, 2)"


def counters(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.pmod("o_custkey", F.lit(10)).alias("path"))
    n = F.count(F.lit(1))
    c = o.agg((n * 20).alias("nodes"), n.alias("pruned_support"), F.count_if(F.col("o_orderstatus") == "F").alias("pruned_canonical"), F.lit(3).alias("pruned_v"), F.count_if(F.col("o_orderstatus") == "O").alias("screened_u"), (18 * n).alias("eligible"))
    return c.withColumn("traversals", F.col("path"))


@query(f"with {_CNT}, d as (select *, nodes - pruned_support - pruned_canonical - pruned_v as visited from cnt) select arm, path, sum(visited - screened_u)::bigint as remaining, sum(eligible * traversals)::bigint as all_visits, round(case when sum(eligible * traversals) > 0 then 1 - sum(visited - screened_u) / sum(eligible * traversals) end, 6) as rate, min(visited) >= 0 as valid from d group by 1, 2")
def path_totals(spark, sf_dir):
    return metrics.exclusion(counters(spark, sf_dir), ["arm", "path"]).withColumn("rate", F.round("rate", 6))


@query(f"with {_CNT} select arm, sum(nodes)::bigint as nodes, sum(screened_u)::bigint as screened, round(sum(screened_u) / sum(nodes), 6) as rate from cnt group by 1")
def summarize_pruning(spark, sf_dir):
    return counters(spark, sf_dir).groupBy("arm").agg(F.sum("nodes").alias("nodes"), F.sum("screened_u").alias("screened"), F.round(F.sum("screened_u") / F.sum("nodes"), 6).alias("rate"))


@query(f"with {_RUNS}, k as (select * from runs where not (endpoint like '1%' and method = 'BUILDING' and seed = 2)) select endpoint, method, count(rmse) as n, round(case when count(rmse) = 5 and count(distinct seed) = 5 then avg(rmse) end, 7) as mean, round(case when count(rmse) = 5 and count(distinct seed) = 5 then stddev_samp(rmse) end, 6) as sample_sd from k group by 1, 2")
def five_seed_stats(spark, sf_dir):
    r = runs(spark, sf_dir).filter("not (endpoint like '1%' and method = 'BUILDING' and seed = 2)")
    return metrics.five_seed(r, ["endpoint", "method"], "rmse").withColumns({"mean": F.round("mean", 7), "sample_sd": F.round("sample_sd", 6)})


@query(f"with {_RUNS}, k as (select * from runs where seed <> 2 or method <> 'BUILDING'), e as (select distinct endpoint from runs), m as (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as method) select e.endpoint, m.method, s.seed, k.rmse is null as missing from e, m, (select unnest([0, 1, 2, 3, 4]) as seed) s left join k on k.endpoint = e.endpoint and k.method = m.method and k.seed = s.seed")
def seed_series(spark, sf_dir):
    r = runs(spark, sf_dir)
    plan = r.select("endpoint").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS]))).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    have = r.filter("seed != 2 or method != 'BUILDING'")
    return plan.join(have, ["endpoint", "method", "seed"], "left").select("endpoint", "method", "seed", F.col("rmse").isNull().alias("missing"))


@query(f"with {_RUNS} select method, count(*) as planned, count(case when rmse > 150000 then 1 end) as verified, round(avg(rmse), 7) as mean, round(coalesce(stddev_samp(rmse), 0), 6) as sd from runs group by 1")
def level_stats(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("rmse") > 150000).alias("verified"), F.round(F.avg("rmse"), 7).alias("mean"), F.round(F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)), 6).alias("sd"))


@query(f"with {_RUNS}, m as (select endpoint, method, avg(rmse) as v, count(distinct seed) as seeds from runs group by 1, 2) select endpoint, arg_min(method, v) as winner, round(min(v), 7) as best, max(seeds) as seeds from m group by 1")
def pandas_groupby(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy("endpoint", "method").agg(F.avg("rmse").alias("v"), F.countDistinct("seed").alias("seeds"))
    return m.groupBy("endpoint").agg(F.min_by("method", "v").alias("winner"), F.round(F.min("v"), 7).alias("best"), F.max("seeds").alias("seeds"))


@query(f"with {_BI}, {_Y}, i as (select tid, count(*) as k from bi group by 1) select round(avg(y), 4) as mean, round(var_pop(y) / avg(y), 4) as dispersion, round(avg(case when y < 2 then 1.0 else 0 end), 6) as low_rate, round(exp(-avg(y) / 30), 6) as expected, round(avg(k), 4) as length from y join i using (tid)")
def data_diagnosis(spark, sf_dir):
    k = basket_items(spark, sf_dir).groupBy("tid").agg(F.count(F.lit(1)).alias("k"))
    return basket_response(spark, sf_dir).join(k, "tid").agg(r4(F.avg("y")).alias("mean"), r4(F.var_pop("y") / F.avg("y")).alias("dispersion"), F.round(F.avg(F.when(F.col("y") < 2, 1.0).otherwise(0.0)), 6).alias("low_rate"), F.round(F.exp(-F.avg("y") / 30), 6).alias("expected"), r4(F.avg("k")).alias("length"))


@query("select event_type as category, cast(value >= 100 as varchar) as msg, 'user' || (user_id % 5) as file, cast(json_extract_string(props, '$.k') as int) as line, count(*) as n from events group by 1, 2, 3, 4")
def warning_counts(spark, sf_dir):
    """Equal warnings: category, message, file and line (from a JSON field)."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") >= 100).cast("string").alias("msg"), F.concat(F.lit("user"), F.pmod("user_id", F.lit(5))).alias("file"), F.get_json_object("props", "$.k").cast("int").alias("line"))
    return e.groupBy("category", "msg", "file", "line").agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select n_name, c_mktsegment as pr, count(*) as count from customer join nation on n_nationkey = c_nationkey group by 1, 2), t as (select n_name, max(count) as count, sum(count)::bigint as resolved from c group by 1) select n_name, t.count, t.resolved, min(pr) as modal, count(*) as ties from t join c using (n_name, count) group by 1, 2, 3")
def annotate_modal(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return metrics.annotate_modal(c, ["n_name"], "c_mktsegment")


@query("select c_nationkey, count(distinct c_mktsegment) as residues from customer group by 1 having count(distinct c_mktsegment) > 1")
def reference_conflicts(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("residues")).filter("residues > 1")


@query(f"{_FULL} select pt.p, count(*) as support, round(count(*) / any_value(n), 6) as fraction, count(distinct tid % 3) as folds, round(exp(any_value(sc.a) / 1e5), 6) as effect from pt join sc using (p), ms group by 1")
def export_terms(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    seen = F.bit_or(F.expr("shiftleft(1, cast(pmod(tid, 3) as int))"))
    return b.scored(aggs=[F.bit_count(seen).cast("long").alias("folds")]).select(key().alias("p"), F.col("s").alias("support"), F.round(F.col("s") / b.n, 6).alias("fraction"), "folds", F.round(F.exp(F.col("alpha") / 1e5), 6).alias("effect"))


# ---- 2.F ranks and choices, 2.H sets

@query(f"with {_RUNS} select endpoint, seed, method, rank() over (partition by endpoint, seed order by rmse desc) as rank from runs")
def rank_cv(spark, sf_dir):
    return selection.rank_cv(runs(spark, sf_dir), ["endpoint", "seed"], "rmse").select("endpoint", "seed", "method", "rank")


@query("select * from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by abs(c_acctbal) desc, c_custkey) as place from customer) where place <= 3")
def rank_top3_multi(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return selection.top_per_group(c, ["c_nationkey"], [F.desc(F.abs("c_acctbal")), "c_custkey"], 3).select("c_nationkey", "c_custkey", "place")


@query(f"with {_GRID}, m as (select endpoint, point, avg(rmse) as m, count(*) as n from g group by 1, 2), b as (select endpoint, min(round(m, 9)) as r, sum(n) as n from m group by 1 having sum(n) = 21) select endpoint, min(point) as point, round(any_value(r), 7) as mean_rmse from b join m using (endpoint) where round(m.m, 9) = r group by 1")
def cv_choice(spark, sf_dir):
    return selection.cv_choice(grid_scores(spark, sf_dir), ["endpoint"], 3, 7).withColumn("mean_rmse", F.round("mean_rmse", 7))


@query(f"with {_GRID}, m as (select endpoint, point, avg(rmse) as m, stddev_samp(rmse) / sqrt(3) as se from g group by 1, 2), l as (select endpoint, arg_min(point, m) as cv_min, min(m) + arg_min(se, m) as lim from m group by 1) select endpoint, cv_min, min(point) as one_se from m join l using (endpoint) where round(m, 9) <= round(lim, 9) group by 1, 2")
def one_se_select(spark, sf_dir):
    return selection.one_se(grid_scores(spark, sf_dir), ["endpoint"])


@query(f"with {_GRID} select point, round(avg(rmse), 7) as mean, round(stddev_samp(rmse), 6) as sd from g group by 1")
def lambda_curve(spark, sf_dir):
    return grid_scores(spark, sf_dir).groupBy("point").agg(F.round(F.avg("rmse"), 7).alias("mean"), F.round(F.stddev_samp("rmse"), 6).alias("sd"))


def _sides(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return [li.filter(F.col("l_returnflag") == f).select("l_partkey") for f in ("R", "A")]


@query("select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A'")
def set_intersect(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query("select l_partkey from lineitem where l_returnflag = 'R' union select l_partkey from lineitem where l_returnflag = 'A'")
def set_union_dedupe(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.union(b).dropDuplicates(["l_partkey"])


@query("select l_partkey, l_suppkey from lineitem where l_returnflag = 'R' except select l_partkey, l_suppkey from lineitem where l_returnflag = 'A'")
def set_difference(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    a, b = (li.filter(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey") for f in ("R", "A"))
    return a.subtract(b)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_runs(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"with {_Y} select k.fold, count(*) as rows, sum(y) as total from y, (select unnest([0, 1, 2]) as fold) k where y.tid % 3 <> k.fold group by 1")
def concat_folds(spark, sf_dir):
    y = basket_response(spark, sf_dir).withColumn("own", splits.hash_fold("tid"))
    others = y.withColumn("fold", F.explode(F.array_remove(F.array(F.lit(0), F.lit(1), F.lit(2)), F.col("own"))))
    return others.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("total"))


# ---- 2.J models

@query(f"with {_BI}, {_Y}, {_MS}, h as (select tid, sum(case when item like 'R:%' then 0.2 else 0 end + case when item like 'P:1%' then -0.3 else 0 end) as z from bi group by 1) select y.tid, round(exp(1.5 + z), 6) as mu from y join h using (tid)")
def predict_linear_patterns(spark, sf_dir):
    b = Baskets(spark, sf_dir)
    singles = b.items.select("item").distinct().filter("item like 'R:%' or item like 'P:1%'")
    w = singles.select(F.array("item").alias("itemset"), F.when(F.col("item").like("R:%"), 0.2).otherwise(-0.3).alias("w"))
    return path.predict(w, 1.5, b.items, b.y).select("tid", F.round("mu", 6).alias("mu"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed patterns that survive the screen at half of lambda_max, the twenty best first."""
    b = Baskets(spark, sf_dir)
    scored = written(b.scored().withColumn("score", F.abs("alpha")), "scored")
    lam = 0.5 * (scored.agg(F.max("score")).first()[0] or 0.0)
    kept = scoring.screened(scored, lam, 3.0, b.n, mode="uscreen")
    return scoring.top_k(kept, "score", 20).select(key().alias("pattern"), F.col("s").alias("support"), F.round("score", 6).alias("score"), F.round("bound_u", 6).alias("bound"))
