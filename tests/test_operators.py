"""Metrics, choices, splits, sources and rules on small fixtures with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conjunct.functions import scalar
from conjunct.operators import scoring, itemsets, metrics, rules, selection
from conjunct.plans import splits
from conjunct.sources import generators, tables


def test_metrics_fixture(spark):
    """y = [0, 2, 4], prediction [-1, 2, 3], train mean 10."""
    df = spark.createDataFrame([("a", y, m, 10.0) for y, m in zip([0.0, 2.0, 4.0], [-1.0, 2.0, 3.0])], "g string, y double, mu double, train_mean double")
    r = metrics.prediction_metrics(df, ["g"]).first()
    assert r.r2 == pytest.approx(0.75) and r.rmse == pytest.approx(math.sqrt(2 / 3))
    dev = 2 * 1e-6 + 0 + 2 * (4 * math.log(4 / 3) - 1)
    null = sum(2 * ((y * math.log(y / 10) if y else 0) - y + 10) for y in (0, 2, 4))
    assert r.pr2 == pytest.approx(1 - dev / null)
    constant = spark.createDataFrame([("a", 2.0, 2.0, 2.0)], "g string, y double, mu double, train_mean double")
    assert (lambda x: (x.r2, x.pr2))(metrics.prediction_metrics(constant, ["g"]).first()) == (None, None)


def test_recovery_and_audit(spark):
    frame = lambda sets: spark.createDataFrame([(s,) for s in sets], "itemset array<int>")
    active, truth = frame([[1, 2], [1], [1, 2, 3], [2, 9], [7]]), frame([[1, 2], [4, 5]])
    r = metrics.recovery(active, truth).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 4, 1, 0.2, 0.5)
    assert {tuple(x.itemset): x.relation for x in metrics.structural_audit(active, truth).collect()} == {
        (1, 2): "exact", (1,): "strict_subset", (1, 2, 3): "strict_superset", (2, 9): "partial_overlap", (7,): "disjoint"}


def test_five_seed_gate(spark):
    rows = [("a", s, float(s)) for s in range(5)] + [("b", s, 1.0) for s in range(4)] + [("c", s % 4, 1.0) for s in range(5)] + [("d", s, None if s == 2 else 1.0) for s in range(5)]
    out = {r.m: r for r in metrics.five_seed(spark.createDataFrame(rows, "m string, seed int, v double"), ["m"], "v").collect()}
    assert out["a"].mean == 2.0 and out["a"].sample_sd == pytest.approx(math.sqrt(2.5))
    assert [out[k].mean for k in "bcd"] == [None, None, None]


def test_exclusion_sums_before_the_ratio(spark):
    rows = [(100, 10, 0, 0, 80, 90, 1), (10, 0, 0, 0, 0, 10, 3), (0, 0, 0, 0, 0, 50, 0)]
    df = spark.createDataFrame([("p", *r) for r in rows], "arm string, nodes long, pruned_support long, pruned_canonical long, pruned_v long, screened_u long, eligible long, traversals long")
    r = metrics.exclusion(df, ["arm"]).first()
    assert (r.remaining, r.all_visits, r.valid) == (20, 120, True) and r.rate == pytest.approx(1 - 20 / 120)
    assert metrics.exclusion(df.filter("traversals = 0"), ["arm"]).first().rate is None
    assert not metrics.exclusion(df.withColumn("pruned_v", F.lit(200)), ["arm"]).first().valid


def test_modal_profile(spark):
    df = spark.createDataFrame([("x", p) for p in ["A", "A", "B", "B", "C", None]], "g string, p string")
    assert tuple(metrics.annotate_modal(df, ["g"], "p").first()) == ("x", 2, 5, "A", 2)


def test_choices(spark):
    rows = [("e", f, p, [3.0, 1.0, 1.0][p] + 0.1 * f) for f in range(3) for p in range(3)]
    df = spark.createDataFrame(rows, "g string, fold int, point int, rmse double")
    assert selection.cv_choice(df, ["g"], 3, 3).first().point == 1  # ties go to the smaller index
    assert selection.cv_choice(df.filter("fold != 1 or point != 0"), ["g"], 3, 3).isEmpty()
    assert tuple(selection.one_se(df, ["g"]).first()) == ("e", 1, 1)


def test_splits(spark):
    df = spark.createDataFrame([(2 * g + j, f"invented-{g:03d}") for g in range(30) for j in range(2)], "row int, grp string")
    members = set()
    for seed in range(42, 47):
        out = splits.group_split(df, "grp", seed).collect()
        test = {r.grp for r in out if r.role == "test"}
        assert len(test) == 3 and test.isdisjoint({r.grp for r in out if r.role == "train"})
        members.add(frozenset(test))
    assert len(members) == 5
    sizes = sorted(r["count"] for r in splits.kfold(df, "row", 42).groupBy("fold").count().collect())
    assert sizes == [20, 20, 20]


def test_token_rules(spark):
    df = spark.createDataFrame([(" - ",), ("M",), ("Y",), (".",), (" # ",), ("",)], "t string")
    assert [r[0] for r in df.select(scalar.present(F.col("t"))).collect()] == [False, True, True, False, True, False]
    assert spark.range(1).select(scalar.expand_ranges(F.lit("16-18,40"))).first()[0] == [16, 17, 18, 40]


def test_files(spark, tmp_path):
    doc = {"transactions": [[2, 1, 1], [], [3]], "y": [1, 2, 3], "train_indices": [0, 2], "test_indices": [1]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert [(r.tid, list(r.items_), r.y, r.role) for r in tables.scan_dataset(spark, str(tmp_path / "d.json")).withColumnRenamed("items", "items_").orderBy("tid").collect()] == [(0, [1, 2], 1.0, "train"), (1, [], 2.0, "test"), (2, [3], 3.0, "train")]
    (tmp_path / "t.tsv").write_text("SeqID\tX\tP1\tP2\na\t2.5\t-\tM\nb\tNA\tY\t.\n")
    assert tables.scan_tsv(spark, str(tmp_path / "t.tsv"), 2, 2).count() == 2
    with pytest.raises(ValueError):
        tables.scan_tsv(spark, str(tmp_path / "t.tsv"), 3)
    (tmp_path / "lcm").write_text("1 2 (2)\n0 5\n3 (1)\n4\n")
    assert [tuple(map(str, r)) for r in tables.scan_miner_output(spark, str(tmp_path / "lcm"), 6).orderBy("support").collect()] == [("[3]", "1", "[4]"), ("[1, 2]", "2", "[0, 5]")]
    with pytest.raises(Exception):
        tables.scan_miner_output(spark, str(tmp_path / "lcm"), 5).collect()
    rows = spark.createDataFrame([([1, 2], 0), ([1, 2], 5), ([3], 4)], "itemset array<int>, tid int")
    tables.write_dictionary(rows, str(tmp_path / "dict"), 4)
    assert sorted(tables.read_dictionary(spark, str(tmp_path / "dict")).collect()) == sorted(rows.collect())
    with pytest.raises(Exception):
        tables.write_dictionary(rows, str(tmp_path / "dict"), 4)


def test_generators():
    one, again = (generators.generate_count(2, 2609271101, rows=500) for _ in range(2))
    tx, y, truths = one.transactions, one.y, one.truths
    assert tx == again.transactions and (y == again.y).all() and len(truths) == 2 and all(len(t) == 4 for t in truths)
    z = np.array([[set(t) <= set(x) for t in truths] for x in tx])
    assert y[z[:, 0] & ~z[:, 1]].mean() > 1.5 * y[~z.any(axis=1)].mean()
    assert np.allclose(one.mean, 30 * np.exp(z @ one.weights)) and [one.role(i) for i in (0, 349, 350)] == ["train", "train", "test"]
    # the registered draws: signals have their own stream, one number for each row, truth and item
    own = np.random.default_rng(np.random.SeedSequence([2609271101, 202609244]).spawn(4)[0]).random((500, 2, 4)) < 0.65
    assert (own.all(axis=2) == z).all()


def test_generators_of_mixed_lengths():
    g = generators.generate_length(7, 2609272301, rows=400)
    assert sorted(map(len, g.truths)) == [4, 5, 6, 7]
    lengths = np.arange(4, 8)
    np.random.default_rng(np.random.SeedSequence([2609272301, 202609244]).spawn(5)[4]).shuffle(lengths)
    assert [len(t) for t in g.truths] == lengths.tolist()
    for truths in (4, 8):
        for regime in ("fixed4", "mixed_natural", "mixed_equal_support"):
            m = generators.generate_mixed(regime, truths, 2609272201, rows=300)
            assert len(m.truths) == truths and len({i for t in m.truths for i in t}) == sum(map(len, m.truths)) <= 64
    with pytest.raises(ValueError):
        generators.generate_mixed("other", 4, 1)


def test_older_generators():
    tx = generators.generate_basic(50, 20, 5, 3)
    assert len(tx) == 50 and all(t == sorted(set(t)) and 1 <= len(t) and max(t) < 20 for t in tx)
    planted = generators.generate_planted_baskets([(3, 7), (10, 11, 12)], [0.5, 0.2], 400, 30, 0.05, 1)
    assert 150 < sum({3, 7} <= set(t) for t in planted) < 260
    y = generators.poisson_labels([[1, 2], [], [1]], [(1, 2)], [3.0], 0.0, 1)
    assert len(y) == 3 and (y == np.random.default_rng(1).poisson([math.e**3, 1, 1])).all()
    tx, y = generators.generate_legacy(200, 42, "large")
    assert (y >= 0).all() and 40 < sum({3, 7, 15, 22} <= set(t) for t in tx) < 110


def test_two_references_screen_more(spark):
    """A second ball never excludes less, and keeps every pattern that some point of both balls reaches."""
    rows = [([0], 4, 9.0, 9.5, 1.0, 8.0, 8.5, 0.5), ([1], 6, 2.0, 1.0, 3.0, 2.5, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "itemset array<int>, s int, alpha double, alpha_pos double, alpha_neg double, b double, b_pos double, b_neg double")
    one = {tuple(r.itemset): (r.bound_u, r.bound_v) for r in scoring.screened(df, 0.0, 2.0, 12).collect()}
    two = {tuple(r.itemset): (r.bound_u, r.bound_v) for r in scoring.screened(df, 0.0, 2.0, 12, second=("b", 1.5, 1.0)).collect()}
    assert all(two[k][0] <= one[k][0] + 1e-9 and two[k][1] <= one[k][1] for k in one) and two[(1,)] != one[(1,)]
    assert scoring.working_set_screen(df, 8.0, 0.1, 12).count() == 1


def test_evidence_files(spark, tmp_path):
    import hashlib

    root = tmp_path / "run"
    root.mkdir()
    sums = {}
    for k in range(2):
        (root / f"p{k}.json").write_text(json.dumps({"point": k}) + "\n")
        sums[f"p{k}.json"] = hashlib.sha256((root / f"p{k}.json").read_bytes()).hexdigest()
    manifest = spark.createDataFrame(list(sums.items()), "path string, sha256 string")
    assert sorted(r.point for r in tables.saved_points(spark, str(root), manifest).collect()) == [0, 1]
    (root / "p1.json").write_text("{}")
    with pytest.raises(ValueError, match="p1.json changed"):
        tables.saved_points(spark, str(root), manifest)
    with pytest.raises(ValueError, match="p9 missing"):
        tables.saved_points(spark, str(root), spark.createDataFrame([("p9", "x")], "path string, sha256 string"))
    (tmp_path / "points.csv").write_text("point,tau\n0,1\n1,0.5\n")
    digest = hashlib.sha256((tmp_path / "points.csv").read_bytes()).hexdigest()
    assert tables.archived_points(spark, str(tmp_path / "points.csv"), digest, 2).count() == 2
    for wrong in (("x", 2), (digest, 3)):
        with pytest.raises(ValueError):
            tables.archived_points(spark, str(tmp_path / "points.csv"), *wrong)


def test_sinks(spark, tmp_path):
    where = str(tmp_path / "a.json")
    tables.write_json(spark, {"b": 1, "a": [None, 2.5]}, where)
    assert json.loads(open(where).read()) == {"a": [None, 2.5], "b": 1} and open(where).read().index('"a"') < open(where).read().index('"b"')
    tables.write_json(spark, {"c": 2}, where)
    assert json.loads(open(where).read()) == {"c": 2}
    with pytest.raises(FileExistsError):
        tables.write_json(spark, {}, where, replace=False)
    with pytest.raises(ValueError):
        tables.write_json(spark, {"x": float("nan")}, where)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "kept"), {"least": 3, "rows": "abc"}, make).count() == 3
    tables.cached(spark, str(tmp_path / "kept"), {"least": 4, "rows": "abc"}, make)
    assert len(made) == 2
    df = spark.createDataFrame([("a", 1.23456, None)], "m string, x double, y double")
    assert tables.markdown_rows(df, ["m", "x", "y"])[2] == "| a | 1.2346 | NA |"
    assert tables.contained("/data/run", "a/../b.json") == "/data/run/b.json"
    with pytest.raises(ValueError):
        tables.contained("/data/run", "../other")
    (tmp_path / "t.tsv").write_text("SeqID\tX\na\t2.5\nb\tNA\n")
    assert [str(r.X) for r in tables.scan_tsv_lenient(spark, str(tmp_path / "t.tsv"), ["X"]).collect()] == ["2.5", "nan"]


def test_split_operators(spark):
    df = spark.createDataFrame([(2 * g + j, f"invented-{g:03d}") for g in range(31) for j in range(2)], "row int, grp string")
    whole = splits.prepare_split(df, "grp", 42).collect()
    test = {r.grp for r in whole if r.role == "test"}
    assert len(test) == 4 and all(r.fold is None for r in whole if r.role == "test")
    by = {}
    for r in whole:
        if r.role == "train":
            by.setdefault(r.grp, set()).add(r.fold)
    assert all(len(f) == 1 for f in by.values()) and sorted(sum(min(f) == k for f in by.values()) for k in range(3)) == [9, 9, 9]
    back = splits.restore_rows(splits.prepare_split(df, "grp", 42), "row")
    assert sorted(map(tuple, back.select("row", "grp").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="repeats"):
        splits.restore_rows(splits.prepare_split(df.union(df.limit(1)), "grp", 42), "row").collect()
    sizes = {r.role: r["count"] for r in splits.split_endpoint(df, "row", 1).groupBy("role").count().collect()}
    assert sizes == {"train": 50, "validation": 6, "test": 6}
    sparse = spark.createDataFrame([(x,) for x in (5, -3, 10**9, 7, 8)], "row long")
    assert [(r.row, r.place) for r in splits.ordinal(sparse, "row").orderBy("row").collect()] == [(-3, 0), (5, 1), (7, 2), (8, 3), (10**9, 4)]
    seen = splits.registered_group_split(df, "grp", 42)
    unique = sorted({r.grp for r in df.collect()})
    assert {r.grp for r in seen.filter("role = 'test'").collect()} == {unique[i] for i in np.random.RandomState(42).permutation(31)[:4]}


LEFT, RIGHT, FEATURE, THRESHOLD = [1, 2, -1, -1, 5, -1, -1], [4, 3, -1, -1, 6, -1, -1], [0, 1, -2, -2, 1, -2, -2], [0.5, 0.5, -2.0, -2.0, 0.5, -2.0, -2.0]


def nodes(spark, threshold=THRESHOLD, feature=FEATURE, copies=2):
    rows = [(t, i, LEFT[i], RIGHT[i], feature[i], float(threshold[i])) for t in range(copies) for i in range(7)]
    return spark.createDataFrame(rows, "tree int, node int, left int, right int, feature int, threshold double")


def test_rules(spark):
    item_tid = itemsets.long_form(spark.createDataFrame([(i, x) for i, x in enumerate([[], [1], [0], [0, 1]] * 2)], "tid long, items array<int>"))
    got = {tuple(r.itemset): (r.support, r.trees, r.paths) for r in rules.path_rules(nodes(spark), item_tid, 2, 2).collect()}
    assert got == {(0,): (4, 2, 2), (0, 1): (2, 2, 2)}
    assert {tuple(r.itemset) for r in rules.projections(nodes(spark), item_tid, 2, 2).collect()} == {(0,), (1,), (0, 1)}
    assert {tuple(r.itemset) for r in rules.path_rules(nodes(spark), item_tid, 3, 2).collect()} == {(0,)}
    assert {tuple(r.itemset) for r in rules.path_rules(nodes(spark), item_tid, 1, 1).collect()} == {(0,)}
    assert rules.path_rules(nodes(spark), item_tid, 9, 2).isEmpty()
    same = rules.path_rules(nodes(spark, feature=[0, 0, -2, -2, 0, -2, -2], copies=1), item_tid, 1, 2).collect()
    assert [tuple(r.itemset) for r in same] == [(0,)] and same[0].paths == 2
    odd = nodes(spark, threshold=[-1.0, 1.0, -2.0, -2.0, math.inf, -2.0, -2.0])
    assert rules.path_rules(odd, item_tid, 1, 2).isEmpty()
