"""Registered queries that read whole tables, against their SQL."""

import duckdb
import pytest

from conjunct.plans import study  # noqa: F401  registers its queries
from conjunct.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def oracle(name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "region", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    return found.fetchall(), columns


@pytest.mark.parametrize("name", ["contain_join", "recovery", "jaccard_agreement", "kfold", "prepare_split", "closure_canonical", "mine_closed_ext", "recovery_extended", "kkt_residual", "is_subset_tid", "pattern_mask", "price_scan"])
def test_whole(spark, name):
    rows = QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()), key=str)
    want, columns = oracle(name)
    assert sorted(columns) == sorted(rows.columns) and len(got) == len(want) > 0
    for g, w in zip(got, sorted((tuple(w[columns.index(c)] for c in sorted(columns)) for w in want), key=str)):
        for a, b in zip(g, w):
            assert a == (pytest.approx(b) if isinstance(a, float) else b)


def test_dictionary_has_all_lengths(spark):
    found = {r.p for r in QUERIES["contain_join"](spark, SF).select("p").distinct().collect()}
    assert {p.count(",") for p in found} == {0, 1, 2}
    assert {r.p for r in QUERIES["enum_frequent"](spark, SF).collect()} == found


def test_recovery_is_no_constant(spark):
    rows = QUERIES["recovery"](spark, SF).collect()
    assert rows and all(0 < r.precision < 1 and 0 < r.recall < 1 for r in rows)


def test_no_second_names():
    assert len(set(QUERIES.values())) == len(QUERIES)


def test_path_query(spark):
    rows = QUERIES["fit_path"](spark, SF).collect()
    assert [r.point for r in rows] == list(range(len(rows))) and all(r.converged and r.kkt <= 1e-7 for r in rows)
    assert rows[-1].active > 0 and 0 < rows[-1].excluded
