"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from conjunct.llm import components, near_dups, shingles


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = words(t)
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(rows, k, percent):
    sets, n = shingle_sets(rows, k), len(rows)
    label, links = list(range(n)), [0] * n

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i in range(n):
        r = root(i)
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return {rows[i][0]: (len(sets[i]), least[root(i)], links[i]) for i in range(n)}


def families(seed, copies=60, singles=150):
    """Families of near copies at all distances, a passage that many share, and single texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for size in (3, 5, 12, 40, 150, 700):
        base = text(size)
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(0, max(2, size // 12))):
                at = r.randrange(len(own))
                own[at : at + r.randrange(0, 2)] = text(r.randrange(0, 3))
            rows.append(" ".join(own))
    for _ in range(singles):
        rows.append(" ".join(text(r.randrange(1, 80)) + (passage if r.random() < 0.5 else [])))
    rows += ["", None, " \n", "One", "one", "ONE\ttwo", "é É", "ɪ " * 40, "same text of a hot group " * 3] + ["same text of a hot group " * 3] * 80
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_classes(spark, k, percent, seed):
    rows = families(seed)
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n long, cells string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in near_dups.jaccard_classes(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_small_cases(spark):
    schema = "doc_id long, text string"
    assert near_dups.jaccard_classes(spark.createDataFrame([], schema)).count() == 0
    got = near_dups.jaccard_classes(spark.createDataFrame([(None, "a b"), (None, "a b"), (2, None), (5, "x"), (5, "x"), (4, "x")], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == [("2", 0, "2", 0), ("4", 1, "4", 2), ("5", 1, "4", 2), ("5", 1, "4", 2), ("None", 1, "None", 1), ("None", 1, "None", 1)]


def test_null_and_repeated_ids(spark):
    """Ids don't tell texts apart: each row goes by its own text."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    near = lambda t, n: " ".join(t[:n] + [f"x{n}"] + t[n + 1 :])
    rows = [(None, " ".join(base)), (None, near(base, 50)), (None, " ".join(other)), (7, near(other, 20)), (7, near(base, 30)), (9, near(other, 60))]
    r.shuffle(rows)
    got = near_dups.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.component_id, x.n_links) for x in got) == [("7", 7, 2), ("7", 7, 2), ("9", 7, 2), ("None", 7, 2), ("None", 7, 2), ("None", 7, 2)]


@pytest.mark.parametrize("percent", [80, 85])
def test_every_similar_pair_shares_a_cell(percent):
    r = np.random.default_rng(0)
    for _ in range(1500):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[r.random(len(a)) > r.random() * 0.2]
        b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or not near_dups.reaches(len(a), len(b), common, percent):
            continue
        assert len(np.intersect1d(near_dups.cells(a, percent), near_dups.cells(b, percent)))
        # and more of them in each shared tile than either may leave out
        (x, bx), (y, by) = near_dups._cells(a, percent), near_dups._cells(b, percent)
        shared = np.intersect1d(x, y)
        spare = {e & 255: e >> 8 for e in bx}
        other = {e & 255: e >> 8 for e in by}
        assert any((shared & np.uint64(255) == band).sum() > max(spare[band], other[band]) for band in spare.keys() & other.keys())
        u, v = near_dups.bitmap(a), near_dups.bitmap(b)
        size = min(len(u), len(v))
        differ = int(np.bitwise_count(near_dups.folded(u, size) ^ near_dups.folded(v, size)).sum())
        assert differ <= len(a) + len(b) - 2 * common and near_dups.may_reach(len(a), len(b), differ, percent)


def test_shingle_sets_match_tuples():
    r = random.Random(4)
    texts = ["".join(r.choice("aAbé \t\n") for _ in range(r.randrange(0, 40))) for _ in range(400)]
    seen = {}
    for t in texts:
        want = shingle_sets([(0, t)], 3)[0]
        got = shingles.shingle_set(t.encode(), 3)
        assert len(got) == len(want)
        assert seen.setdefault(got.tobytes(), want) == want


def test_components(spark):
    r = random.Random(6)
    ids = [r.getrandbits(62) for _ in range(300)]
    edges = [(ids[i], ids[i + 1]) for i in range(120)] + [(ids[150], ids[i]) for i in range(151, 290)] + [(ids[200], ids[200])]
    got = {}
    for row in components.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(row.label, set()).add(row.node)
    assert sorted(map(len, got.values())) == [121, 140]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names_never_clash(spark, monkeypatch):
    """Sets whose hashes clash get other names, until all differ."""
    from pyspark.sql import functions as F

    sets = spark.range(500).selectExpr("id as a", "id * 3 as b", "1L as n")
    real = F.xxhash64
    monkeypatch.setattr(near_dups.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2000 if len(c) == 3 else 1 << 40)))
    monkeypatch.setattr(near_dups, "CLASHES", 7)
    got = [r[0] for r in sets.select(near_dups.names(sets)).collect()]
    assert len(set(got)) == 500


def test_copies_of_a_set_are_bounded(spark):
    """However large a family is, a set goes to COPIES blocks at most, while blocks hold LARGEST shingles."""
    sizes = spark.createDataFrame([(1, 20, 50), (2, 50_000, 200), (3, 250_000, 200), (4, 50_000, 2_000_000)], "label long, count long, longest long")
    families = sizes.selectExpr("label as node", "label")
    got = {r.label: r.blocks for r in near_dups.blocks_of(families, sizes).collect()}
    assert got[1] == 1 and got[2] <= near_dups.COPIES and got[3] <= near_dups.COPIES
    assert got[4] == 25_000  # two sets of two million shingles to a block


def test_a_large_family(spark):
    """Near copies in blocks of blocks: all linked, and counted."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        own[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = near_dups.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    want = brute(rows, 4, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in got} == want


def test_very_long_texts(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(50_000)}" for _ in range(60_000)]
    near = list(base)
    near[5] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, "z" * 300_000), (4, "z" * 300_000 + "y")]
    got = {x.doc_id: x.component_id for x in near_dups.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
