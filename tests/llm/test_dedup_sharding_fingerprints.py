"""Exact dedup, sharding and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from conjunct.llm import exact_dedup, fingerprints, sharding

SCHEMA = "doc_id long, text string, keep_id string, _range int, count long"


def frame(spark, rows, parts=3):
    """With extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)


def corpus(n=300, seed=3):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    rows = [(i * 7 % 1009, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    hot = [(5000 + i, "the  hot\ttext") for i in range(200)] + [(6000, "the hot text"), (6001, None), (6002, ""), (6003, " "), (6004, "\n\t"), (6005, "z" * 50_000), (6006, "a b " * 20_000)]
    return rows + hot


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_groups(spark):
    rows = corpus() + [(6002, "")]  # a repeated row
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    want = Counter((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want


def test_null_ids_and_nothing(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, [(None, "a"), (3, "a"), (None, "b"), (None, "b")])).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, True)}
    assert exact_dedup.exact_groups(frame(spark, [(1, "a")]).filter("doc_id < 0")).count() == 0


def test_drop_copies(spark):
    rows = corpus() + [(6002, ""), (6002, "")]
    out = exact_dedup.drop_copies(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "keep_id", "_range", "count"]
    best = {}
    for i, t in rows:
        best[normal(t)] = min(i, best.get(normal(t), i))
    assert sorted(r.doc_id for r in out.collect()) == sorted(best.values())


def test_filter_is_native(spark):
    plan = exact_dedup.exact_groups(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[-1])


def test_clashing_names(spark):
    rows = corpus(60)
    names = ["_key", "_maybe", "_word0", "_word", "_slot", "bits", "_id", "_sha", "row", "kept", "text_sha256", "a.b"]
    df = frame(spark, rows).withColumns({n: F.lit(f"mine {n}") for n in names})
    best = {}
    for i, t in rows:
        best[normal(t)] = min(i, best.get(normal(t), i))
    got = exact_dedup.drop_copies(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(best.values()) and all(r[n] == f"mine {n}" for r in got for n in names)
    assert sum(r.kept for r in exact_dedup.exact_groups(df).collect()) == len(best)
    assert len(fingerprints.fingerprints(df).collect()) == len(sharding.shard_rows(df).collect()) == len(rows)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_large_filters_are_joined(spark, most):
    """A filter above the limit of a broadcast gives the same rows by a shuffle."""
    rows = corpus()
    df = frame(spark, rows)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df, most=most).collect()) == sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect())
    got = exact_dedup.exact_groups(df, most=most)
    assert sum(r.kept for r in got.collect()) == len({normal(t) for _, t in rows})


def test_few_lone_texts_pass_the_filter(spark):
    """At any number of rows: one in SLOTS, about."""
    keys = spark.range(20_000).selectExpr("sha2(cast(id as string), 256) as k")
    keys = keys.union(keys.limit(10))
    slots = exact_dedup.slots_for(20_010)
    marked = exact_dedup.slot_filter(keys, "k", slots)
    assert 20 <= exact_dedup.maybe_repeated(keys, "k", marked, slots).filter("_maybe").count() <= 20 + 20_010 / 200
    assert exact_dedup.slots_for(10**12) >= exact_dedup.SLOTS * 10**12


def arcs(rows, places):
    out = defaultdict(list)
    for row, place in rows:
        out[next((k for k, p in enumerate(places) if p >= place), 0)].append((place, row))
    return out


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_rows_law(spark, shards):
    rows = corpus()
    got = sharding.shard_rows(frame(spark, rows), shards=shards, nodes=16).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    texts = dict(rows)
    by = defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        by[r.shard].append(r.slot)
    assert set(by) == set(range(shards)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_bounded_loads_follow_the_ring(spark):
    """One key at a time, in the order of arcs and rounds: the relational result is that of the walk along the ring."""
    nodes = sharding.ring(4, 3)
    owners = [s for _, s in nodes]
    counts = {0: 9, 1: 1, 5: 4, 11: 2}
    given = sharding.allot(counts, owners, [4] * 4)
    load, left = [0] * 4, dict(counts)
    want = Counter()
    for r in range(len(owners)):
        for a in sorted(left):
            while left[a] and load[s := owners[(a + r) % len(owners)]] < 4:
                load[s] += 1
                left[a] -= 1
                want[a, s] += 1
    got = Counter()
    for a, start, stop, s, _ in given:
        got[a, s] += stop - start
    assert got == want and not any(left.values())
    with pytest.raises(ValueError):
        sharding.allot({0: 3}, owners, [0, 0, 1, 1])


def test_limited_movement(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, shards=n, slack=0.25).collect()} for n in (24, 25))
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(a)
    assert max(Counter(a.values()).values()) <= 1.25 * 4000 / 24 + 2


def test_key_law(spark):
    got = sharding.shard_rows(spark.range(2000).selectExpr("id as doc_id", "'t' as text"), slack=None).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)


def test_sharding_of_nulls_and_nothing(spark):
    got = sharding.shard_rows(frame(spark, [(None, "a"), (None, None), (1, "a"), (1, "a")]), shards=4).collect()
    assert sorted(r.shard for r in got) == [0, 1, 2, 3]
    assert sharding.shard_rows(frame(spark, [(1, "a")]).filter("doc_id < 0")).count() == 0


def own_hashes(t, k):
    """Hashes of a text's grams, pair by pair: xxHash64 of two code points (the first's hash seeds the second's, 42 the
    first's), shifted and joined by exclusive or."""
    pair = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(t, t[1:])]
    out = []
    for i in range(len(t) - k + 1):
        h = 0
        for j in range(0, k, 2):
            h ^= (pair[i + j] << k - 2 - j) & (1 << 64) - 1
        out.append(h)
    return out


def winnowed(t, k, w):
    """(position, hash) of the least hash of each window by its high bits, the rightmost of equal ones."""
    grams = own_hashes(t, k)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    high = [signed(h) >> fingerprints.PLACE for h in grams]
    starts = range(max(1, len(grams) - w + 1)) if grams else []
    at = sorted({max(range(s, min(s + w, len(grams))), key=lambda i: (-high[i], i)) for s in starts})
    return [(i, grams[i]) for i in at]


def shown(row):
    return [(int(p), int(h, 16)) for h, p in (x.split("@") for x in row.split(",") if x)]


def test_fingerprints(spark):
    """Each fingerprint and likeness from hashes made here, not by the code under test."""
    rows = corpus(120) + [(7000 + i, t) for i, t in enumerate(["日本語" * 40, "x" * 15, "y" * 16, "é" * 47, "ab" * 24, "😀z" * 50, "short"])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    k, w = fingerprints.K, fingerprints.W
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        t, u, r = t or "", u or "", got[i]
        m = len(t) // 3
        edited = t[: len(t) - m] + u[:m]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        own, new, theirs = shown(r.fingerprint), shown(r.edited_fingerprint), shown(got[j].fingerprint)
        if len(t) >= k:
            assert own == winnowed(t, k, w), i
        else:
            assert [p for p, _ in own] == [0] * bool(t)
        if len(edited) >= k:
            assert new == winnowed(edited, k, w), i
        like = lambda a, b: 2 * len({h for _, h in a} & {h for _, h in b}) / (len({h for _, h in a}) + len({h for _, h in b})) if a or b else 1.0
        assert r.near_edited == pytest.approx(like(own, new)) and r.near_next == pytest.approx(like(own, theirs))
    assert got[5000].fingerprint == got[5001].fingerprint != "" and got[6001].fingerprint == got[6002].fingerprint == ""


def test_shared_runs_give_a_common_hash(spark):
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    k, w = 8, 12
    rows = []
    for i in range(60):
        run = noise(w + k - 1)
        rows += [(2 * i, noise(r.randrange(0, 80)) + run + noise(r.randrange(0, 80))), (2 * i + 1, noise(r.randrange(0, 80)) + run)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: set(x.h) for x in fingerprints.with_fingerprint(df, "text", "h", "p", k, w).collect()}
    assert all(got[2 * i] & got[2 * i + 1] for i in range(60))


def test_winnowing(spark):
    """Positions are those of the least hash of each window, the rightmost of ties."""
    texts = ["", "a", "a b c", "a b c d e", "x y " * 40, " ".join(random.Random(5).choice("abcdef") for _ in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    all_of = fingerprints.with_fingerprint(df, "text", "h", "p", 4, 1).orderBy("doc_id").collect()
    some = fingerprints.with_fingerprint(df, "text", "h", "p", 4, 6).orderBy("doc_id").collect()
    for every, few in zip(all_of, some):
        grams = every.h
        want = sorted({max(range(s, s + min(6, len(grams))), key=lambda i: (-(grams[i] >> fingerprints.PLACE), i)) for s in range(max(1, len(grams) - 5))}) if grams else []
        assert few.p == want and few.h == [grams[p] for p in want]
        assert every.p == list(range(len(grams)))


def test_fingerprints_of_nothing_and_nulls(spark):
    assert fingerprints.fingerprints(frame(spark, [(1, "a")]).filter("doc_id < 0")).count() == 0
    lone = fingerprints.fingerprints(frame(spark, [(1, "abc def")])).collect()[0]
    assert lone.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and lone.near_next == 1.0
    got = fingerprints.fingerprints(frame(spark, [(None, "a b c"), (None, None), (4, "xyz abc"), (4, "xyz abc")])).collect()
    assert len(got) == 4


def test_fingerprints_at_every_length(spark):
    """Around k, w and w + k - 1 code points, with followers that lend none, few or all of what the edited text takes."""
    k, w = fingerprints.K, fingerprints.W
    r = random.Random(11)
    texts = [t for n in range(2 * (k + w)) for t in ("".join(r.choice("ab é😀") for _ in range(n)), "z" * (n % 7))]
    got = {x.doc_id: x for x in fingerprints.fingerprints(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        m = len(t) // 3
        edited = t[: len(t) - m] + texts[i - 1][:m]
        for have, of in ((got[i].fingerprint, t), (got[i].edited_fingerprint, edited)):
            have = shown(have)
            assert have == winnowed(of, k, w) if len(of) >= k else [p for p, _ in have] == [0] * bool(of), (i, of)


def test_passes_over_a_text_are_small(spark):
    """Spark interprets lambdas node by node: CPU time follows the nodes that are evaluated at each place of a text."""
    plan = spark.range(1).select(fingerprints.fingerprint(F.col("id").cast("string")))._jdf.queryExecution().analyzed()
    name = lambda e: e.getClass().getSimpleName()

    def children(e):
        return [e.children().apply(i) for i in range(e.children().size())]

    def size(e):
        return 1 + sum(size(c) for c in children(e))

    def passes(e):
        own = children(e)
        if name(e) in ("ArrayTransform", "ZipWith") and name(own[0]) != "CreateArray":  # of one value: a name for it
            yield size(children(own[-1])[0])
        for c in own:
            yield from passes(c)

    found = [n for i in range(plan.expressions().size()) for n in passes(plan.expressions().apply(i))]
    assert len(found) >= 5 and max(found) <= 8, found
