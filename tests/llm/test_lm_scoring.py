"""Stupid backoff against counts made with Python."""

import math
import random
import re
from collections import Counter

import pytest

from conjunct.llm import lm_scoring

SCHEMA = "doc_id long, text string, chunk string, part int"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, least=2, backoff=0.4):
    one, two = Counter(), Counter()
    for _, t in rows:
        w = words(t)
        one.update(w)
        two.update(zip(w, w[1:]))
    total, out = sum(one.values()), []
    for i, t in rows:
        w, score, off = words(t), 0.0, 0
        for k, x in enumerate(w):
            if k and two[w[k - 1], x] >= least:
                score += math.log(two[w[k - 1], x] / one[w[k - 1]])
            else:
                off += k > 0
                score += math.log((backoff if k else 1) * one[x] / total)
        out.append((i, len(w), score, off))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(80)] + ["the"] * 40
    rows = [(i, r.choice([" ", "\n", " \t"]).join(r.choice(vocabulary) for _ in range(r.randrange(0, 40)))) for i in range(400)]
    return rows + [(1000 + i, "a hot text of many copies") for i in range(200)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "w1é the " * 8000), (2004, "again"), (2005, "again")]


@pytest.mark.parametrize("chunk,partition", [(lm_scoring.CHUNK, lm_scoring.PARTITION), (300, 700)])
def test_scores(spark, chunk, partition):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.n_words, r.log_score, r.n_backoff, r.per_word) for r in lm_scoring.stupid_backoff(df, chunk=chunk, partition=partition).collect())
    want = sorted(brute(rows))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9) and g[3] == w[3]
        assert g[4] == (pytest.approx(w[2] / w[1]) if w[1] else None)


def test_nothing_and_null_ids(spark):
    assert lm_scoring.stupid_backoff(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = lm_scoring.stupid_backoff(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r.n_words for r in got) == [0, 2, 2]


def brute_of(rows, order, least=2, backoff=0.4):
    counts = Counter()
    for _, t in rows:
        w = words(t)
        counts.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total, out = sum(c for g, c in counts.items() if len(g) == 1), []

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total, 0
        if counts[gram] >= least:
            return counts[gram] / counts[gram[:-1]], 0
        lower, steps = score(gram[1:])
        return backoff * lower, steps + 1

    for i, t in rows:
        w = words(t)
        found = [score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))]
        out.append((i, len(w), sum(math.log(s) for s, _ in found), sum(steps > 0 for _, steps in found)))
    return out


@pytest.mark.parametrize("order,least", [(1, 2), (3, 2), (3, 1), (4, 3)])
def test_orders(spark, order, least):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.n_words, r.log_score, r.n_backoff) for r in lm_scoring.stupid_backoff(df, chunk=3000, partition=7000, order=order, least=least).collect())
    for g, w in zip(got, sorted(brute_of(rows, order, least)), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9) and g[3] == w[3]


def test_query_uses_trigrams(spark, tmp_path):
    from conjunct.llm.queries import op8_lm_scoring

    rows = [(1, "a b c"), (2, "a b c"), (3, "x b d"), (4, "x b d"), (5, "a b d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.log_score, r.n_backoff) for r in op8_lm_scoring(spark, str(tmp_path)).collect()}
    for i, _, score, off in brute_of(rows, 3):
        assert got[i] == (pytest.approx(score), off)
    assert got[5][1] == 1  # `a b d` occurs once, though `b d` is frequent
