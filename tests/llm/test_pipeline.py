"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from conjunct.llm import exact_dedup
from tests.llm.test_classifiers import text, toxic_rows
from tests.llm.test_near_dups import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(9)
    rows = toxic_rows(700, 5)
    labels = [(i, 1, t) for i, _, _, _, t in rows]
    docs = [(i, x, lang, s) for i, x, lang, s, _ in rows]
    base = text(r, "aa", 120)
    docs += [(1000 + i, base.replace(" ", "  " if i % 2 else " "), "aa", "s") for i in range(30)]
    docs += [(2000 + i, base + f" tail{i}", "aa", "s") for i in range(20)]
    docs += [(3000, None, "aa", "s"), (3001, "", "bb", "s"), (3002, "123 ...", "bb", "s"), (3003, "日本語 中文", None, None), (3004, "thing er " * 20_000, "aa", "s"), (None, text(r, "bb", 9), "bb", "s")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], SCHEMA).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        after = [r.doc_id for r in out.collect()]
        assert len(after) == len(set(after)) and set(after) <= set(before), name
        kept[name] = before, set(after)
        out.write.parquet(f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(f"{sf_dir}/out-{name}")
    before, after = kept["language_id"]
    assert set(before) - after <= {3000, 3001, 3002, 3003} and {3000, 3001, 3002} <= set(before) - after
    before, after = kept["toxicity"]
    gone = set(before) - after
    assert sum(truth.get(i, 0) for i in gone) >= 0.9 * sum(truth.get(i, 0) for i in before) and sum(not truth.get(i, 0) for i in gone) <= 0.02 * len(before)
    before, after = kept["exact_dedup"]
    best = {}
    for i, t in before.items():
        k = re.sub("[\x20\x09-\x0d]+", " ", t)
        best[k] = min(i, best.get(k, i)) if i is not None else best.get(k)
    assert after == set(best.values())
    before, after = kept["near_duplicates"]
    rows = [(i, t) for i, t in before.items() if i is not None]
    assert after - {None} == {i for i, (_, c, _) in brute(rows, 5, 80).items() if c == i} and None in after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == after


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_without(spark):
    df = spark.createDataFrame([(i, "x") for i in [*range(50), None]], "doc_id long, _id string")
    dropped = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "gone long")
    keep = {None, *(i for i in range(50) if i % 3)}
    for most in (0, 1 << 20):  # the filter joined by shuffle, and broadcast
        assert {r.doc_id for r in exact_dedup.without(df, {"gone": df["doc_id"]}, dropped, most).collect()} == keep


def test_near_copies_of_null_and_repeated_ids(spark, sf_dir):
    """Ids don't tell rows apart: one row of each class stays, and a clean text that shares an id with a copy does too."""
    r = random.Random(4)
    base, other, clean = (text(r, "aa", 100) for _ in range(3))
    rows = [(5, base), (7, base + " x"), (7, clean), (None, base + " y"), (None, other), (None, other + " z"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], SCHEMA)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()]
    assert (5, base) in got and (7, clean) in got and (9, None) in got and (9, "") in got
    assert len(got) == 5 and sum(i is None and t.startswith(other) for i, t in got) == 1


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < -5")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


@pytest.mark.parametrize("stage", ["language_id", "toxicity", "exact_dedup", "near_duplicates", "packing"])
def test_clashing_names(spark, sf_dir, stage):
    """Extra columns with names that operators use themselves stay as they are, and change nothing else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60 or doc_id >= 1000 or doc_id is null")
    names = ["_key", "_maybe", "_word0", "_word", "_slot", "bits", "_hash", "row", "_id", "_host", "_declared", "_words", "_place", "_text_logs", "score", "threshold", "rejected", "lang_id", "cells", "n", "a", "b", "text_key", "sequence_id", "start", "id", "x.y"]
    more = docs
    for i, n in enumerate(names):
        more = more.withColumn(n, F.lit(i))
    run = dict(corpus_pipeline.STAGES)[stage]
    out, want = run(spark, more, sf_dir), run(spark, docs, sf_dir)
    key = "doc_id" if stage != "packing" else "start"
    got = out.collect()
    assert sorted(str((r.doc_id, r[key])) for r in got) == sorted(str((r.doc_id, r[key])) for r in want.collect())
    if stage != "packing":
        assert out.columns == more.columns and all(r[n] == i for r in got for i, n in enumerate(names))


def test_stages_collect_the_executors_garbage(spark, sf_dir):
    """Heaps stay in executors from stage to stage; a stage begins with a full collection, which lets them shrink."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).localCheckpoint()
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    for name, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in beans)
        stage(spark, docs, sf_dir)
        assert sum(b.getCollectionCount() for b in beans) > before, name
