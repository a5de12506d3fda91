"""Language ID and toxicity: held-out accuracy, brute force of the fusion, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conjunct.llm import language, toxicity

SYLLABLES = {"aa": ["th", "ing", "er", "wh", "sh"], "bb": ["ung", "sch", "pf", "ei", "zu"], "cc": ["eau", "oi", "eux", "que", "ré"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(i, text(r, lang, r.randrange(3, 40)), lang, f"src{0 if i % 3 else i % 7}") for i, lang in enumerate(r.choice("abc") * 2 for _ in range(600))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


def test_languages_held_out(spark, docs):
    model = language.train(docs, each=40)
    assert model.names == ["aa", "bb", "cc"]
    wrong = docs.withColumn("said", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "aa").otherwise(F.col("lang")))
    out = language.identify_documents(wrong, model).collect()
    assert len(out) == 600
    assert sum(r.lang_id == r.said for r in out) >= 594  # the text overrules a false declaration
    assert not any(r.lang_rejected for r in out)


def test_fusion_is_bayes(spark, docs):
    """Posterior from counts made with Python."""
    model = language.train(docs, each=40)
    out = language.identify_documents(docs.filter("doc_id < 200"), model).collect()
    own = language.Languages(model.names, model.logs)
    ev = {r.doc_id: own.evidence(r.text)[0] for r in out}
    best = {d: int(e.argmax()) for d, e in ev.items()}
    size = len(model.names)
    share = np.array([sum(b == i for b in best.values()) + 1.0 for i in range(size)])
    share /= share.sum()
    for r in out[:60]:
        mates = [x for x in out if x.source == r.source]
        n = np.array([sum(best[x.doc_id] == i for x in mates) for i in range(size)], float)
        prior = (n + language.HOST * share) / (n.sum() + language.HOST)
        said = {v: np.array([sum(best[x.doc_id] == i and x.lang == v for x in out) for i in range(size)]) + 1.0 for v in "aa bb cc".split()}
        total = sum(said.values()) + 1.0
        z = np.log(prior) + np.log(said[r.lang] / total) + language.TRUST * ev[r.doc_id]
        p = np.exp(z - z.max())
        assert r.lang_confidence == pytest.approx((p / p.sum()).max(), abs=2e-6) and r.lang_id == model.names[int(z.argmax())]


def test_pages(spark, docs):
    model = language.train(docs, each=40)
    page = "<!DOCTYPE html><HTML class=x lang='bb-DE'><script>var t='</p>'</script><!-- que eau --><p>{}</p></html>"
    r = random.Random(5)
    rows = [(i, f"https://u@a{i % 5}.site{i % 2}.org:80/x?y", page.format(text(r, "bb", 20))) for i in range(40)]
    rows += [(100, None, None), (101, "no address", "<p>1 2 3 &amp; 4</p>"), (102, "http://h/", "<html lang=''>" + text(r, "cc", 30))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", F.lit("clash")).withColumn("lang_id", F.lit(1))
    out = {r.page_id: r for r in language.identify_pages(df, model).collect()}
    assert len(out) == 43 and all(out[i].lang_id == "bb" and not out[i].lang_rejected for i in range(40))
    assert out[100].lang_rejected and out[101].lang_rejected and out[102].lang_id == "cc"


def test_language_odd_rows(spark, docs):
    model = language.train(docs, each=40)
    rows = [(1, None, None, None), (2, "", "aa", "s"), (3, "!!! 123", "aa", "s"), (4, "thing " * 30_000, None, None), (None, "thing er", "zz", "s"), (None, "thing er", "zz", "s"), (7, "日本語 中文 한국어 日本", "aa", "s")]
    out = language.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[1].lang_rejected and by[2].lang_rejected and by[3].lang_rejected and not by[4].lang_rejected and by[None].lang_id == "aa"
    assert language.identify_documents(docs.filter("doc_id < 0"), model).count() == 0
    empty = language.train(docs.filter("doc_id < 0"))
    assert {r.lang_rejected for r in language.identify_documents(docs, empty).collect()} == {True}


def toxic_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang, bad = r.choice("abc") * 2, r.random() < 0.2
        words = text(r, lang, r.randrange(5, 80)).split()
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), {"aa": "idiot", "bb": "lowe" + r.choice(SYLLABLES["bb"]), "cc": "vequ" + r.choice(SYLLABLES["cc"])}[lang])
        rows.append((i, " ".join(words), lang, "s", int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(2500, 1)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, each=400)
    out = toxicity.score(docs, model).withColumn("out", toxicity.held_out("doc_id")).collect()
    truth = {r[0]: r[4] for r in rows}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    own = [r for r in out if r.out]
    hits = sum(r.score >= 0.3 and truth[r.doc_id] for r in own)
    assert hits >= 0.95 * sum(truth[r.doc_id] for r in own) and hits >= 0.95 * sum(r.score >= 0.3 for r in own)
    assert all(0 <= r.score <= 1 and r.rejected == (r.score >= r.threshold) for r in out)


def test_toxicity_uses_the_text_alone(spark):
    rows = toxic_rows(300, 2)
    model = toxicity.fit([r[1] for r in rows], [r[4] for r in rows], [r[2] for r in rows], least_steps=20)
    df = spark.createDataFrame([(i, "idiot thing", lang, "x") for i, lang in enumerate(["aa", "bb", None, "zz"])], "doc_id long, text string, lang string, source string")
    assert len({r.score for r in toxicity.score(df, model).collect()}) == 1


def test_toxicity_odd_rows(spark):
    rows = toxic_rows(300, 3)
    model = toxicity.fit([r[1] for r in rows], [r[4] for r in rows], [r[2] for r in rows], least_steps=20)
    odd = [(1, None), (2, ""), (3, "."), (4, "word " * 60_000), (4, "a"), (None, "a")]
    out = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model, lang=None).collect()
    assert len(out) == 6 and out[0].score == out[1].score and all(0 <= r.score <= 1 for r in out)
    whole = model.scores(["er " * 50_000 + "idiot"])[0]
    assert whole == pytest.approx(model.scores(["er er er er er idiot"])[0], abs=1e-5)  # no prefix: the last word counts
    docs = spark.createDataFrame([(1, "a", "aa", "s")], "doc_id long, text string, lang string, source string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0]


def test_scoring_is_the_network():
    """The table form equals the convolution written out."""
    rows = toxic_rows(200, 4)
    model = toxicity.fit([r[1] for r in rows], [r[4] for r in rows], [r[2] for r in rows], least_steps=10)
    for x in [rows[0][1], rows[1][1], "", "one two"]:
        a, b, _ = toxicity.encode([x])
        e = (model.embedding[a] + model.embedding[b]).astype(float)
        pooled = [max((sum(e[i + o] @ f[o][:, k] for o in range(w))) for i in range(len(e) - w + 1)) for w, f in zip(toxicity.WIDTHS, model.filters) for k in range(toxicity.FILTERS)]
        z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.base
        assert model.scores([x])[0] == pytest.approx(1 / (1 + np.exp(-(model.scale * z + model.shift))), abs=1e-4)


def test_every_declared_language_is_a_class(spark):
    rows = [(i, chr(97 + i // 26) + chr(97 + i % 26) * 3, f"l{i:03}") for i in range(120)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == [f"l{i:03}" for i in range(120)]


def test_sample_has_the_least_hashes(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en" if i % 9 else "de") for i in range(3000)], "doc_id long, text string, lang string")
    df = df.union(df.filter("doc_id < 500").selectExpr("doc_id", "'s' || text", "lang"))  # a repeated id: its least text
    want = [(n, min("s" + r.text, r.text) if r.doc_id < 500 else r.text) for n in ("de", "en") for r in df.filter(f"lang = '{n}'").filter("text like 't%'").orderBy(F.xxhash64("doc_id")).limit(40).collect()]
    assert sorted((r.lang, r.text) for r in language.sample(df, 40, 10).collect()) == sorted(want)
    with pytest.raises(ValueError):
        language.sample(df, 40, 1)


def test_training_is_that_of_the_sample(spark, docs):
    rows = language.sample(docs, 40, 10).collect()
    model, want = language.train(docs, each=40), language.learn([r.text for r in rows], [r.lang for r in rows])
    assert model.names == want.names and np.allclose(model.logs, want.logs)


def test_long_words_and_texts():
    """What is read a piece at a time has the evidence of the whole."""
    model = language.learn(["der und die nicht haus", "the and house not with"], ["de", "en"])
    word = "undhausthewith" * 3000
    bare = language.grams(language.letters(word))
    assert model.evidence(word)[0] == pytest.approx(model.logs[bare].mean(axis=0)) and model.evidence(word)[1] == 1
    words = ["haus", "the", "und" * 200, "."] * 2000
    got, n = model.evidence(" ".join(words))
    assert n == 6000 and got == pytest.approx(sum(model.evidence(w)[0] for w in words[:4]) * 2000, rel=1e-4)
    assert list(language.runs("ab cd  ef", 3)) == ["ab cd", " ef"] and list(language.runs("", 3)) == [""]


NAMES = ["_host", "_declared", "_words", "_place", "_suffix", "_domain", "_text_logs", "_best", "_prior", "_rows", "_logs", "_d", "_s", "row", "text_", "TEXT2", "a.b"]


def test_clashing_names(spark, docs):
    """Extra columns of any names change nothing and come back, but for the names that are replaced."""
    model = language.learn(["der und die nicht haus", "the and house not with"], ["de", "en"])
    some = docs.filter("doc_id < 20")
    df = some.withColumns({n: F.lit(f"mine {n}") for n in [*NAMES, "lang_id", "score", "threshold"]})
    out = language.identify_documents(df, model).collect()
    want = language.identify_documents(some, model).collect()
    new = ["doc_id", "lang_id", "lang_confidence", "lang_words", "lang_text", "lang_rejected"]
    assert sorted([r[c] for c in new] for r in out) == sorted([r[c] for c in new] for r in want)
    assert all(r[n] == f"mine {n}" for r in out for n in [*NAMES, "score"])
    rows = toxic_rows(100, 3)
    small = toxicity.fit([r[1] for r in rows], [r[4] for r in rows], [r[2] for r in rows], least_steps=5)
    out = toxicity.score(df, small).collect()
    assert len(out) == 20 and all(r[n] == f"mine {n}" for r in out for n in [*NAMES, "lang_id"])
    assert sorted((r.doc_id, r.score) for r in out) == sorted((r.doc_id, r.score) for r in toxicity.score(some, small).collect())


def test_toxicity_sample_is_bounded(spark):
    rows = toxic_rows(300, 6)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    every = toxicity.sample(docs, labels, 1000, 1 << 40).collect()
    assert {r.doc_id for r in every} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2}
    few = toxicity.sample(docs, labels, 1000, 3000).collect()
    for t in (0, 1):
        own = sum(len(r.text.encode()) for r in few if r.toxic == t)
        assert 0 < own <= 3000
    assert len(toxicity.sample(docs, labels, 5, 1 << 40).collect()) == 10


def test_blocks_of_places(monkeypatch):
    """Filters that slide in small blocks find what they find in one go."""
    rows = toxic_rows(120, 8)
    model = toxicity.fit([r[1] for r in rows], [r[4] for r in rows], [r[2] for r in rows], least_steps=10)
    want = model.scores([r[1] for r in rows] + ["", "x"])
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(model.scores([r[1] for r in rows] + ["", "x"]), want)


@pytest.mark.parametrize("values", [260, 2100])
def test_rare_suffixes_keep_their_evidence(spark, values):
    model = language.learn(["der und die nicht haus", "the and house not with"], ["de", "en"])
    rows = [(i, t, f"s{i:04}") for i in range(values) for t in ["the and house"] * (3 if i else 2)]
    rows += [(values, "der und die", "zz")] * 2
    df = spark.createDataFrame(rows, "id long, text string, suffix string")
    none = F.lit(None).cast("string")
    got = language.identify(df, model, F.col("text"), none, F.col("suffix"), none, none, carry=["id", "suffix"])
    assert got.count() == len(rows)
    found = {r.suffix: r.lang_confidence for r in got.collect()}
    # zz speaks by its own two rows, not by those of all rare suffixes
    n, de, en = values + 1, 2.0, 3.0 * values - 1
    text = model.evidence("der und die")[0] * language.TRUST
    logs = [math.log(s * (c + 1) / (t + n + 1)) + x for s, c, t, x in zip([(de + 1) / (de + en + 2), (en + 1) / (de + en + 2)], [2, 0], [de, en], text)]
    assert found["zz"] == pytest.approx(1 / (1 + math.exp(-abs(logs[1] - logs[0]))), abs=2e-6)
