"""Language identification by Bayesian fusion of evidence.

Four sources speak about the language of a text: the text itself (a naive Bayes model over hashed letter n-grams, with a
class `und` for what no language explains), the language its markup declares, the suffix of its address, and its host.
What a declaration or a suffix is worth, and what a host tends to, is counted over all rows by grouped aggregation; host
priors are smoothed towards their domain's, and those towards the corpus's.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from conjunct.llm.shared import boxed, join_hot, materialize, unboxed, utf8, whole_text_batches
from conjunct.llm.units import claim, held, runs

UND = "und"
ROWS = 1 << 14
#: Words count for less than they say, for they aren't independent; so much of the sum of their logarithms is believed.
TRUST = 0.25
#: Pseudo-counts with which a host follows its domain and a domain the corpus; and of the tables of declarations.
HOST, DOMAIN, TABLE = 8.0, 32.0, 1.0
#: Words that a worker remembers, and the letters of the longest of them; longer ones are read a piece at a time.
WORDS, LONG = 400_000, 256


def grams(word: str, start: int = 0, stop: int | None = None) -> list[int]:
    """Hash rows of the 1- to 4-letter runs of a word (with its ends marked) that begin from `start` to before `stop`."""
    stop = len(word) if stop is None else stop
    return [zlib.crc32(word[i : i + n].encode()) % ROWS for n in (1, 2, 3, 4) for i in range(start, min(stop, len(word) - n + 1))]


def letters(word: str) -> str:
    """The letters of a word between two marks of its ends; nothing where there are none."""
    bare = "".join([c for c in word if c.isalpha()])
    return f"<{bare}>" if bare else ""


class Languages:
    """Log-likelihoods of words under each language, less that of the class `und` (all n-grams alike)."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, np.ascontiguousarray(logs, dtype=np.float64)
        self.at: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.at.clear()
        self.at[""] = 0
        self.values = np.zeros((1 << 16, len(self.names)), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Mean n-gram log-likelihood ratio of each word to `und`, in one go; words without letters have 0."""
        first = len(self.at)
        while first + len(words) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        rows, spots, sizes = [], [], []
        for i, w in enumerate(words):
            self.at[w] = first + i
            if bare := letters(w):
                own = grams(bare)
                spots.append(first + i)
                sizes.append(len(own))
                rows += own
        if rows:
            ends = np.cumsum(sizes)
            sums = np.add.reduceat(self.logs[rows], np.concatenate([[0], ends[:-1]]), axis=0)
            self.values[spots] = sums / np.asarray(sizes)[:, None]

    def _long(self, word: str) -> np.ndarray:
        """What _learn has for a word, for one too long to remember: its n-grams are taken a piece at a time."""
        bare, total, n = letters(word), np.zeros(len(self.names)), 0
        for start in range(0, len(bare), 4096):
            own = grams(bare, start, start + 4096)
            total += self.logs[own].sum(axis=0)
            n += len(own)
        return total / n if n else total

    def evidence(self, text: str | None) -> tuple[np.ndarray, int]:
        """Sum over the words of their mean n-gram log-likelihood ratio to `und`, and the number of words with letters."""
        total, n = np.zeros(len(self.names)), 0
        for part in runs(text or ""):
            words = part.lower().split()
            if len(part) > LONG and any(len(w) > LONG for w in words):
                for v in (self._long(w) for w in words if len(w) > LONG):
                    total += v
                    n += bool(v.any())
                words = [w for w in words if len(w) <= LONG]
            if not words:
                continue
            if len(self.at) > WORDS:
                self._reset()
            known = self.at
            if new := set(words).difference(known):
                self._learn(sorted(new))
            v = self.values[list(map(known.__getitem__, words))]
            total += v.sum(axis=0, dtype=np.float64)
            n += int(v.any(axis=1).sum())
        return total, n


_MODELS: dict[str, Languages] = {}
held("language", _MODELS)


def opened(mark: str, names: list[str], logs: np.ndarray) -> Languages:
    """A model with its cache of words, kept in the Python worker for the tasks that follow; the latest model only."""
    claim("language")
    if mark not in _MODELS:
        _MODELS.clear()
        _MODELS[mark] = Languages(names, logs)
    return _MODELS[mark]


def tally(counts: dict[str, np.ndarray], texts: list[str | None], langs: list[str], memo: dict[str, list[int]]) -> None:
    """Add the n-grams of texts to the counts of their languages; memo remembers short words."""
    for x, lang in zip(texts, langs, strict=True):
        own = counts.setdefault(lang, np.zeros(ROWS, np.int64))
        for part in runs(x or ""):
            for w in part.lower().split():
                if len(w) > LONG:
                    bare = letters(w)
                    for start in range(0, len(bare), 4096):
                        np.add.at(own, grams(bare, start, start + 4096), 1)
                    continue
                if w not in memo:
                    if len(memo) > WORDS:
                        memo.clear()
                    memo[w] = grams(b) if (b := letters(w)) else []
                np.add.at(own, memo[w], 1)


def fitted(counts: dict[str, np.ndarray]) -> Languages:
    """n-gram frequencies by language, with one added to each count."""
    names = sorted(counts)
    if not names:
        return Languages([], np.zeros((ROWS, 0)))
    n = np.stack([counts[x] for x in names]) + 1.0
    return Languages(names, np.log(n / n.sum(axis=1, keepdims=True) * ROWS).T)


def learn(texts: list[str | None], langs: list[str]) -> Languages:
    """A model of texts that are at hand."""
    counts: dict[str, np.ndarray] = {}
    tally(counts, texts, langs, {})
    return fitted(counts)


def sample(docs: DataFrame, each: int, classes: int) -> DataFrame:
    """(doc_id, lang, text) of a bounded sample: of every declared language the `each` ids of the least hashes.

    Where an id repeats with a language, its least text counts. More than `classes` languages are an error: the model,
    which goes to every worker, has a row of numbers for each.
    """
    held = docs.filter("lang is not null and text is not null and doc_id is not null")
    ids = held.select("doc_id", "lang").distinct().withColumn("_hash", F.xxhash64("doc_id")).withColumn("_range", F.shiftright("_hash", 52))
    # ranges of hashes up to the one in which a language reaches `each`; only their ids are ranked
    sizes = ids.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = materialize(sizes.withColumn("_before", before).filter(F.col("_before") < each).select("lang", "_range"), "ranges")
    if (found := near.select("lang").distinct().count()) > classes:
        raise ValueError(f"{found} declared languages are more than classes={classes}")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    # at most 4096 ranges, and then `each` ids, of at most `classes` languages
    ids = ids.join(F.broadcast(near), ["lang", "_range"]).withColumn("_place", place).filter(F.col("_place") <= each).select("doc_id", "lang")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, each: int = 400, classes: int = 1000) -> Languages:
    """Fit on a bounded sample() of docs. n-grams are counted on the executors: languages x ROWS numbers reach the driver."""
    whole_text_batches(docs.sparkSession)

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        memo: dict[str, list[int]] = {}
        for b in batches:
            tally(counts, b.column("text").to_pylist(), b.column("lang").to_pylist(), memo)
        for lang, n in counts.items():
            at = np.append(np.flatnonzero(n), 0)  # a language whose texts have no letters is a class too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.append(n[at[:-1]], 0), pa.int64())], ["lang", "at", "n"])

    sums = sample(docs, each, classes).mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    langs, at, n = sums["lang"].to_numpy(), sums["at"].to_numpy(), sums["n"].to_numpy()
    for lang in set(langs.tolist()):
        counts[lang] = np.zeros(ROWS, np.int64)
        counts[lang][at[langs == lang]] = n[langs == lang]
    return fitted(counts)


def identify(df: DataFrame, model: Languages, text: Column, declared: Column, suffix: Column, host: Column, domain: Column, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """df (of its columns those in carry, all by default) with lang_id, lang_confidence, lang_words, lang_text (the text's own best) and lang_rejected.

    lang_rejected: the text has no word with letters, `und` explains it better than any language, or no language reaches
    the confidence `least`. Such rows get the most probable class all the same (and where only und is left). Declarations,
    suffixes and hosts may be null and then say nothing. Null texts count as empty; texts of any length count whole, a
    piece at a time. Equal rows get equal results; an empty table gives none. Columns of df may have any names; those with
    the new names are replaced. Texts don't shuffle: their evidence is written once, with the other columns.
    """
    names, size = model.names, len(model.names)
    new = ("lang_id", "lang_confidence", "lang_words", "lang_text", "lang_rejected")
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    if not names:
        nothing = {"lang_id": F.lit(UND), "lang_confidence": F.lit(1.0), "lang_words": F.lit(0).cast("long"), "lang_text": F.lit(UND), "lang_rejected": F.lit(True)}
        return df.select(*[F.col(f"`{c}`") for c in kept]).withColumns(nothing)
    mark = hashlib.sha256(repr(names).encode() + model.logs.tobytes()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((mark, names, model.logs))
    whole_text_batches(df.sparkSession)
    shown = boxed(df, kept, text=utf8(text), _declared=declared, _suffix=suffix, _host=host, _domain=domain).select("text", "row", "_declared", "_suffix", "_host", "_domain")

    def run(batches):
        own = opened(*shared.value)
        for b in batches:
            found = [own.evidence(x.as_py()) for x in b.column(0)]
            cols = [pa.array([e.tolist() for e, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], [*b.schema.names[1:], "_text_logs", "_words"])

    schema = shown.drop("text").schema.add("_text_logs", ArrayType(DoubleType())).add("_words", "long")
    rows = shown.mapInArrow(run, schema)
    # the text's own opinion: index of the best language, size for und
    top = F.array_max("_text_logs")
    rows = rows.withColumn("_best", F.when(top > 0, F.array_position("_text_logs", top).cast("int") - 1).otherwise(F.lit(size)))
    rows = materialize(rows, "language")
    shared.destroy()

    counts = [F.sum((F.col("_best") == i).cast("double")).alias(f"n{i}") for i in range(size)]

    def looked_up(left: DataFrame, key: str, name: str, pseudo: float, few: int = 2000) -> DataFrame:
        """left with log P(value | language) of the declaration or suffix in key; nulls say nothing. Every value counts."""
        values = materialize(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_with"), *counts), "values")
        n = [F.col(f"n{i}") for i in range(size)]
        heard = F.count_if(sum(n[1:], n[0]) > 0)
        sums = values.agg(F.count(F.lit(1)).alias("values"), heard.alias("heard"), F.sum("_with").alias("with"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(size)]).first()
        # one more value stands for those that no language explains
        total = [(sums[f"n{i}"] or 0.0) + pseudo * (sums["heard"] + 1) for i in range(size)]
        logs = values.select(key, "_with", F.array(*[F.ln((n[i] + pseudo) / total[i]) for i in range(size)]).alias(name))
        nothing = F.array(*[F.lit(0.0)] * size)
        if sums["values"] <= few:
            return left.join(F.broadcast(logs.drop("_with")), key, "left").withColumn(name, F.coalesce(name, nothing))
        said = join_hot(left.filter(F.col(key).isNotNull()), logs, key, "_with", sums["with"]).drop("_with")
        return materialize(said.unionByName(left.filter(F.col(key).isNull()).withColumn(name, nothing)), "said")

    # priors: corpus, domain, host, each smoothed towards the one before
    corpus = rows.agg(F.count(F.lit(1)).alias("all"), *counts).first()
    total = corpus["all"]
    share = np.array([(corpus[f"n{i}"] or 0) + 1.0 for i in range(size)])
    share = share / share.sum()
    summed = [F.sum(f"n{i}").alias(f"n{i}") for i in range(size)]
    by_host = materialize(rows.filter("_host is not null").groupBy("_host", "_domain").agg(F.count(F.lit(1)).alias("rows"), *counts), "hosts")
    by_domain = by_host.groupBy("_domain").agg(F.count(F.lit(1)).alias("hosts"), *summed)
    smooth = lambda n, pseudo, prior: [(n[i] + pseudo * prior[i]) / (sum(n[1:], n[0]) + pseudo) for i in range(size)]
    domain_prior = smooth([F.col(f"n{i}") for i in range(size)], DOMAIN, [F.lit(float(x)) for x in share])
    by_domain = materialize(by_domain.select("_domain", "hosts", F.array(*domain_prior).alias("_domain_prior")), "domains")
    n_hosts = by_host.count()
    known = by_host.filter("_domain is not null")
    joined = join_hot(known, by_domain.filter("_domain is not null"), "_domain", "hosts", n_hosts)
    bare = by_host.filter("_domain is null").withColumn("hosts", F.lit(1).cast("long")).withColumn("_domain_prior", F.array(*[F.lit(float(x)) for x in share]))
    hosts = joined.unionByName(bare)
    host_prior = F.array(*smooth([F.col(f"n{i}") for i in range(size)], HOST, [F.get("_domain_prior", i) for i in range(size)]))
    hosts = hosts.select(F.xxhash64("_host", "_domain").alias("_place"), "rows", host_prior.alias("_prior"))
    hosts = materialize(hosts.groupBy("_place").agg(F.sum("rows").alias("_rows"), F.max("_prior").alias("_prior")), "priors")

    spoken = looked_up(looked_up(rows, "_declared", "_d", TABLE), "_suffix", "_s", TABLE)
    placed = spoken.withColumn("_place", F.xxhash64("_host", "_domain"))
    with_host = join_hot(placed.filter("_host is not null"), hosts, "_place", "_rows", total)
    without = placed.filter("_host is null").withColumn("_rows", F.lit(0).cast("long")).withColumn("_prior", F.array(*[F.lit(float(x)) for x in share]))
    fused = with_host.unionByName(without)
    logs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.ln(F.get("_prior", i)) + F.get("_d", i) + F.get("_s", i) + TRUST * F.get("_text_logs", i))
    fused = fused.withColumn("_logs", F.explode_outer(F.array(logs)))
    most = F.array_max("_logs")
    confidence = 1 / F.aggregate("_logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
    named = F.get(F.array(*[F.lit(n) for n in names]), F.array_position("_logs", most).cast("int") - 1)
    own = F.get(F.array(*[F.lit(n) for n in [*names, UND]]), F.col("_best"))
    out = fused.withColumn("lang_id", F.when(F.col("_best") == size, F.lit(UND)).otherwise(named)).withColumn("lang_confidence", F.round(confidence, 6))
    out = out.withColumn("lang_words", F.col("_words")).withColumn("lang_text", own)
    rejected = (F.col("_words") == 0) | (F.col("_best") == size) | (F.col("lang_confidence") < least)
    return out.withColumn("lang_rejected", rejected).select(*unboxed(kept), *new)


def identify_documents(docs: DataFrame, model: Languages, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """identify() of rows of `documents`: lang is the declaration, source the host; they have no address."""
    none = F.lit(None).cast("string")
    return identify(docs, model, F.col("text"), F.col("lang"), none, F.col("source"), none, least, carry)


def page_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles and tags; entities become blanks."""
    bare = F.regexp_replace(utf8(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w+;", " ")


def identify_pages(pages: DataFrame, model: Languages, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """identify() of rows of `pages`: declaration, suffix, host and domain come from the markup and the address."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(utf8(F.col("html")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    suffix = F.nullif(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), F.lit(""))
    domain = F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))
    return identify(pages, model, page_text(F.col("html")), declared, suffix, host, domain, least, carry)
