"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the token counts of the corpus's most frequent pre-tokens, tier two a cache in each Python
worker that encodes what the table lacks. Neither texts nor pre-tokens are shuffled: each task counts the pre-tokens of all
its rows and reports its most frequent ones straight to the driver, which makes the table. All reports together have
`reports` entries at most (but FEW a task), however many tasks there are; they change how fast counts come, never the counts.

A byte-level tokenizer merges nothing across pre-tokens, so a text's count is the sum over its pre-tokens. These are found
here with the pattern of byte-level tokenizers; a text with a character outside PLAIN, whose class may differ between
Unicode versions, or with one of the tokenizer's special strings goes to the library as a whole.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunct.llm.shared import boxed, unboxed, whole_text_batches
from conjunct.llm.units import CACHED_LENGTH, cache, opened, slices

#: Fixed value: the pattern of pre-tokens of byte-level tokenizers.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters of settled classes: ASCII, Latin, Greek, Cyrillic, punctuation, kana, ideographs, Hangul syllables.
PLAIN = re.compile(r"[\t-\r -~\xa0-\u024f\u0388-\u038a\u038e-\u03a1\u03a3-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*+")
#: All characters of PLAIN.
_CHARS = "".join(c for c in map(chr, range(0xD800)) if PLAIN.fullmatch(c))
#: Entries that a task may always report.
FEW = 8


def _ranges(kind: str) -> str:
    """The characters of PLAIN that are of a kind, as the inside of a set in a pattern."""
    runs: list[list[int]] = []
    for c in map(ord, regex.findall(kind, _CHARS)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


_L, _N, _S, _O = map(_ranges, (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"))
#: PRETOKEN for texts of PLAIN characters, whose kinds are spelt out: the same pre-tokens in less than half the time.
PLAIN_PRETOKEN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]++| ?[{_N}]++| ?[{_O}]++|[{_S}]+(?![^{_S}])|[{_S}]++")


def _lengths(path: str):
    tok = opened("tokenizers", path)
    return lambda units: [len(e.ids) for e in tok.encode_batch_fast(units, add_special_tokens=False)]


def _specials(path: str) -> list[str]:
    return [t.content for t in opened("tokenizers", path).get_added_tokens_decoder().values()]


def _byte_level(path: str) -> bool:
    """Whether the tokenizer is byte-level with PRETOKEN and nothing else before its merges."""
    spec = json.loads(opened("tokenizers", path).to_str())
    pre = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def pretokens(text: str, chars: int = 1_000_000):
    """Lists of a text's pre-tokens in order: one list, or for a long text several."""
    pattern = PLAIN_PRETOKEN if PLAIN.fullmatch(text) else PRETOKEN
    if len(text) <= chars:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m.group() for m in itertools.islice(found, chars // 10)]:
        yield part


def frequent_pretokens(df: DataFrame, text: str, entries: int, reports: int) -> list[str]:
    """The most frequent pre-tokens by the reports of all tasks; a task counts all its rows, and prunes its counter when it
    is 16 times as large as its report."""
    whole_text_batches(df.sparkSession)
    tasks = (df.select(F.spark_partition_id().alias("at")).agg(F.max("at").alias("last")).first()["last"] or 0) + 1
    each = max(FEW, min(entries // 2, reports // tasks))

    def tally(batches):
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                if x and PLAIN.fullmatch(x):
                    for part in pretokens(x):
                        seen.update(part)
                        if len(seen) > max(1 << 16, 16 * each):
                            seen = Counter(dict(seen.most_common(each)))
        top = [(u, n) for u, n in seen.most_common(each) if n > 1 and len(u) <= CACHED_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    told = df.select(F.col(f"`{text}`")).mapInArrow(tally, "unit string, n long").toArrow()
    sums = told.group_by("unit").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("unit", "ascending")])
    return sums["unit"].slice(0, entries).to_pylist()


def table_of(units: list[str], lengths: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Pre-tokens and their token counts in three arrays: all characters in UTF-8, where each pre-token ends, its count."""
    data = [u.encode() for u in units]
    return b"".join(data), np.cumsum([len(d) for d in data], dtype=np.uint32), np.asarray(lengths, np.uint16)


def opened_table(blob: bytes, ends: np.ndarray, lengths: np.ndarray) -> dict[str, int]:
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64).tolist()
    return {blob[i:j].decode(): n for i, j, n in zip(starts, ends.tolist(), lengths.tolist())}


def token_counts(df: DataFrame, text: str, tokenizer: str, limit: int = 512, entries: int = 32_768, reports: int = 1 << 19) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit; other columns stay.

    Counts are those of the tokenizers library without added special tokens; special strings inside a text are taken as
    the library takes them. Null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; repeated
    rows are counted each; an empty table gives no rows. Columns of df may have any names; those that are called like the
    three new ones are replaced.
    """
    spark = df.sparkSession
    whole_text_batches(spark)
    cuttable = _byte_level(tokenizer)
    units = frequent_pretokens(df, text, entries, reports) if cuttable else []
    frequent = spark.sparkContext.broadcast((hash(tuple(units)), table_of(units, _lengths(tokenizer)(units) if units else [])))

    def count(batches):
        tok, specials = opened("tokenizers", tokenizer), _specials(tokenizer)
        mark, table = frequent.value
        lengths = cache(("lengths", tokenizer), _lengths(tokenizer), mark, lambda: opened_table(*table))

        def long(x: str) -> int:
            n = 0
            for part in pretokens(x):
                lengths.learn(set(part))
                n += sum(map(lengths.__getitem__, part))
            return n

        def counts(texts):
            cut = [None if not x or not cuttable or len(x) > 1_000_000 or not PLAIN.fullmatch(x) or any(s in x for s in specials) else PLAIN_PRETOKEN.findall(x) for x in texts]
            lengths.learn({u for c in cut if c for u in c})
            out = []
            for x, c in zip(texts, cut, strict=True):
                if c is not None:
                    out.append(sum(map(lengths.__getitem__, c)))
                elif x and cuttable and len(x) > 1_000_000 and PLAIN.fullmatch(x) and not any(s in x for s in specials):
                    out.append(long(x))
                else:
                    out.append(len(tok.encode(x, add_special_tokens=False).ids) if x else 0)
            return out

        for b in batches:
            texts = b.column(0).to_pylist()
            n = [m for i, j in slices(texts) for m in counts(texts[i:j])]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], [*b.schema.names[1:], "n_tokens"])

    new = ("n_bytes", "n_tokens", "over_limit")
    own = F.col(f"`{text}`")
    kept = boxed(df, None, text=own, n_bytes=F.coalesce(F.octet_length(own), F.lit(0)).cast("long")).select("text", "row", "n_bytes")
    counted = kept.mapInArrow(count, kept.drop("text").schema.add("n_tokens", "long")).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.select(*unboxed(df.columns, new), *new)
