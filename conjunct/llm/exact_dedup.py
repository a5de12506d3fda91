"""Exact deduplication by two passes over a Bloom filter of repeated hashes; DataFrame functions only.

Pass one counts the slots that the hashes of all texts fall into, each task its own slots first, and keeps a bit for each
slot met more than once. Pass two tests every row: a row whose slot isn't marked is alone and goes straight through; only
the others shuffle. The filter has one hash function over SLOTS slots a row, however many rows there are, and is held
sparsely: 64-bit words without a marked slot don't exist. So its size follows the repeated texts and not the table. It is
broadcast if it has at most `most` words; a larger one is joined by shuffle, with the rows' ids and hashes, not their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunct.llm.shared import BLANKS, boxed, join_hot, materialize, unboxed, utf8

#: Slots of the filter for each row (a text that is alone passes once in so many), and the least number of slots.
SLOTS, LEAST = 1024, 1 << 20
#: Words of the largest filter that is broadcast: 16 bytes each.
MOST = 1 << 20


def text_key(text: Column) -> Column:
    """SHA-256, in lowercase hex, of a text with each run of ASCII white space made one space; null counts as empty."""
    return F.sha2(F.regexp_replace(utf8(text), BLANKS, " "), 256)


def _slot(key: Column, slots: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(slots - 1))


def slots_for(rows: int) -> int:
    """A power of two, 2**62 at most."""
    return min(1 << 62, max(LEAST, 1 << (SLOTS * rows).bit_length()))


def slot_filter(keys: DataFrame, key: str, slots: int, least: int = 2) -> DataFrame:
    """(word, bits): the filter's 64-bit words that have a slot met at least so often, written to the shared folder."""
    met = keys.groupBy(_slot(F.col(key), slots).alias("slot")).count()
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return materialize(met.filter(F.col("count") >= least).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "filter")


def maybe_repeated(rows: DataFrame, key: str, marked: DataFrame, slots: int, most: int = MOST) -> DataFrame:
    """rows with boolean _maybe: whether the slot of the row's key is marked. rows have no columns _slot, _word and bits."""
    rows = rows.withColumn("_slot", _slot(F.col(key), slots)).withColumn("_word", F.shiftright("_slot", 6))
    words = marked.select(F.col("word").alias("_word"), "bits")
    rows = rows.join(F.broadcast(words) if marked.count() <= most else words, "_word", "left")
    rows = rows.withColumn("_maybe", F.expr("(coalesce(bits, 0L) & shiftleft(1L, cast(_slot & 63 as int))) != 0"))
    return rows.drop("_slot", "_word", "bits")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (white space runs count as one space, null as empty) the smallest id is kept. Rows that
    repeat both id and text are reported each, all with the same kept. Null ids come after all others; a group of null
    ids alone keeps them all. Texts of any length are hashed whole. An empty table gives no rows; other columns of df,
    whatever their names, are ignored.
    """
    return _decided(df, id_col, text, most)[0].drop("_maybe")


def _decided(df: DataFrame, id_col: str, text: str, most: int) -> tuple[DataFrame, DataFrame, int]:
    keys = materialize(df.select(F.col(id_col).alias("doc_id"), text_key(F.col(text)).alias("text_sha256")), "dedup")
    total = keys.count()
    slots = slots_for(total)
    marked = slot_filter(keys, "text_sha256", slots)
    rows = maybe_repeated(keys, "text_sha256", marked, slots, most)
    alone = rows.filter("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256", "_maybe")
    shared = rows.filter("_maybe")
    groups = shared.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = join_hot(shared, groups, "text_sha256", "group_size", total).select(*alone.columns)
    out = alone.unionByName(joined).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "_maybe"), marked, slots


def drop_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The rows of df that exact_groups keeps, with their columns; rows that repeat id and text leave one.

    Rows that the filter passes over are never shuffled (while the filter is broadcast); the others meet the list of kept
    ids. Which of the rows that repeat id and text stays is not defined where their other columns differ.
    """
    decided, marked, slots = _decided(df, id_col, text, most)
    rows = maybe_repeated(boxed(df, None, _id=F.col(id_col), _key=text_key(F.col(text))), "_key", marked, slots, most)
    kept = decided.filter("_maybe and kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha")).distinct()
    maybe = rows.filter("_maybe").dropDuplicates(["_id", "_key"])
    found = maybe.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_key") == F.col("_sha")), "left_semi")
    return rows.filter("not _maybe").unionByName(found).select(*unboxed(df.columns))


def without(df: DataFrame, keys: dict[str, Column], dropped: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of df whose keys (name -> expression) aren't among the rows of dropped, which has columns of these names.

    Nulls equal nulls. Only rows that a filter of the dropped keys passes shuffle. Columns of df may have any names.
    """
    names = list(keys)
    slots = slots_for(dropped.count())
    hashed = dropped.select(F.xxhash64(*names).alias("_hash"))
    marked = slot_filter(hashed, "_hash", slots, 1)
    rows = boxed(df, None, **{f"_{n}": c for n, c in keys.items()})
    rows = maybe_repeated(rows.withColumn("_hash", F.xxhash64(*[f"_{n}" for n in names])), "_hash", marked, slots, most)
    maybe = rows.filter("_maybe")
    same = [F.col(f"_{n}").eqNullSafe(F.col(n)) for n in names]
    left = maybe.join(dropped, same, "left_anti")
    return rows.filter("not _maybe").unionByName(left).select(*unboxed(df.columns))


SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), g as (
  select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256 from t join g using (text_sha256)
"""
