"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet and rereads it as the next one's docs. All but the last return the columns of documents. Each begins with rest(),
for executors keep their heaps from stage to stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunct.llm import exact_dedup, language, near_dups, packing, toxicity
from conjunct.llm.shared import boxed, join_hot, materialize, rest, table, unboxed, utf8

#: Packing's workers remember less here than alone, for the executor beside them has grown in four stages.
REMEMBERED = 200_000, 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a word, and those whose language can't be told.

    Null texts count as empty and go; null ids stay; rows that repeat are judged each; texts are read whole, whatever their
    length; an empty table stays empty; further columns of docs stay, whatever their names.
    """
    rest(spark)
    held = (utf8(F.col("text")), F.col("lang"), F.col("source"))  # all that a decision depends on
    key = {"one": F.xxhash64(F.lit(1), *held), "two": F.xxhash64(F.lit(2), *held)}
    rows = docs.select("text", "lang", "source", *[c.alias(n) for n, c in key.items()])
    found = language.identify_documents(rows, language.train(docs), carry=list(key))
    rejected = materialize(found.filter("lang_rejected").select(*key).distinct(), "rejected")
    return exact_dedup.without(docs, key, rejected)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold of their language; trained on a bounded sample of labelled rows of docs.

    Null texts count as empty; rows that repeat are scored each, whole; without labelled rows nothing goes; an empty table
    stays empty; further columns of docs stay, whatever their names.
    """
    rest(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = boxed(docs, None, text=F.col("text"), lang=F.col("lang"))
    return toxicity.score(rows, model, carry=["row"]).filter(~F.col("rejected")).select(*unboxed(docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (runs of white space count as one space, null as empty) the row with the smallest doc_id.

    Null ids come last, and a group of null ids keeps one row; so does one that repeats its id. An empty table stays empty.
    """
    rest(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates (five words, similarity 0.8) the document with the smallest doc_id.

    Null ids come last; of documents that share the smallest id, the one whose text hashes least stays, with the rows that
    repeat both. Documents without words, null texts among them, stay. An empty table stays empty.
    """
    rest(spark)
    classes = near_dups.jaccard_classes(docs, k=5, percent=80).filter("class_key is not null")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    best = classes.groupBy("class_key").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("best")).filter("rows > 1")
    held = join_hot(classes, best, "class_key", "rows", classes.count())
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    dropped = materialize(held.filter(~stays).select("doc_id", "text_key").distinct(), "dropped")
    return exact_dedup.without(docs, {"doc_id": F.col("doc_id").cast("long"), "text_key": F.xxhash64(utf8(F.col("text")))}, dropped)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens.

    Null and empty texts are an end id alone; null ids stay null; rows that repeat are packed each; whole texts of any
    length are cut into pieces; an empty table has none; further columns of docs are ignored.
    """
    rest(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("exact_dedup", exact_copies), ("near_duplicates", near_copies), ("packing", packed)]

#: Trained and iterative stages have no SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
