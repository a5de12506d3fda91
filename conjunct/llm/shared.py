"""What the operators share: reading tables, the shared folder, hot-key joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunct.session import ship

#: The name under which a text goes to Python; no column of a caller is called so.
TEXT = "__conjunct_text"
#: ASCII white space as the contracts name it, for Java and Python patterns alike.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="conjunct-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, where: str) -> None:
    """Delete a table that materialize() wrote."""
    try:
        path, fs = _path(spark, where)
        fs.delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone: the folder's owner clears it
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so lost executors cost no recomputation.

    The folder is removed at exit, or earlier through forget(spark, df.written_to).
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/conjunct-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.written_to = where
    atexit.register(forget, spark, where)
    return out


def rest(spark: SparkSession) -> None:
    """Executors collect their garbage, upon which a JVM gives back the heap it has no use for; without that a heap stays as
    large as the greediest step so far made it. One short task for each core; results don't depend on it."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def utf8(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def boxed(df: DataFrame, columns: list[str] | None = None, **own: Column) -> DataFrame:
    """df's columns (all, or those named) in one struct `row`, beside the operator's own columns: so no names clash."""
    names = df.columns if columns is None else columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(True).alias("none"))
    return df.select(row.alias("row"), *[c.alias(n) for n, c in own.items()])


def unboxed(names: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a boxed row again, but for those that an operator replaces (names differ by more than case)."""
    gone = {n.lower() for n in without}
    return [F.col("row").getField(c).alias(c) for c in names if c.lower() not in gone]


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 2000) -> DataFrame:
    """Inner join on a key that is unique in right, safe for keys that hold a large part of left.

    right has in `weight` how many rows of left carry the key, so at most `share` of its rows can reach total/share:
    those are broadcast (share bounds them whatever the input), the rest join by shuffle with no key above total/share.
    """
    least = max(2, -(-total // share))
    hot, cold = right.filter(F.col(weight) >= least), right.filter(F.col(weight) < least)
    keys = hot.select(key, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(keys), key, "left")
    few = marked.filter(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key)
    many = marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold, key)
    return few.unionByName(many)


def whole_text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before texts go to Python: the workers get this package, and Arrow batches at most `rows` rows, for texts are whole."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
