"""Transactions from relational tables, and the study's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One transaction per line of a dataset file.
TRANSACTIONS = T.StructType([T.StructField("tid", T.LongType()), T.StructField("items", T.ArrayType(T.IntegerType())), T.StructField("y", T.DoubleType())])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, item), distinct: per order its parts' brands and its customer's nation, region and priority."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_partkey").alias("p_partkey")).distinct()
    brands = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select("tid", F.concat(F.lit("B:"), "p_brand").alias("item"))
    places = (
        read(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("tid"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
        .join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
        .join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
        .join(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")
    )
    traits = F.array(F.concat(F.lit("N:"), "n_name"), F.concat(F.lit("R:"), "r_name"), F.concat(F.lit("P:"), "o_orderpriority"))
    of_orders = places.select("tid", F.explode(traits).alias("item")).join(lines.select("tid").distinct(), "tid", "left_semi")
    return brands.unionByName(of_orders).distinct()


def basket_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, y): summed quantity of each order that has lines."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tid")).agg(F.sum("l_quantity").alias("y"))


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document."""
    return spark.read.json(path, multiLine=True)


def scan_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(tid, items, y, role) of a dataset file with transactions, y, train_indices and test_indices."""
    doc = scan_json(spark, path)
    rows = doc.select(F.posexplode(F.arrays_zip("transactions", "y")).alias("tid", "r"), "train_indices")
    role = F.when(F.array_contains("train_indices", F.col("tid").cast("long")), "train").otherwise("test")
    items = F.array_sort(F.array_distinct(F.col("r.transactions").cast("array<int>")))
    return rows.select(F.col("tid").cast("long").alias("tid"), items.alias("items"), F.col("r.y").cast("double").alias("y"), role.alias("role"))


def scan_folds(spark: SparkSession, path: str) -> DataFrame:
    """(row, fold, role) of a fold file: folds is a list of [fit, validation] index lists."""
    folds = scan_json(spark, path).select(F.posexplode("folds").alias("fold", "pair"))
    return folds.select("fold", F.posexplode("pair").alias("role", "rows")).select(
        F.explode("rows").alias("row"), "fold", F.when(F.col("role") == 0, "fit").otherwise("validation").alias("role")
    )


def scan_tsv(spark: SparkSession, path: str, positions: int, rows: int | None = None) -> DataFrame:
    """Strict reader of a resistance table: P1..Pn must be contiguous and the row count as pinned."""
    df = spark.read.csv(path, sep="\t", header=True)
    found = [c for c in df.columns if c[:1] == "P" and c[1:].isdigit()]
    if found != [f"P{i}" for i in range(1, positions + 1)]:
        raise ValueError("position columns must be P1..P%d in order" % positions)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return df


def scan_tsv_lenient(spark: SparkSession, path: str, numbers: list[str] = ()) -> DataFrame:
    """Rows of too few fields are dropped; what isn't a number in the named columns becomes NaN."""
    df = spark.read.csv(path, sep="\t", header=True, mode="DROPMALFORMED", enforceSchema=True)
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float("nan"))) for c in numbers})


def checked_files(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(path, problem) of the files of manifest(path, sha256) under root that are missing or changed; none if all is well."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    own = found.select(F.replace(prefix, F.lit(base), F.lit("")).alias("path"), F.sha2("content", 256).alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return manifest.join(own, "path", "left").select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def archived_points(spark: SparkSession, path: str, sha256: str, rows: int) -> DataFrame:
    """Rows of an archived CSV whose digest and number of rows must be those on record."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if digest != sha256:
        raise ValueError(f"{path} has changed")
    df = scan_csv(spark, path)
    if (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def saved_points(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Points (JSON lines) of a run, all of whose files must be as its manifest(path, sha256) says."""
    bad = checked_files(spark, manifest, root).limit(5).collect()
    if bad:
        raise ValueError("changed run: " + ", ".join(f"{r['path']} {r['problem']}" for r in bad))
    files = [f"{root.rstrip('/')}/{r['path']}" for r in manifest.select("path").collect()]  # a run's own files
    return spark.read.json(files)


def contained(root: str, path: str) -> str:
    """path under root, or an error if it would leave it."""
    import posixpath

    whole = posixpath.normpath(posixpath.join(root, path))
    if whole != posixpath.normpath(root) and not whole.startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"{path} leaves {root}")
    return whole


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def scan_miner_output(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(itemset, support, tids) of a miner's records of two lines: `items (support)` and the transaction ids. Wrong records raise."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\n+$", ""), "\n")).alias("at", "line"))
    head = lines.filter("at % 2 = 0").select(F.expr("at div 2").alias("k"), F.col("line").alias("head"))
    tail = lines.filter("at % 2 = 1").select(F.expr("at div 2").alias("k"), F.col("line").alias("tail"))
    ints = lambda c: F.transform(F.filter(F.split(F.trim(c), " +"), lambda x: x != ""), lambda x: x.cast("int"))
    rows = head.join(tail, "k", "left").select(
        "k",
        F.array_sort(ints(F.regexp_extract("head", r"^(.*)\((\d+)\)\s*$", 1))).alias("itemset"),
        F.regexp_extract("head", r"\((\d+)\)\s*$", 1).cast("int").alias("support"),
        F.array_sort(ints(F.coalesce("tail", F.lit("")))).alias("tids"),
    )
    wrong = (F.size("tids") != F.col("support")) | (F.size(F.array_distinct("tids")) != F.size("tids")) | F.exists("tids", lambda t: (t < 0) | (t >= n))
    return rows.withColumn("support", F.when(wrong, F.raise_error(F.concat(F.lit("wrong record "), F.col("k").cast("string"))).cast("int")).otherwise(F.col("support"))).drop("k")


def write_once(df: DataFrame, path: str) -> None:
    """Create-only write; an existing target raises."""
    df.write.mode("errorifexists").parquet(path)


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, value, path: str, replace: bool = True) -> None:
    """A JSON document with sorted keys, complete or not there at all: it is written beside its place and renamed."""
    import json
    import uuid

    data = json.dumps(value, sort_keys=True, indent=2, allow_nan=False).encode()
    jvm, at, fs = _store(spark, path)
    if fs.exists(at) and not replace:
        raise FileExistsError(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(data))
    out.close()
    if replace and fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"can't rename to {path}")


def cached(spark: SparkSession, root: str, key: dict, make) -> DataFrame:
    """make()'s table, kept under root by a digest of its key (all that it depends on); made once."""
    import hashlib
    import json

    where = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()}"
    _, done, fs = _store(spark, f"{where}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def markdown_rows(df: DataFrame, columns: list[str], digits: int = 4) -> list[str]:
    """A small table as Markdown lines: numbers with fixed digits, NA for nulls."""
    show = lambda v: "NA" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return head + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in df.select(*columns).collect()]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_dictionary(pattern_tid: DataFrame, path: str, buckets: int = 64) -> None:
    """A dictionary's (itemset, tid) rows, sorted within buckets of patterns."""
    df = pattern_tid.withColumn("bucket", F.pmod(F.xxhash64("itemset"), F.lit(buckets)).cast("int"))
    df.repartition("bucket").sortWithinPartitions("itemset", "tid").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def latex_rows(df: DataFrame, label: str, values: list[str], best: str = "max") -> DataFrame:
    """(label, line): a table row per label with the best value in bold."""
    top = F.greatest(*values) if best == "max" else F.least(*values)
    cells = [F.when(F.col(v) == top, F.format_string("\\textbf{%.3f}", F.col(v))).otherwise(F.format_string("%.3f", F.col(v))) for v in values]
    return df.select(label, F.concat(F.concat_ws(" & ", F.col(label).cast("string"), *cells), F.lit(" \\\\")).alias("line"))
