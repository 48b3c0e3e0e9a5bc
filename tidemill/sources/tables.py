"""Tables as versioned Parquet: latest-wins upserts, deletes, snapshots and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the new ones in the place of those with equal keys."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_r", r).where("_r = 1").drop("_r", "_new")


def without(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows whose keys are not among those gone."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def coalesce_updates(stored: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns set from updates where these are neither null nor blank."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    new = {c: F.coalesce(F.when(F.trim(F.col(f"_{c}").cast("string")) != "", F.col(f"_{c}")), F.col(c)) for c in columns}
    return stored.join(u, key, "left").withColumns(new).drop(*[f"_{c}" for c in columns])


def one_provider(index: DataFrame) -> DataFrame:
    """The index rows; the job fails if their vectors come from several providers."""
    counts = index.select("provider").distinct().agg(F.count("*").alias("n"))
    bad = counts.select(F.assert_true(F.col("n") <= 1, F.lit("vectors of several providers")).alias("ok"))
    return index.join(F.broadcast(bad), F.col("ok").isNull()).drop("ok")  # assert_true gives null; one row


def chunk_key(item: Column, seq: Column) -> Column:
    """item * 1000 + seq; the job fails on a seq outside 0 to 999."""
    return F.when(seq.between(0, 999), item * 1000 + seq).otherwise(F.raise_error(F.lit("chunk outside 0..999")))


def index_rows(items: DataFrame, version: str) -> DataFrame:
    """Items flattened for an index: text of 4096 characters, no null category or expiry."""
    ts = F.unix_seconds(F.col("valid_to").cast("timestamp"))
    return items.select("id", F.substring("content", 1, 4096).alias("text"), F.coalesce("category_id", F.lit(0)).alias("category_id"), F.coalesce(ts, F.lit(0)).alias("valid_to_ts"), "review_status", F.lit(version).alias("kb_version"))


def write_snapshot(items: DataFrame, path: str) -> None:
    """JSON lines without null fields, one new directory a version."""
    items.write.option("ignoreNullFields", "true").mode("errorifexists").json(path)


def write_mart(rows: DataFrame, path: str, month: Column, sort: list[str]) -> None:
    """Parquet by month, sorted within files so that readers skip row groups; a large month is many tasks, by its sort keys."""
    rows.withColumn("ym", F.date_format(month, "yyyyMM")).repartitionByRange("ym", *sort).sortWithinPartitions("ym", *sort).write.partitionBy("ym").mode("overwrite").parquet(path)


def compacted(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows with equal keys summed up."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def parts_for(rows: DataFrame, each: int = 100_000) -> int:
    """Parts of about `each` rows that these make; they are counted first."""
    return max(1, -(-rows.count() // each))


def dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows dealt by key into so many parts, which stay apart: bytes that compress well are not put together into a long task."""
    return rows.repartition(parts, key)


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written to the folder the cluster shares and read again: their lineage ends here.

    Without spark.checkpoint.dir, a folder of this machine serves where all of
    Spark runs on it (local mode, as in tests); on a cluster it is an error.
    """
    import tempfile
    import uuid

    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
