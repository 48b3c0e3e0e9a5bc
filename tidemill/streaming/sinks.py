"""foreachBatch sinks that may run a batch again: nothing is added twice, retries are counted, the rest goes to dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.tables import dealt, parts_for


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """The rows as the folder batch_id=<id> of path; the same batch written again takes the place of what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a sink with their batch_id."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")


def batches_logged(spark: SparkSession, log: str) -> set[int]:
    """Batches that were finished: the log has a row for each."""
    try:
        return {r["batch_id"] for r in spark.read.parquet(f"{log}/done=*").select("batch_id").distinct().collect()}
    except AnalysisException:
        return set()


def log_batch(spark: SparkSession, log: str, batch_id: int, counts: dict[str, int]) -> None:
    """Says that a batch is finished, and what it did."""
    row = spark.createDataFrame([(batch_id, *counts.values())], ", ".join(["batch_id long", *(f"{c} long" for c in counts)]))
    row.coalesce(1).write.mode("overwrite").parquet(f"{log}/done={batch_id}")


def handled(tasks: DataFrame, run: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of tasks (id, payload, retry_count): (done, again, dead, follow_ups).

    run: tasks -> (id, outcome, error, follow_up), outcome `done` or `failed`.
    A failed task comes again under its own id with one more retry, or is dead
    when that would be more than `most`; a task without an outcome comes again
    as it is.  A follow_up (a payload) of a done task is a new task whose id is
    made from its parent's, so that a round run again makes the same one.  Of
    several outcomes of a task the first in order of outcome counts: `done`.
    Tasks and outcomes meet in parts of a bounded number of tasks.
    """
    parts = parts_for(tasks)
    o = dealt(run(tasks), "id", parts).groupBy("id").agg(F.min(F.struct("outcome", "error", "follow_up")).alias("_o"))
    t = dealt(tasks, "id", parts).dropDuplicates(["id"]).join(o, "id", "left")
    failed, tried = F.col("_o.outcome") == "failed", F.col("retry_count") + 1
    done = t.where("_o.outcome = 'done'").select("id", "payload", "retry_count")
    dead = t.where(failed & (tried > most)).select("id", "payload", tried.alias("retry_count"), F.col("_o.error").alias("error"))
    again = t.where((failed & (tried <= most)) | F.col("_o").isNull()).select("id", "payload", F.when(failed, tried).otherwise(F.col("retry_count")).alias("retry_count"))
    child = F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), "_o.follow_up"), 256), 1, 16)
    follow = t.where("_o.outcome = 'done' and _o.follow_up is not null").select(child.alias("id"), F.col("_o.follow_up").alias("payload"), F.lit(0).alias("retry_count"), F.col("id").cast("string").alias("parent_id"))
    return done, again, dead, follow


def task_sink(root: str, run: Callable[[DataFrame], DataFrame], most: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: works a batch's tasks off and writes done, again, dead and follow-ups under root.

    Outcomes are written once and read by all four outputs, so that `run` is
    asked once.  Every output is the batch's own folder, and the log comes
    last: a batch that stopped half-way writes all of it anew, one that is
    logged is left alone.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in batches_logged(spark, f"{root}/log"):
            return
        write_batch(batch, f"{root}/taken", batch_id)
        tasks = spark.read.parquet(f"{root}/taken/batch_id={batch_id}")
        write_batch(run(tasks), f"{root}/outcomes", batch_id)
        outcomes = spark.read.parquet(f"{root}/outcomes/batch_id={batch_id}")
        names = ("done", "again", "dead", "follow_ups")
        for name, rows in zip(names, handled(tasks, lambda _: outcomes, most)):
            write_batch(rows, f"{root}/{name}", batch_id)
        log_batch(spark, f"{root}/log", batch_id, {n: spark.read.parquet(f"{root}/{n}/batch_id={batch_id}").count() for n in names})

    return each


def start_worker(stream: DataFrame, root: str, checkpoint: str, run: Callable[[DataFrame], DataFrame], most: int = 3):
    """Works off what there is; returns the query, ended."""
    q = stream.writeStream.foreachBatch(task_sink(root, run, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_new(rows: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    """Rows whose keys no other batch of the sink has, written as the batch's folder (tickets, feedback, traces).

    Of rows alike in key within a batch one stays, by the least of all columns.
    """
    first = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r")) if set(rows.columns) - set(keys) else rows.distinct()
    rows = first.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])
    try:
        stored = read_sink(rows.sparkSession, path).where(F.col("batch_id") != batch_id).select(*keys).distinct()
        rows = rows.join(stored, keys, "left_anti")
    except AnalysisException:
        pass
    write_batch(rows, path, batch_id)
