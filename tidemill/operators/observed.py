"""Counts of drops and modifications taken while a gate's output is written: no second read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATS = "gate string, batch_id string, input_unit string, output_unit string, kind string, name string, unit string, n long"


def observed_gate(rows: DataFrame, reason: Column, modified: dict[str, Column], units: Column | None = None, reasons: list[str] = ()) -> tuple[DataFrame, Observation]:
    """rows with drop_reason, and an observation of them that is there once they have been written.

    reason: why a row is dropped, or null; modified: how many changes of each
    kind a row got, of which those of kept rows count (a null is none).
    reasons: those to count; others count as `other`.
    """
    seen = Observation()
    r = rows.withColumn("drop_reason", reason)
    kept = F.col("drop_reason").isNull()
    listed = F.col("drop_reason").isin(list(reasons)) if reasons else F.lit(False)
    out = r.observe(
        seen,
        F.count("*").alias("input"), F.count_if(kept).alias("output"), F.count_if(~kept & ~listed).alias("dropped:other"),
        *[F.count_if(F.col("drop_reason") == x).alias(f"dropped:{x}") for x in reasons],
        *[F.coalesce(F.sum(F.when(kept, F.coalesce(c.cast("long"), F.lit(0)))), F.lit(0)).alias(f"modified:{k}") for k, c in modified.items()],
    )
    return out, seen


def stats_rows(spark: SparkSession, seen: Observation, gate: str, batch_id: str, input_unit: str = "session", output_unit: str = "session", drop_units: dict[str, str] | None = None) -> DataFrame:
    """The observation as STATS rows, a few for a gate; call it after the write."""
    rows = []
    for name, n in seen.get.items():
        kind, _, what = name.partition(":")
        unit = output_unit if kind in ("output", "modified") else (drop_units or {}).get(what, input_unit)
        if kind in ("input", "output") or n:
            rows.append((gate, batch_id, input_unit, output_unit, kind, what, unit, n))
    return spark.createDataFrame(rows, STATS)


def merged_stats(*batches: DataFrame) -> DataFrame:
    """Statistics of several batches by gate: counts of one kind, name and unit add up, different units never do."""
    every = reduce(DataFrame.unionByName, batches)
    return every.groupBy("gate", "kind", "name", "unit").agg(F.sum("n").alias("n"))


def summary(stats: DataFrame) -> DataFrame:
    """(gate, input, output, keep_rate, dropped) with dropped as `3 item + 2 session`, by unit in order."""
    by_unit = stats.where("kind = 'dropped'").groupBy("gate", "unit").agg(F.sum("n").alias("n"))
    text = by_unit.groupBy("gate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["unit"])), " + ").alias("dropped"))
    ends = stats.groupBy("gate").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("input", "output")])
    rate = F.coalesce(F.try_divide("output", "input"), F.lit(0.0))
    return ends.join(text, "gate", "left").select("gate", "input", "output", F.round(rate, 6).alias("keep_rate"), F.coalesce("dropped", F.lit("0")).alias("dropped"))
