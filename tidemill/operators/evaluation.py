"""Ranking and classification metrics, splits and regression checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranking(first_gold: DataFrame, ks=(1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """(query, rank of the first gold item or null) -> one row: recall at k and MRR at 10."""
    recall = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), digits).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(F.lit(0.0))), digits).alias("mrr_10")
    return first_gold.agg(F.count("*").alias("queries"), *recall, mrr)


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, pred) -> counts."""
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """Support, precision, recall and F1 of each class that is true or predicted anywhere."""
    c = confusion(pairs)
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    truth = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    pred = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = truth.join(pred, "label", "full").na.fill(0, ["support", "tp", "predicted"])
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return both.select("label", "support", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def top_confusions(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent mistakes; a top-k report, ties by names."""
    return confusion(pairs).where("truth <> pred").orderBy(F.desc("n"), "truth", "pred").limit(n)


# Metric and the bound it must reach.
EVAL_GATES = [("accuracy", 0.85), ("macro_f1", 0.80), ("worst_f1", 0.60)]


def eval_gates(summary: DataFrame, gates=None) -> DataFrame:
    """A one-row table of metrics -> (metric, value, bound, passed); a null value fails."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(F.col(m) >= b, F.lit(False)).alias("passed")) for m, b in gates or EVAL_GATES]
    return summary.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def leak_gate(judged: DataFrame) -> DataFrame:
    """(expected, actual) of safety cases -> leaks, cases that should have been stopped and were not, and whether there is none."""
    leaks = F.count_if((F.col("expected") != "pass") & (F.col("actual") == "pass"))
    return judged.agg(leaks.alias("leaks"), (leaks == 0).alias("passed"))


def new_baseline(now: DataFrame, baseline: DataFrame, checks: DataFrame, full: bool) -> DataFrame:
    """The metrics of a full run whose checks all passed; else the baseline as it is."""
    good = checks.agg((F.coalesce(F.every("passed"), F.lit(False)) & F.lit(full)).alias("_good"))
    pick = lambda rows, want: rows.select("suite", "metric", "value").join(F.broadcast(good.where(F.col("_good") == want)), F.lit(True)).drop("_good")  # noqa: E731  one row
    return pick(now, True).unionByName(pick(baseline, False))


def summary(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """Accuracy, and F1 averaged over the classes with support."""
    acc = pairs.agg(F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), digits).alias("accuracy"))
    macro = per_class(pairs, 12).where("support > 0").agg(F.round(F.avg("f1"), digits).alias("macro_f1"), F.round(F.min("f1"), digits).alias("worst_f1"))
    return acc.crossJoin(macro)  # one row by one row


def split_half(rows: DataFrame, stratum: str, key: Column) -> DataFrame:
    """Adds part: `tune` for the first half of each stratum in the key's order, `hold` for the rest.

    The key is a string of evenly spread beginnings, such as a hash: rows are
    ranked within its first three characters, and counts of those give what
    comes before, so that no stratum is sorted in one task.
    """
    keyed = rows.withColumn("_key", key.cast("string")).withColumn("_b", F.substring("_key", 1, 3))
    counts = keyed.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    w = W.partitionBy(stratum)
    counts = counts.select(F.col(stratum).alias("_s"), F.col("_b").alias("_p"), (F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    j = keyed.join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & F.col("_b").eqNullSafe(F.col("_p")))
    r = F.col("_before") + F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_key"))
    return j.withColumn("part", F.when(r <= F.floor(F.col("_n") / 2), "tune").otherwise("hold")).drop("_key", "_b", "_s", "_p", "_before", "_n")


def round_robin(rows: DataFrame, stratum: str, key: Column, limit: int) -> DataFrame:
    """A sample of `limit` rows that takes one of each stratum in turn."""
    r = F.row_number().over(W.partitionBy(stratum).orderBy(key))
    return rows.withColumn("turn_no", r).where(F.col("turn_no") <= limit).orderBy("turn_no", stratum).limit(limit)  # ranks are cut before the shuffle


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(suite, metric, value) against a baseline: how far each fell, and whether too far."""
    b = baseline.select("suite", "metric", F.col("value").alias("base"))
    delta = F.round(F.col("value") - F.col("base"), 6)
    return now.join(b, ["suite", "metric"]).select("suite", "metric", delta.alias("delta"), (delta >= -tolerance).alias("ok"))


def isolated(docs: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, text) without those that hold an item's text word for word, anywhere; items are a stated set.

    Documents meet the items whose first n words (or all, of fewer) they hold.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda x: x != "")
    line = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    i = items.select(words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(n)))
    key = lambda w, s, k: F.xxhash64(*[F.get(w, s + x) for x in range(k)])
    h = F.lit(None).cast("long")
    for k in range(1, n + 1):
        h = F.when(F.col("n") == k, key(F.col("w"), F.lit(0), k)).otherwise(h)
    i = i.select("n", line(F.col("w")).alias("item"), h.alias("h"))
    sizes = [r["n"] for r in i.select("n").distinct().collect()]  # n at most
    if not sizes:
        return docs
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    none = F.array().cast("array<struct<n int, h bigint>>")
    run = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda s: F.struct(F.lit(k).alias("n"), key(F.col("w"), s, k).alias("h")))).otherwise(none)
    # runs go without their text; only documents that hold an item's beginning are read whole
    runs = d.select("doc_id", F.explode(F.concat(*[run(k) for k in sizes])).alias("r")).select("doc_id", "r.*")
    begun = runs.join(F.broadcast(i.select("n", "h").distinct()), ["n", "h"], "left_semi").select("doc_id", "n", "h").distinct().join(F.broadcast(i), ["n", "h"]).select("doc_id", "item")
    held = begun.join(d, "doc_id").where(F.contains(line(F.col("w")), "item")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti")
