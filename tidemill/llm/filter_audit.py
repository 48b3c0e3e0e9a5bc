"""Filter interaction audit: what each filter of a cascade removes, in every order.

Each document has a mask of the filters it fails.  In an order of the filters
it is removed at the step of the first filter it fails, so the removal steps
are a min-plus product: a mask matrix (0 where a document fails a filter,
infinite elsewhere) with the matrix of positions each filter has in each order
(the inverse permutations), combined by minimum.  Removal steps then scatter
the documents' weights over the steps.

Documents of one part and one mask are one weighted row of the mask matrix.
They are counted by Spark first, so a part brings at most 2^filters * 4 rows
to its task, whatever its documents.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
NEVER = 255
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def positions(n: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of n filters, and the step (from 1) at which each filter stands in each order."""
    orders = list(permutations(range(n)))
    at = np.argsort(np.array(orders, np.int64).reshape(len(orders), n), axis=1) + 1
    return orders, at.astype(np.int16)


def removal_steps(masks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Min-plus product of masks (rows x filters, True where failed) and positions: the removal step by row and order; NEVER if none."""
    n = masks.shape[1]
    cost = np.where(masks, 0, NEVER).astype(np.int16)
    out = np.full((len(masks), len(at)), NEVER, np.int16)
    for f in range(n):
        np.minimum(out, cost[:, f, None] + at[None, :, f], out=out)
    return out


def interactions(masks: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS as (orders x steps) arrays; weights: (rows x 3) counts of documents, good ones and toxic ones."""
    n = masks.shape[1]
    orders, at = positions(n)
    steps = removal_steps(masks, at)
    scattered = np.zeros((3, len(orders), n + 2), np.int64)
    gone = np.minimum(steps, n + 1)
    for j in range(3):
        for o in range(len(orders)):
            np.add.at(scattered[j, o], gone[:, o], weights[:, j])
    removed = scattered[0, :, 1 : n + 1]
    index = np.array(orders)
    fails = (masks * weights[:, :1]).sum(0)
    only = (masks * (weights[:, :1] * (masks.sum(1) == 1)[:, None])).sum(0)
    total = np.zeros(n, np.int64)
    np.add.at(total, index.ravel(), removed.ravel())
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": fails[index] - removed,
        "unique_fails": only[index],
        "good_lost": scattered[1, :, 1 : n + 1],
        "toxic_lost": scattered[2, :, 1 : n + 1],
        "shapley": total[index],
    }


def _audit(letters: str):
    def run(key, table):
        t = {c: np.asarray(table[c].to_numpy()) for c in ("mask", "docs", "good", "toxic")}
        masks = (t["mask"][:, None] >> np.arange(len(letters)) & 1).astype(bool)
        found = interactions(masks, np.c_[t["docs"], t["good"], t["toxic"]].astype(np.int64))
        orders = list(permutations(letters))
        n = len(letters)
        return pa.table(
            {
                "part": pa.array([key[0].as_py()] * (len(orders) * n), pa.string()),
                "filter_order": pa.array(["".join(o) for o in orders for _ in range(n)], pa.string()),
                "step": pa.array(list(range(1, n + 1)) * len(orders), pa.int32()),
                **{c: pa.array(found[c].ravel(), pa.int64()) for c in COUNTS},
            }
        )

    return run


def audit(failures: DataFrame, letters: str) -> DataFrame:
    """failures (part string, mask int, docs, good, toxic long) -> a row for each part, order of letters and step.

    Bit i of a mask is set where the filter letters[i] fails.  Rows of one
    part and mask are added up.
    """
    kind = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = failures.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("docs", "good", "toxic")))
    return rows.groupBy("part").applyInArrow(_audit(letters), kind)


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: under 100 words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for i, f in enumerate(failed):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, COUNTS): the five filters over whole texts, by lang, in all 120 orders.

    E, an equal text under a smaller doc_id, is judged over the whole table.
    Equal texts are told by SHA-256; copies are counted by (text, part,
    labels) with their least doc_id before texts meet, so a text in a third of
    all rows is a handful of rows.  A null text is empty, a null lang is the
    part "".  Rows of one doc_id and text are no duplicates of each other; a
    row without doc_id is none either, makes none, and has no labels.  Of a
    doc_id labelled twice, quality = 1 or toxic = 1 in any row counts.  An
    empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("hash"),
    )
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "is_good"), ("toxic", "is_toxic"))))
    known = d.where("doc_id is not null").join(marks, "doc_id", "left")
    key = ["hash", "mask", "part", "is_good", "is_toxic"]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    each = known.select("doc_id", "hash", "mask", "part", *flags).groupBy("doc_id", *key).agg(F.count("*").alias("n"))
    # of each group: its rows, the least doc_id, and that doc_id's rows
    groups = each.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    groups = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("hash")))
    alone = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    groups = groups.select("part", "mask", "is_good", "is_toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), alone.alias("docs")), F.struct(F.lit(16).alias("e"), (F.col("n") - alone).alias("docs")))).alias("x"))
    groups = groups.select("part", (F.col("mask") + F.col("x.e")).alias("mask"), "is_good", "is_toxic", F.col("x.docs").alias("docs")).where("docs > 0")
    nameless = d.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("docs")).select("part", "mask", F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic"), "docs")
    counted = lambda c: F.when(F.col(c), F.col("docs")).otherwise(0)
    return audit(groups.unionByName(nameless).select("part", "mask", "docs", counted("is_good").alias("good"), counted("is_toxic").alias("toxic")), LETTERS)
