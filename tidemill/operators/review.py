"""Human review and media: conflicts with attributes, annotations, transcripts and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .agreement import spearman
from .phrases import held_words


def attribute_conflicts(items: DataFrame, attrs: DataFrame) -> DataFrame:
    """(id, content, product_ids), (product_id, pos, key, value) -> the first attribute an item names but gives another value."""
    i = items.select("id", "content", F.posexplode("product_ids").alias("p", "product_id"))
    j = i.join(attrs, "product_id").where("contains(content, key) and not contains(content, value)")
    r = F.row_number().over(W.partitionBy("id").orderBy("p", "pos"))
    return j.withColumn("_r", r).where("_r = 1").select("id", "product_id", "key", "value")


def apply_annotations(items: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, verdict, text) marks: reject, revise where the text differs, else approve; confidence becomes 1."""
    m = marks.select("id", F.col("verdict").alias("_v"), F.col("text").alias("_t"))
    changed = F.col("_t").isNotNull() & (F.col("_t") != F.col("content"))
    status = F.when(F.col("_v").isNull(), F.col("review_status")).when(F.col("_v") == "reject", "rejected").when(changed, "revised").otherwise("approved")
    j = items.join(m, "id", "left")
    return j.withColumns({"review_status": status, "confidence": F.when(F.col("_v").isin("approve", "revise"), 1.0).otherwise(F.col("confidence")), "content": F.when((F.col("_v") != "reject") & changed, F.col("_t")).otherwise(F.col("content"))}).drop("_v", "_t")


def windows(lines: DataFrame, group: str, order: str, size: int = 60, overlap: int = 8) -> DataFrame:
    """(group, window, first, last): runs of `size` lines, each beginning `overlap` lines before the last one's end.

    Lines without an order are left out; a null group is a group.
    """
    step = size - overlap
    own = W.partitionBy(group)
    n = lines.where(F.col(order).isNotNull()).select(group, order, F.row_number().over(own.orderBy(order)).alias("_r"), F.count("*").over(own).alias("_n"))
    last = F.greatest(F.ceil((F.col("_n") - overlap) / step).cast("int") - 1, F.lit(0))
    begins = n.where(((F.col("_r") - 1) % step == 0) & ((F.col("_r") - 1) / step <= last))
    begins = begins.select(F.col(group), F.floor((F.col("_r") - 1) / step).cast("int").alias("window"), F.col(order).alias("first"), F.least(F.col("_r") - 1 + size, F.col("_n")).alias("_end"))
    ends = n.select(F.col(group).alias("_g"), F.col("_r").alias("_end_r"), F.col(order).alias("last"))
    return begins.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_end") == F.col("_end_r"))).select(group, "window", "first", "last")


def drop_overlaps(segments: DataFrame, group: str) -> DataFrame:
    """(group, begin_ms, end_ms, script): in order, of two segments that share over half the shorter, the longer script stays."""
    seg = F.struct("begin_ms", "end_ms", "script")
    folded = segments.groupBy(group).agg(F.array_sort(F.collect_list(seg)).alias("s"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        shared = F.least(last["end_ms"], x["end_ms"]) - F.greatest(last["begin_ms"], x["begin_ms"])
        shorter = F.least(last["end_ms"] - last["begin_ms"], x["end_ms"] - x["begin_ms"])
        clash = shared > 0.5 * shorter
        head = F.slice(acc, 1, F.size(acc) - 1)
        return F.when(~clash, F.concat(acc, F.array(x))).when(F.length(x["script"]) > F.length(last["script"]), F.concat(head, F.array(x))).otherwise(acc)

    kept = F.aggregate(F.slice("s", 2, 1 << 30), F.slice("s", 1, 1), step)
    return folded.select(group, F.explode(kept).alias("x")).select(group, "x.*")


def align(segments: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Segments with the product whose longest name they hold; names (product_id, name, pos).

    All names are looked for in one walk over the texts, see phrases.py.  Null
    and empty names are never held; names alike go by pos.  A segment without a
    name, or with a null text, has a null product.
    """
    held = held_words(segments.select(F.col("segment_id").alias("id"), F.col(text).alias("text")), names.select(F.col("name").alias("word")))
    first = names.groupBy("name").agg(F.min_by("product_id", "pos").alias("product_id"), F.min("pos").alias("pos"))
    best = held.join(first, F.col("word") == F.col("name")).groupBy("id").agg(F.min_by(F.struct("product_id", "name"), F.struct(-F.length("name"), "pos")).alias("_n"))
    return segments.select("segment_id").join(best.withColumnRenamed("id", "segment_id"), "segment_id", "left").select("segment_id", "_n.product_id", F.col("_n.name").alias("matched"))


def calibration(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two ratings: Spearman's rho with average ranks, mean error, and errors of two or more.

    Rows without both ratings are left out; rho is null where a rating never varies.
    """
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit(0).alias("_all"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    errors = r.agg(F.round(F.avg(gap), 6).alias("mean_error"), F.round(F.avg((gap >= 2).cast("double")), 6).alias("far"))
    rho = spearman(r, "_all", "_a", "_b").agg(F.round(F.max("rho"), 6).alias("rho"))
    return errors.crossJoin(rho).select("rho", "mean_error", "far")  # one row by one row


def unique_ratio(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams over all of them, of an array of texts joined."""
    from ..functions.textops import char_grams

    g = char_grams(text, n)
    return F.size(F.array_distinct(g)) / F.size(g)
