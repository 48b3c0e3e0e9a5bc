"""Sharding under the law `bytes`: the least largest shard over ordered groups.

Groups are equal texts (null is the empty text), kept whole, in the order of
their hashes.  A shard takes a run of groups, so the document's hash and the
cuts alone tell its shard, and rows never meet by group: a group of a third of
all rows stays spread over its tasks.  The smallest capacity that lets `shards`
runs hold all groups is found by search: prefix sums by hash bucket (a bounded
table) are on the driver, and each probe asks the groups of the buckets its
cuts fall in.  Many capacities are probed at once, greedily, run by run.

Only DataFrame functions are used.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import saved

BUCKETS = 4096


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A bounded list of whole numbers as a table."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{int(v)}L' for v in r) + ')' for r in rows)} AS t({names})")


def _sums(groups: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Buckets that hold groups, in order, and the bytes before each and after the last."""
    rows = sorted((r["bucket"], r["s"]) for r in groups.groupBy("bucket").agg(F.sum("size").alias("s")).collect())
    before = [0]
    for _, s in rows:
        before.append(before[-1] + s)
    return [b for b, _ in rows], before


def _cuts(ends: DataFrame, names: list[int], before: list[int], wanted: list[int]) -> dict[int, int]:
    """For each number of bytes, the largest end of a group that is no larger."""
    at = {x: bisect_right(before, x) - 1 for x in set(wanted)}
    inside = {x: names[i] for x, i in at.items() if i < len(names) and x > before[i]}
    found = {}
    if inside:
        cases = _values(ends.sparkSession, sorted((b, x) for x, b in inside.items()), "bucket, x")
        near = ends.where(F.col("bucket").isin(sorted(set(inside.values())))).join(F.broadcast(cases), "bucket")
        near = near.where("end <= x").groupBy("x").agg(F.max("end").alias("end"))
        found = {r["x"]: r["end"] for r in near.collect()}
    return {x: max(found.get(x, 0), before[min(i, len(names))]) for x, i in at.items()}


def smallest_capacity(ends: DataFrame, names: list[int], before: list[int], largest: int, shards: int, width: int = 192) -> tuple[int, list[int]]:
    """The least capacity with `shards` runs or fewer, and the greedy cuts under it."""
    total = before[-1]
    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards) + largest)
    best: list[int] = []

    def probe(sizes: list[int]) -> dict[int, list[int] | None]:
        cuts: dict[int, list[int]] = {c: [] for c in sizes}
        for _ in range(shards - 1):
            at = {c: (x[-1] if x else 0) + c for c, x in cuts.items()}
            open_ = {c: x for c, x in at.items() if x < total}
            if not open_:
                break
            end = _cuts(ends, names, before, list(open_.values()))
            for c, x in open_.items():
                cuts[c].append(end[x])
        return {c: x if (x[-1] if x else 0) + c >= total else None for c, x in cuts.items()}

    while True:
        step = max(1, -(-(high - low + 1) // width))
        sizes = sorted({*range(low, high, step), high})
        found = probe(sizes)
        good = min(c for c in sizes if found[c] is not None)
        best = found[good]
        if step == 1:
            return good, best
        low, high = (good if good == low else good - step + 1 if good != high else sizes[-2] + 1), good
        if low >= high:
            return (high, best)


def shard_documents(docs: DataFrame, shards: int = 16, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) with law `bytes`.

    Size: bytes of the text (null: none) plus 1.  Slots are gapless from 0 in
    each shard.  Null and empty texts are one group; a null doc_id is placed
    like others; of rows alike in id and text any may come first.  Other
    columns are ignored; an empty table gives an empty table.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("key"))
    bucket = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    rows = saved(rows.withColumn("bucket", bucket), "rows")
    groups = rows.groupBy("bucket", "key").agg(F.sum("size").alias("size"))
    # prefix sums within a bucket, then over buckets
    inner = F.sum("size").over(W.partitionBy("bucket").orderBy("key"))
    groups = saved(groups.select("bucket", "key", "size", inner.alias("inner")), "groups")
    names, before = _sums(groups, buckets)
    cut_keys: list[str] = []
    if names:
        start = saved(_values(docs.sparkSession, list(zip(names, before)), "bucket, before"), "before")
        ends = saved(groups.join(F.broadcast(start), "bucket").select("bucket", "key", (F.col("inner") + F.col("before")).alias("end")).sortWithinPartitions("bucket"), "ends")
        largest = groups.agg(F.max("size")).first()[0]
        _, cuts = smallest_capacity(ends, names, before, largest, shards)
        if cuts:
            at = ends.where(F.col("end").isin(sorted(set(cuts)))).select("end", "key").collect()
            last = {r["end"]: r["key"] for r in at}
            cut_keys = [last[c] for c in cuts if c in last]
    # a document's shard: the cuts whose last group lies before its own
    shard = sum((F.when(F.col("key") > F.lit(k), 1).otherwise(0) for k in cut_keys), F.lit(0)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", "key", shard.alias("shard")).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(1024)).cast("int"))
    counts = placed.groupBy("shard", "part").count()
    offsets = saved(counts.select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("offset")), "offsets")
    own = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "key"))
    out = placed.withColumn("own", own).join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
