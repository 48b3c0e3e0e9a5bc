"""Knowledge items: merging, statistics, gates, coverage and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .retrieval import small_enough


def merge_duplicates(items: DataFrame, key: Column, bonus: float = 0.03, most_bonus: float = 0.10, most: float = 0.98) -> DataFrame:
    """One item for each key: the best by confidence, quality, content length, then least id.

    Tags and products are united in the order of the ranks; a missing category
    comes from the best sibling that has one; each sibling adds `bonus` to the
    confidence.  Nulls rank last.  A key's items are never sorted or gathered:
    the best one and each tag's first place are least values, found in the
    tasks first, and only a key's different tags and products meet in one row.
    Items with a null key are merged with nothing; an empty table gives an empty one.
    """
    none = items.withColumn("_key", key).where("_key is null").drop("_key").withColumn("merged", F.lit(1).cast("long"))
    worth = [F.col("confidence"), F.col("quality_score"), F.length("content")]
    order = F.struct(*[x for i, w in enumerate(worth) for x in (w.isNull().alias(f"n{i}"), (-w).alias(f"w{i}"))], F.col("id").alias("id"))
    ranked = items.withColumn("_key", key).where("_key is not null").withColumn("_order", order)
    own = [c for c in items.columns if c not in ("tags", "product_ids", "category_id")]
    best = ranked.groupBy("_key").agg(
        F.min_by(F.struct(*own), "_order").alias("_b"),
        F.min_by("category_id", F.when(F.col("category_id").isNotNull(), F.col("_order"))).alias("category_id"),
        F.count("*").alias("merged"),
    )
    best = best.select("_key", *[F.col(f"_b.{c}").alias(c) for c in own], "category_id", "merged")
    for c in ("tags", "product_ids"):
        if c in items.columns:
            first = ranked.select("_key", "_order", F.posexplode(c).alias("_at", "_v")).groupBy("_key", "_v").agg(F.min(F.struct("_order", "_at")).alias("_first"))
            united = first.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_v"))), lambda x: x["_v"]).alias(c))
            best = best.join(united, "_key", "left").withColumn(c, F.coalesce(c, F.array().cast(items.schema[c].dataType)))
    raised = F.greatest(F.col("confidence"), F.least(F.lit(most), F.col("confidence") + F.least(F.lit(most_bonus), F.lit(bonus) * (F.col("merged") - 1))))
    return best.withColumn("confidence", raised).select(*none.columns).unionByName(none)


def duplicate_ratio(items: DataFrame, key: Column) -> DataFrame:
    """1 - keys / items; 0 of none."""
    return items.agg((1 - F.coalesce(F.try_divide(F.countDistinct(key), F.count("*")), F.lit(1.0))).alias("duplicate_ratio"))


def publishable(items: DataFrame, as_of: Column) -> DataFrame:
    """Reviewed items that are not over."""
    return items.where(F.col("review_status").isin("approved", "revised") & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))


def marginals(items: DataFrame, columns: list[str]) -> DataFrame:
    """Items by the values of each column alone, in one pass of grouping sets."""
    sets = items.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("items"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    which = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for c in columns])
    return sets.select(which.alias("dimension"), value.alias("value"), "items")


def statistics(items: DataFrame) -> DataFrame:
    """One row: items, approved ratio, mean quality, duplicates, categories, assets and expiry."""
    n = F.count("*")
    return items.agg(
        n.alias("items"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("review_status").isin("approved", "revised")), n), F.lit(0.0)), 6).alias("approved_ratio"),
        F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 6).alias("avg_quality"),
        (n - F.countDistinct("dedup_key")).alias("duplicates"),
        F.countDistinct(F.when(F.col("category_id") != 0, F.col("category_id"))).alias("categories"),
        F.count_if("has_assets").alias("with_assets"),
        F.count_if(F.col("valid_to").isNotNull()).alias("with_expiry"),
    )


# Gate, bound, direction, and whether a failure stops the release.
PUBLISH_GATES = [("approved_ratio", 0.95, ">=", True), ("avg_quality", 0.70, ">=", True), ("synthetic_ratio", 0.50, "<=", True), ("top_source_ratio", 0.80, "<=", False), ("duplicate_ratio", 0.02, "<=", True), ("pii_items", 0.0, "<=", True)]


def check_gates(measures: DataFrame, gates=None) -> DataFrame:
    """A one-row table of measures -> (gate, value, bound, passed, blocking)."""
    rows = [F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(b).alias("bound"), (F.col(g) >= b if op == ">=" else F.col(g) <= b).alias("passed"), F.lit(stop).alias("blocking")) for g, b, op, stop in gates or PUBLISH_GATES]
    return measures.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def decide(checks: DataFrame, force: bool = False) -> DataFrame:
    """A release passes if no blocking gate fails, or by force."""
    return checks.agg((F.every(F.col("passed") | ~F.col("blocking")) | F.lit(force)).alias("publish"), F.count_if(~F.col("passed")).alias("failed"))


def coverage(items: DataFrame, categories: DataFrame, types: DataFrame, sparse: int = 3, hot: int = 30) -> DataFrame:
    """Every category by type with its items and level; the sides are dimension tables."""
    counts = items.groupBy("category_id", "knowledge_type").agg(F.count("*").alias("items"))
    cells = categories.select("category_id").crossJoin(small_enough(types.select("knowledge_type")))
    n = F.coalesce("items", F.lit(0))
    level = F.when(n == 0, "empty").when(n < sparse, "sparse").when(n > hot, "hot").otherwise("ok")
    return cells.join(counts, ["category_id", "knowledge_type"], "left").select("category_id", "knowledge_type", n.alias("items"), level.alias("level"))


def write_tasks(cells: DataFrame, demand: DataFrame, target: int = 3, steps=(50, 20, 5), limit: int = 50) -> DataFrame:
    """Cells to write for: priority by demand, then the widest gap; a top-k report."""
    asked = F.coalesce("demand", F.lit(0))
    priority = F.when(asked >= steps[0], 0).when(asked >= steps[1], 1).when(asked >= steps[2], 2).otherwise(3)
    gap = F.greatest(F.lit(0), target - F.col("items"))
    todo = cells.where("level in ('empty', 'sparse')").join(demand, ["category_id", "knowledge_type"], "left")
    todo = todo.select("category_id", "knowledge_type", "items", priority.alias("priority"), gap.cast("long").alias("gap"))
    return todo.orderBy("priority", F.desc("gap"), "category_id", "knowledge_type").limit(limit)


def triage(items: DataFrame, uncertain: Column, conflict: Column, asked: Column, sampled: Column, low: float = 0.6, high: float = 0.9, hot: int = 50) -> DataFrame:
    """Adds priority (P0, P1, P2 or auto) and reason; the first rule that holds."""
    conf = F.coalesce("confidence", F.lit(0.0))
    rules = [(conf < low, "P0", "low_confidence"), (uncertain, "P0", "uncertain"), (conflict, "P1", "conflict"), (asked >= hot, "P1", "hot"), ((conf >= high) & sampled, "P2", "sampled"), (conf >= high, "auto", "approved"), (F.lit(True), "P2", "middle")]
    pick = lambda i: F.coalesce(*[F.when(r[0], F.lit(r[i])) for r in rules])
    return items.withColumn("priority", pick(1)).withColumn("reason", pick(2))
