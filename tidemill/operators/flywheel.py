"""Traces and tickets: demand, blind spots, task queues, costs and service quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .training import first_by_key, hashed


def blind_spots(tickets: DataFrame, limit: int = 50) -> DataFrame:
    """(id, question, reason, status) -> questions asked in vain, the most frequent first, with their urgency."""
    g = tickets.groupBy("question").agg(F.count("*").alias("times"), F.max("reason").alias("reason"), F.min("id").alias("first_id"), F.min("status").alias("status"))
    urgency = F.when(F.col("times") >= 3, "P0").when(F.col("times") == 2, "P1").otherwise("P2")
    return g.withColumn("priority", urgency).orderBy(F.desc("times"), "first_id").limit(limit)


def reduce_tasks(events: DataFrame) -> DataFrame:
    """(task_key, at, id, priority, running) enqueue events -> one open task a key.

    The first event opens the task, later ones count and raise its priority; the
    last one's running flag stays.
    """
    return events.groupBy("task_key").agg(F.count("*").alias("times"), F.max("priority").alias("priority"), F.min("id").alias("id"), F.max_by("running", F.struct("at", "id")).alias("running"))


def pull_tasks(tasks: DataFrame, limit: int) -> DataFrame:
    """The next tasks to run: waiting, by priority, then age."""
    return tasks.where(~F.col("running")).orderBy(F.desc("priority"), "id").limit(limit)


def streaks(rows: DataFrame, group: str, order: list[str], bad: Column, least: int = 3) -> DataFrame:
    """Runs of `least` or more bad rows in a group's order: start, and length."""
    w = W.partitionBy(group).orderBy(*order)
    runs = rows.withColumn("_bad", bad).withColumn("_run", F.sum((~F.col("_bad")).cast("long")).over(w)).where("_bad")
    out = runs.groupBy(group, "_run").agg(F.count("*").alias("length"), F.min(F.struct(*order)).alias("_first"))
    return out.where(F.col("length") >= least).select(group, F.col(f"_first.{order[0]}").alias("start"), "length")


def reply_times(rows: DataFrame, group: str, at: str, speaker: str, customer: str, staff: str) -> DataFrame:
    """Seconds from each customer row to the staff row right after it."""
    w = W.partitionBy(group).orderBy(at, "event_id")
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    return rows.withColumn("seconds", gap).withColumn("_before", F.lag(speaker).over(w)).where((F.col(speaker) == staff) & (F.col("_before") == customer)).drop("_before")


def cost_rollup(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums and counts by the keys, their prefixes and overall; `level` tells how many keys are rolled up."""
    g = rows.rollup(*keys).agg(F.round(F.sum(value), 4).alias("total"), F.count("*").alias("n"), F.grouping_id().alias("_gid"))
    level = sum(F.when(F.col("_gid").bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0) for i in range(len(keys)))
    return g.select(*keys, "total", "n", level.cast("int").alias("level"))


def share_curve(hits: DataFrame, item: str, k: int) -> DataFrame:
    """The k items of most hits with their cumulative share of all hits; only these k are ranked in one task."""
    c = hits.groupBy(item).agg(F.count("*").alias("hits"))
    total = c.agg(F.sum("hits").alias("total"))
    w = W.orderBy(F.desc("hits"), item).rowsBetween(W.unboundedPreceding, 0)
    return c.orderBy(F.desc("hits"), item).limit(k).crossJoin(total).select(item, "hits", F.round(F.sum("hits").over(w) / F.col("total"), 6).alias("share"))


def capped_share(rows: DataFrame, owner: str, key: str, share: float) -> DataFrame:
    """A sampling step: at most `share` of all rows from one owner, by a hash of the key column, then the key.

    An owner's rows are never sorted as a whole, see training.first_by_key.  A
    null owner is an owner.
    """
    quota = rows.agg(F.floor(F.count("*") * share).alias("quota"))
    quotas = rows.groupBy(owner).agg(F.count("*").alias("_n")).crossJoin(quota).select(owner, "quota")  # one row
    return first_by_key(rows, owner, hashed(F.col(key)), quotas, F.col(key))


def ab_group(user: Column, groups: int = 2) -> Column:
    """A user's group, the same for all their sessions."""
    return F.conv(F.substring(F.md5(user.cast("string")), 1, 6), 16, 10).cast("int") % groups


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(group, a column for each share): exact percentiles, interpolated, without a sort or a list of all values.

    A histogram between each group's least and largest value tells in which
    buckets the wanted ranks lie; only values of those are counted.  Null values
    are left out, and so are groups without any.
    """
    g, v = F.col(group), F.col(value).cast("double")
    r = rows.where(F.col(value).isNotNull() & g.isNotNull()).select(g, v.alias("_v"))
    ends = r.groupBy(group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    place = F.least(F.lit(buckets - 1), F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * buckets).cast("int"))
    binned = r.join(ends, group).withColumn("_b", place)
    hist = binned.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    hist = hist.withColumn("_before", F.sum("_c").over(W.partitionBy(group).orderBy("_b")) - F.col("_c"))
    at = [F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for name, q in shares.items()]
    asked = ends.select(group, F.explode(F.array(*at)).alias("q")).select(group, "q.name", "q.at")
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("_rank"))
    wanted = asked.join(hist, group).where("_rank >= _before and _rank < _before + _c")
    near = binned.join(wanted.select(group, "_b", "_before").distinct(), [group, "_b"]).groupBy(group, "_b", "_before", "_v").agg(F.count("*").alias("_k"))
    w = W.partitionBy(group, "_b").orderBy("_v")
    near = near.select(group, "_b", "_v", (F.col("_before") + F.sum("_k").over(w) - F.col("_k")).alias("_from"), (F.col("_before") + F.sum("_k").over(w)).alias("_to"))
    found = wanted.join(near, [group, "_b"]).where("_rank >= _from and _rank < _to")
    ends_of = found.groupBy(group, "name", "at").agg(F.min_by("_v", "_rank").alias("a"), F.max_by("_v", "_rank").alias("b"))
    one = ends_of.select(group, "name", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("p"))
    return one.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in shares])


def blind_spot_ids(tickets: DataFrame, limit: int = 50) -> DataFrame:
    """(id, question, status) -> open and answered questions with all their ids in order, the most frequent first; a report of `limit` rows.

    Ids are joined in blocks of 65,536, so that no task sorts all ids of a
    question; null questions are one question, null ids none.
    """
    t = tickets.where("status in ('open', 'answered')")
    counts = t.groupBy("question").agg(F.count("*").alias("times"), F.min("id").alias("first_id")).orderBy(F.desc("times"), "first_id").limit(limit)
    mine = t.where("id is not null").join(F.broadcast(counts.select(F.col("question").alias("_q"))), F.col("question").eqNullSafe(F.col("_q")), "left_semi")  # `limit` rows
    block = F.floor(F.col("id") / 65536)
    parts = mine.groupBy("question", block.alias("_b")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    ids = parts.groupBy(F.col("question").alias("_q")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "ids"))), lambda x: x["ids"]), ",").alias("ids"))
    return counts.join(ids, F.col("question").eqNullSafe(F.col("_q"))).drop("_q")


def question_demand(traces: DataFrame, limit: int = 20) -> DataFrame:
    """(product_id, input_text, intent, handover) -> each product's most frequent questions: times, an intent, handovers; `limit` a product."""
    g = traces.groupBy("product_id", "input_text").agg(F.count("*").alias("times"), F.max("intent").alias("intent"), F.count_if("handover").alias("handovers"))
    r = F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("times"), "input_text"))
    return g.withColumn("rank", r).where(F.col("rank") <= limit)
