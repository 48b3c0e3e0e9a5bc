"""Tickets, tasks and traces: dispatch, claims and retries, approvals, aliases, marks and reports.

State tables are immutable: each function gives the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Reasons of a handover that become a task, with what they add to its priority, and those that never do.
DISPATCH = {"no_knowledge": 20, "low_confidence": 10, "postcheck_failed": 0}
NEVER = ["self_harm", "user_requested", "sensitive_intent", "tool_failure", "internal_error"]


def judge_handover(reason: Column, question: Column, times: Column, shortest: int = 4) -> Column:
    """struct(dispatch, why, priority): may this handover become a task?  Unlisted reasons may not."""
    bump = F.coalesce(*[F.when(reason == r, F.lit(b)) for r, b in DISPATCH.items()])
    bare = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    why = F.when(reason.isNull(), "no_reason").when(reason.isin(NEVER), "never").when(bump.isNull(), "unlisted").when(F.length(bare) < shortest, "too_short").otherwise("dispatch")
    ok = why == "dispatch"
    return F.struct(ok.alias("dispatch"), why.alias("why"), F.when(ok, bump + F.least(F.coalesce(times, F.lit(1)), F.lit(10))).otherwise(0).cast("int").alias("priority"))


def claim(tasks: DataFrame, worker: Column, limit: int, now: Column) -> DataFrame:
    """The tasks once the next `limit` pending ones are running: by priority, then id; one more attempt each."""
    taken = tasks.where("status = 'pending'").orderBy(F.desc("priority"), "id").limit(limit).select("id", F.lit(True).alias("_t"))
    t = tasks.join(taken, "id", "left")
    got = F.coalesce("_t", F.lit(False))
    return t.withColumns({"status": F.when(got, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + got.cast("int"), "worker": F.when(got, worker).otherwise(F.col("worker")), "claimed_at": F.when(got, now).otherwise(F.col("claimed_at"))}).drop("_t")


def finish(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The tasks after (id, outcome, error): only running ones change; a failed one with attempts left is pending again.

    Several outcomes of one id: the first in order of outcome counts.
    """
    o = outcomes.groupBy("id").agg(F.min(F.struct("outcome", "error")).alias("_o"))
    t = tasks.join(o, "id", "left")
    hit = F.col("_o").isNotNull() & (F.col("status") == "running")
    retry = hit & (F.col("_o.outcome") == "failed") & (F.col("attempts") < F.col("max_attempts"))
    status = F.when(retry, "pending").when(hit, F.col("_o.outcome")).otherwise(F.col("status"))
    return t.withColumns({"status": status, "error": F.when(hit, F.substring(F.coalesce("_o.error", F.lit("")), 1, 512)).otherwise(F.col("error")), "finished_at": F.when(hit & ~retry, now).when(hit, F.lit(None)).otherwise(F.col("finished_at"))}).drop("_o")


def run_pending(tasks: DataFrame, run, worker: Column, limit: int, now: Column) -> DataFrame:
    """One round of a worker: claims, runs, finishes.  run: claimed tasks -> (id, outcome, error)."""
    claimed = claim(tasks, worker, limit, now)
    mine = claimed.where((F.col("status") == "running") & (F.col("claimed_at") == now))
    return finish(claimed, run(mine), now)


def chain(tasks: DataFrame, root: int) -> DataFrame:
    """A root task and all that followed from it, in order."""
    return tasks.where(F.coalesce("root_id", "id") == root).orderBy("id")


def run_report(outcomes: DataFrame) -> DataFrame:
    """Runs by kind and outcome."""
    return outcomes.groupBy("kind", "outcome").agg(F.count("*").alias("runs"))


def poll(pending: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, status) and the service's (id, state, failed_query): done, failed, or still pending; a failed query changes nothing."""
    a = answers.groupBy("id").agg(F.max_by("state", F.col("state").isNotNull()).alias("_s"), F.every("failed_query").alias("_q"))
    new = F.when(F.coalesce("_q", F.lit(True)), F.col("status")).when(F.col("_s").isin("succeeded", "failed"), F.col("_s")).otherwise(F.col("status"))
    outcome = F.when(F.col("_q").isNull(), "not_asked").when(F.col("_q"), "query_failed").when(F.col("_s").isin("succeeded", "failed"), "settled").otherwise("waiting")
    return pending.join(a, "id", "left").withColumn("status", new).withColumn("poll", outcome).drop("_s", "_q")


def approve(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, review_status) after verdicts (id, approve): only pending items change; a rejection outweighs approvals."""
    v = verdicts.groupBy("id").agg(F.every("approve").alias("_a"))
    new = F.when((F.col("review_status") == "pending") & F.col("_a"), "approved").when((F.col("review_status") == "pending") & ~F.col("_a"), "rejected").otherwise(F.col("review_status"))
    return items.join(v, "id", "left").withColumn("review_status", new).drop("_a")


def answer_tickets(tickets: DataFrame, answers: DataFrame) -> DataFrame:
    """Open tickets with a non-blank answer (ticket_id, answer, knowledge_item_id) are answered, once; the least item wins."""
    a = answers.where(F.trim("answer") != "").groupBy(F.col("ticket_id").alias("id")).agg(F.min(F.struct("knowledge_item_id", "answer")).alias("_a"))
    t = tickets.join(a, "id", "left")
    hit = F.col("_a").isNotNull() & (F.col("status") == "open")
    return t.withColumns({"status": F.when(hit, "answered").otherwise(F.col("status")), "answer": F.when(hit, F.col("_a.answer")).otherwise(F.col("answer")), "knowledge_item_id": F.when(hit, F.col("_a.knowledge_item_id")).otherwise(F.col("knowledge_item_id"))}).drop("_a")


def propose_aliases(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(product_id, alias, times) with how often each was found added; names are cut to 60 characters, nulls left out."""
    new = found.where("product_id is not null and alias is not null").groupBy("product_id", F.substring("alias", 1, 60).alias("alias")).agg(F.count("*").alias("times"))
    return stored.select("product_id", "alias", F.col("times").cast("long")).unionByName(new).groupBy("product_id", "alias").agg(F.sum("times").alias("times"))


def apply_aliases(products: DataFrame, approved: DataFrame) -> DataFrame:
    """(product_id, aliases) with approved (product_id, alias) at the end, each once, in order of name."""
    a = approved.where("alias is not null").groupBy("product_id").agg(F.sort_array(F.collect_set("alias")).alias("_a"))
    none = F.array().cast("array<string>")
    return products.join(a, "product_id", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("_a", none))).drop("_a")


def index_candidates(items: DataFrame, limit: int = 500) -> DataFrame:
    """Reviewed items that are not deleted and whose vector is missing or stale, the least ids first; a batch."""
    return items.where("review_status in ('approved', 'revised') and embedding_status in ('pending', 'stale') and not coalesce(deleted, false)").orderBy("id").limit(limit)


def mark(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """embedding_status of the ids set: `stale` after a change, `done` once indexed; deleted items stay as they are."""
    hit = items.join(ids.select("id").distinct().withColumn("_m", F.lit(True)), "id", "left")
    return hit.withColumn("embedding_status", F.when(F.col("_m") & ~F.coalesce("deleted", F.lit(False)), status).otherwise(F.col("embedding_status"))).drop("_m")


def providers(index: DataFrame) -> DataFrame:
    """Vectors of an index by provider."""
    return index.groupBy("provider").agg(F.count("*").alias("vectors"))


def build_index(items: DataFrame, index: DataFrame, embed, provider: str, limit: int | None = 500, rebuild: bool = False) -> DataFrame:
    """The index (id, provider, text) after a run: incremental (candidates only, by `limit`), or rebuilt from all reviewed items.

    Refuses to add to vectors of another provider, and to rebuild under a limit.
    embed: rows (id, text) -> rows (id, text) with vectors, as the caller has them.
    """
    if rebuild and limit is not None:
        raise ValueError("a rebuild takes all items, so it has no limit")
    if not rebuild:
        other = index.where(F.col("provider") != provider).limit(1).count()
        if other:
            raise ValueError("the index has vectors of another provider: rebuild it")
    todo = items.where("review_status in ('approved', 'revised') and not coalesce(deleted, false)") if rebuild else index_candidates(items, limit or 1 << 30)
    new = embed(todo.select("id", F.col("content").alias("text"))).withColumn("provider", F.lit(provider))
    kept = index.limit(0) if rebuild else index.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new.select(*index.columns))


def supersede(rows: DataFrame, source: str, prefix: str, as_of: Column) -> DataFrame:
    """Rows whose source starts with `prefix#` are marked deleted; literal, so no pattern characters."""
    hit = F.startswith(F.col(source), F.lit(prefix + "#"))
    return rows.withColumns({"deleted": F.coalesce(F.col("deleted"), F.lit(False)) | F.coalesce(hit, F.lit(False)), "deleted_at": F.when(F.coalesce(hit, F.lit(False)) & ~F.coalesce("deleted", F.lit(False)), as_of).otherwise(F.col("deleted_at"))})


def replace_wholesale(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows, where a key that new rows have keeps none of its old ones."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def refund(orders: DataFrame, asked: DataFrame) -> DataFrame:
    """Paid, shipped and delivered orders that are asked for become refunding, and remember what they were."""
    o = orders.join(asked.select("order_id").distinct().withColumn("_r", F.lit(True)), "order_id", "left")
    hit = F.col("_r") & F.col("status").isin("paid", "shipped", "delivered")
    return o.select(*[c for c in orders.columns if c not in ("status", "prior_status")], F.when(hit, F.col("status")).otherwise(F.col("prior_status")).alias("prior_status"), F.when(hit, "refunding").otherwise(F.col("status")).alias("status"))


def refuse_refund(orders: DataFrame, refused: DataFrame) -> DataFrame:
    """Refunding orders whose refund is refused are again what they were."""
    o = orders.join(refused.select("order_id").distinct().withColumn("_r", F.lit(True)), "order_id", "left")
    hit = F.coalesce(F.col("_r"), F.lit(False)) & (F.col("status") == "refunding") & F.col("prior_status").isNotNull()
    return o.withColumn("_s", F.when(hit, F.col("prior_status")).otherwise(F.col("status"))).withColumn("prior_status", F.when(hit, F.lit(None)).otherwise(F.col("prior_status"))).withColumn("status", F.col("_s")).drop("_s", "_r")


def release_expired(orders: DataFrame, expired: DataFrame) -> DataFrame:
    """Pending orders among those expired are cancelled."""
    o = orders.join(expired.select("order_id").distinct().withColumn("_x", F.lit(True)), "order_id", "left")
    return o.withColumn("status", F.when(F.col("_x") & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status"))).drop("_x")


# An asset's event, the states it may leave, the state it leads to.
ASSET_MOVES = [("submit", ["draft", "rejected"], "reviewing"), ("approve", ["reviewing"], "approved"), ("reject", ["reviewing"], "rejected"), ("publish", ["approved", "offline"], "online"), ("withdraw", ["online"], "offline"), ("archive", ["offline", "rejected"], "archived")]


def review_assets(assets: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asset_id, status, path) by (asset_id, decision, note) -> assets approved or rejected, and decisions refused with why.

    Only an asset whose job succeeded and whose path is not blank may be
    approved; a rejection needs a note; unknown assets and decisions are refused.
    """
    j = decisions.join(assets, "asset_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = (
        F.when(F.col("status").isNull(), "unknown_asset").when(~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)), "unknown_decision").when(F.col("status") != "succeeded", "not_succeeded")
        .when((F.col("decision") == "approve") & blank("path"), "no_file").when((F.col("decision") == "reject") & blank("note"), "no_note")
    )
    judged = j.withColumn("why", why)
    done = judged.where("why is null").groupBy("asset_id").agg(F.max("decision").alias("_d"))  # a rejection outweighs
    out = assets.join(done, "asset_id", "left").withColumn("status", F.when(F.col("_d") == "approve", "approved").when(F.col("_d") == "reject", "rejected").otherwise(F.col("status"))).drop("_d")
    return out, judged.where("why is not null").select("asset_id", "decision", "why")


def find_assets(assets: DataFrame, product: int | None = None, modality: str | None = None, scene: str | None = None, status: str = "online", limit: int = 50) -> DataFrame:
    """Assets that all given conditions hold for, the newest first; a search of `limit` rows."""
    ok = F.col("status") == status
    if product is not None:
        ok &= F.col("product_id") == product
    if modality is not None:
        ok &= F.col("modality") == modality
    if scene is not None:
        ok &= F.array_contains("scenes", scene)
    return assets.where(ok).orderBy(F.desc("created_at"), "asset_id").limit(limit)


def answer_assets(answers: DataFrame, of_items: DataFrame, of_products: DataFrame, limit: int = 3) -> DataFrame:
    """(answer, item_ids, product_id) -> its assets, those of its items before the product's, each once, `limit` of an answer."""
    # an answer's assets are among the `limit` least of each of its items and of its product: what items repeat of the product's counts as theirs
    least = lambda rows, key, n: rows.distinct().withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("asset_id"))).where(F.col("_r") <= n).drop("_r")
    a = answers.select("answer", F.explode("item_ids").alias("item_id")).join(least(of_items.select("item_id", "asset_id"), "item_id", limit), "item_id").select("answer", "asset_id", F.lit(0).alias("source"))
    b = answers.select("answer", "product_id").join(least(of_products.select("product_id", "asset_id"), "product_id", limit), "product_id").select("answer", "asset_id", F.lit(1).alias("source"))
    once = a.unionAll(b).groupBy("answer", "asset_id").agg(F.min("source").alias("source"))
    r = F.row_number().over(W.partitionBy("answer").orderBy("source", "asset_id"))
    return once.withColumn("rank", r).where(F.col("rank") <= limit)


def new_files(files: DataFrame, *stored: DataFrame) -> DataFrame:
    """(path, content) -> one file for each content that none of the stored tables (file_sha256) has; the least path."""
    f = files.select("path", F.sha2("content", 256).alias("file_sha256")).groupBy("file_sha256").agg(F.min("path").alias("path"))
    for s in stored:
        f = f.join(s.select("file_sha256").distinct(), "file_sha256", "left_anti")
    return f


def trace_rows(traces: DataFrame) -> DataFrame:
    """Traces fit for their table: strings cut, scores within -9 and 9, nulls as empty."""
    cut = {"rewritten_query": 512, "handover_reason": 64, "model": 64, "error": 512}
    new = {c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in cut.items() if c in traces.columns}
    return traces.withColumns(new | {"max_score": F.least(F.greatest(F.coalesce("max_score", F.lit(0.0)), F.lit(-9.0)), F.lit(9.0))})


def recent_traces(traces: DataFrame, limit: int = 50, handover_only: bool = False) -> DataFrame:
    """The latest traces; a report of `limit` rows."""
    return (traces.where("handover") if handover_only else traces).orderBy(F.desc("id")).limit(limit)


def merchant_orders(orders: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The latest orders of a status, or of all; the limit is held within 1 and 200."""
    return (orders if status is None else orders.where(F.col("status") == status)).orderBy(F.desc("order_id")).limit(min(200, max(1, limit)))


def job_stats(batch: str, stats: DataFrame) -> DataFrame:
    """(batch_id, stats): a one-row table of figures as JSON."""
    return stats.select(F.lit(batch).alias("batch_id"), F.to_json(F.struct(*stats.columns)).alias("stats"))


def append_once(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and the new ones whose keys are not stored; of new rows alike in key, one."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti"))


def layer_counts(**layers: DataFrame) -> DataFrame:
    """Rows of each table, and those a flag column `pending` holds for, one row a layer."""
    out = None
    for name, rows in layers.items():
        pending = F.count_if("pending") if "pending" in rows.columns else F.lit(0).cast("long")
        one = rows.agg(F.count("*").alias("rows"), pending.alias("pending")).select(F.lit(name).alias("layer"), "rows", "pending")
        out = one if out is None else out.unionAll(one)
    return out


def funnel_survival(stages: DataFrame) -> DataFrame:
    """(pos, gate, input, input_unit, output, output_unit) -> a metric for each gate: survival in percent of the base, or the yield.

    The base is the first input; a gate that turns one unit into another reports
    its yield, and what it gives out is the base of the gates after it.
    """
    order = W.orderBy("pos")  # a few gates
    changed = F.col("output_unit") != F.col("input_unit")
    other = F.col("input_unit") != F.lag("output_unit").over(order)
    start = F.when(F.lag("pos").over(order).isNull() | other, F.col("input")).when(F.lag(changed).over(order), F.lag("output").over(order))
    base = F.last(start, ignorenulls=True).over(order)
    metric = F.when(changed, F.coalesce(F.try_divide("output", "input"), F.lit(0.0))).otherwise(F.coalesce(F.try_divide(F.col("output") * 100, base), F.lit(0.0)))
    return stages.select("gate", "input", "output", F.when(changed, "yield").otherwise("survival").alias("kind"), F.round(metric, 6).alias("metric"))
