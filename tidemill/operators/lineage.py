"""Lineage of any depth: what follows from a row, and what goes when a user goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges (parent, child), roots (id) -> (root, id, depth): all that can be reached from each root, itself included at depth 0.

    Each round joins the ids found last with the edges and keeps those that are
    new to their root, so a cycle ends where it closes and depth is the
    shortest way.  There is no bound on depth or rows.  Null ends lead
    nowhere; repeated edges and roots count once; ids without edges are
    reached by themselves.
    """
    e = cut(edges.select(F.col("parent"), F.col("child")).where("parent is not null and child is not null").distinct())
    front = cut(roots.select(F.col("id").alias("root")).where("root is not null").distinct().select("root", F.col("root").alias("id")))
    found, depth = [front.withColumn("depth", F.lit(0))], 0
    seen = front
    while not front.isEmpty():
        depth += 1
        step = front.join(e, front.id == e.parent).select("root", F.col("child").alias("id")).distinct()
        front = cut(step.join(seen, ["root", "id"], "left_anti").select("root", "id"))
        found.append(front.withColumn("depth", F.lit(depth)))
        seen = seen.unionAll(front)
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def tops(parents: DataFrame) -> DataFrame:
    """(id, parent), one row an id -> (id, top, depth, least): the end of each id's chain of parents, and the steps to it.

    Pointers are doubled each round, so a chain or circle of n takes log2(n)
    rounds.  Two stretches that follow one another and have one least id pass
    it twice, so they go round a circle, whose least it is.  A round reads
    rows still going and what they ran into, not what is done: an id that no
    row ran into in one round is not run into in the next, from twice as far.
    An id without a parent, or whose parent is no id, is a top.  Ids that run
    into a circle have no top (null); their `least` is the least id of the
    circle.  An id that is its own parent is a top.
    """
    known = parents.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    leads = F.coalesce(F.col("_known") & (F.col("parent") != F.col("id")), F.lit(False))
    first = parents.select("id", "parent").join(known, "parent", "left")
    state = cut(first.select("id", F.when(leads, F.col("parent")).otherwise(F.col("id")).alias("up"), leads.cast("long").alias("dist"), (~leads).alias("done"), F.lit(False).alias("ring"), F.col("id").alias("m")))  # m: the least id from id on, `up` left out
    columns = state.columns
    done, going, steps = [state.where("done")], state.where("not done"), 1
    while not going.isEmpty():
        above = state.select(F.col("id").alias("up"), *[F.col(c).alias(f"_{c}") for c in columns[1:]])
        closes = ~F.col("_done") & (F.col("m") == F.col("_m"))
        m = F.when(F.col("_ring"), F.col("_m")).otherwise(F.least("m", "_m"))
        moved = going.join(above, "up").select("id", F.col("_up").alias("up"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.col("_done") | closes).alias("done"), (F.col("_ring") | closes).alias("ring"), m.alias("m"), F.when(F.col("_done"), F.col("up")).alias("met"))
        moved = cut(moved)
        met = moved.where("met is not null").select(F.col("met").alias("id"), "up", (F.col("dist") - steps).alias("dist"), "done", "ring", "m").dropDuplicates(["id"])
        moved = moved.select(*columns)
        done.append(moved.where("done"))
        going, state, steps = moved.where("not done"), moved.unionByName(met), 2 * steps
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", F.when(~F.col("ring"), F.col("up")).alias("top"), F.when(~F.col("ring"), F.col("dist")).alias("depth"), F.when(F.col("ring"), F.col("m")).otherwise(F.col("up")).alias("least"))


def chain_outcomes(tasks: DataFrame) -> DataFrame:
    """(id, parent_id, status) -> (root, tasks, depth, failed, open) of each chain of follow-up tasks.

    A chain starts at a task without a parent, or whose parent is not among
    the tasks.  A circle, with what hangs on it, is the chain of its least id,
    as if that had no parent.  Of a task's repeated rows one counts; tasks
    without an id do not.
    """
    t = cut(tasks.select("id", "parent_id", "status").where("id is not null").groupBy("id").agg(F.min(F.struct("parent_id", "status")).alias("_t")).select("id", "_t.parent_id", "_t.status"))
    found = cut(tops(t.select("id", F.col("parent_id").alias("parent"))))
    rings = cut(found.where("top is null").select("id", "least").join(t, "id"))
    if not rings.isEmpty():
        opened = rings.select("id", F.when(F.col("id") != F.col("least"), F.col("parent_id")).alias("parent"))
        found = found.where("top is not null").unionByName(cut(tops(opened)))
    every = found.select("id", F.col("top").alias("root"), "depth").join(t, "id")
    return every.groupBy("root").agg(F.count("*").alias("tasks"), F.max("depth").alias("depth"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("pending", "running")).alias("open"))


def derived(layers: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """What was made, over any number of steps, from the rows gone.

    layers: name -> (id, source_ref), a source_ref being "layer:id" of the row
    it was made from; gone: (ref) in the same form.  -> (layer, id, depth).
    Rows without a source_ref are made from nothing.  A row made from several
    has a row for each, and goes with any of them.
    """
    edges = None
    for name, rows in layers.items():
        e = rows.select(F.col("source_ref").alias("parent"), F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("child"))
        edges = e if edges is None else edges.unionAll(e)
    found = reach(edges, gone.select(F.col("ref").alias("id"))).groupBy("id").agg(F.min("depth").alias("depth"))
    return found.select(F.substring_index("id", ":", 1).alias("layer"), F.expr("substring(id, instr(id, ':') + 1)").alias("id"), "depth")


def erased(layers: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each layer without what derives from the rows gone, and the log of what went (layer, id, depth).

    The log is written first, so that a run that breaks off says what is left to do.
    """
    log = cut(derived(layers, gone))
    left = {name: rows.join(log.where(F.col("layer") == name).select(F.col("id").alias("_id")), F.col("id").cast("string") == F.col("_id"), "left_anti") for name, rows in layers.items()}
    return left, log


def past_retention(rows: DataFrame, at: str, now, days: int) -> DataFrame:
    """(ref) of rows older than `days` at `now`; rows without a time stay."""
    return rows.where(F.col(at) < now - F.make_interval(days=F.lit(days))).select("ref")
