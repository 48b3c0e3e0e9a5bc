"""Training sets: conversations as messages, pairs of a chosen and a rejected answer, and even shares of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least keys are found by cells of this many; only the cell in which a quota ends is ranked.
CELLS = 4096


def merged_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, run, role, text): neighbours of one role joined by line ends, in order.

    Other roles than user and agent, and null and blank texts, are left out
    first, so that they part no run.
    """
    t = turns.where("role in ('user', 'agent') and trim(text) <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))
    r = t.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return r.groupBy("conv_id", "run", "role").agg(text.alias("text")).select("conv_id", "run", "role", "text")


def sft_messages(turns: DataFrame, system: str, context: int = 4) -> DataFrame:
    """(conv_id, run, messages): for each answer of the staff, what a model would see and then say.

    messages begin with `system` (which holds no knowledge of goods), go on
    with at most `context` merged turns before the answer, from a user's turn
    on, and end in the answer.  Answers without a user's turn before them are
    no samples.
    """
    r = merged_turns(turns)
    w = Window.partitionBy("conv_id").orderBy("run").rowsBetween(-context, 0)
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    seen = r.withColumn("_seen", F.collect_list(F.struct(role.alias("role"), F.col("text").alias("content"))).over(w))
    opened = F.when(F.col("_seen")[0]["role"] == "assistant", F.slice("_seen", 2, context)).otherwise(F.col("_seen"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    out = seen.where("role = 'agent'").withColumn("_open", opened).where("size(_open) > 1")
    return out.select("conv_id", "run", F.concat(first, "_open").alias("messages"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def preference_pairs(good: DataFrame, bad: DataFrame, most_alike: float = 0.8, least_quality: float = 0.0) -> DataFrame:
    """good, bad (question, answer, quality) -> (question, chosen, rejected, alike).

    Of a question's good answers the best one counts (quality, then the least
    text), and it meets each different bad answer, never the same text; pairs
    over `most_alike` teach nothing and go.  Questions are compared without white
    space at their ends.  Null questions and answers take no part; a null
    quality is 0.
    """
    key = F.trim("question")
    q = F.coalesce("quality", F.lit(0.0))
    best = good.where("question is not null and answer is not null").where(q >= least_quality).groupBy(key.alias("question")).agg(F.min(F.struct((-q).alias("q"), "answer")).alias("b")).select("question", F.col("b.answer").alias("chosen"))
    other = bad.where("question is not null and answer is not null").select(key.alias("question"), F.col("answer").alias("rejected")).distinct()
    pairs = best.join(other, "question").where("chosen <> rejected").withColumn("alike", likeness(F.col("chosen"), F.col("rejected")))
    return pairs.where(F.col("alike") <= most_alike)


def water_level(counts: DataFrame, group: str, total: int) -> DataFrame:
    """(group, n) -> (group, n, quota): `total` rows shared out evenly; groups with less than the level give all.

    Groups are filled from the smallest on: each may take an equal share of
    what is left by then.  Quotas add up to the total, or to all rows if there
    are fewer; what does not divide goes to the last groups, in order of n and
    group.  A null group is a group.
    """
    w = Window.orderBy("n", F.col(group).asc_nulls_first())  # a row for each scene
    c = counts.withColumn("_i", F.row_number().over(w)).withColumn("_k", F.count("*").over(Window.partitionBy()))
    rows = F.array_sort(F.collect_list(F.struct("_i", F.col(group).alias("g"), "n", "_k")))

    def step(acc, x):
        share = F.least(x["n"], F.floor((F.lit(total) - acc["used"]) / (x["_k"] - x["_i"] + 1)))
        return F.struct((acc["used"] + share).alias("used"), F.concat(acc["out"], F.array(F.struct(x["g"].alias("g"), x["n"].alias("n"), share.alias("quota")))).alias("out"))

    kind = counts.schema[group].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<g {kind}, n bigint, quota bigint>>").alias("out"))
    return c.agg(F.aggregate(rows, start, step)["out"].alias("o")).select(F.inline("o")).select(F.col("g").alias(group), "n", "quota")


def first_by_key(rows: DataFrame, group: str, key: Column, quotas: DataFrame, ties: Column | None = None) -> DataFrame:
    """rows, with quotas (group, quota) -> each group's `quota` rows of least key (0 to 2^32 - 1), then of least `ties`.

    A group is never sorted as a whole: counts by cell tell in which cell the
    quota ends; rows of earlier cells are taken as they are, and only that
    cell is ranked.  Give keys that differ, such as hashes.
    """
    k = rows.withColumn("_key", key).withColumn("_tie", F.lit(0) if ties is None else ties).withColumn("_cell", F.floor(F.col("_key") * CELLS / float(1 << 32)))
    cells = k.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    q = quotas.select(F.col(group).alias("_g"), F.col("quota").alias("_quota"))
    ends = cells.withColumn("_upto", upto).join(q, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_upto") - F.col("_n") < F.col("_quota"))
    ends = ends.select("_g", F.col("_cell").alias("_c"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left"), (F.col("_upto") <= F.col("_quota")).alias("_whole"))
    j = k.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")))
    whole = j.where("_whole")
    part = j.where("not _whole").withColumn("_r", F.row_number().over(Window.partitionBy(group, "_cell").orderBy("_key", "_tie"))).where("_r <= _left")
    return whole.select(*rows.columns).unionAll(part.select(*rows.columns))


def hashed(key: Column) -> Column:
    """A number below 2^32 for a key, the same everywhere."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def balanced(samples: DataFrame, scene: str, key: str, total: int) -> DataFrame:
    """`total` samples, scenes as even as they can be, of each the ones of least hash of `key`."""
    quotas = water_level(samples.groupBy(scene).agg(F.count("*").alias("n")), scene, total)
    return first_by_key(samples, scene, hashed(F.col(key)), quotas, F.col(key))
