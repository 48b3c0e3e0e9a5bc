"""Comparison of two groups by a Poisson bootstrap: one pass, weights by hash, red lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The chance of at most 0, 1, ... draws of one unit, of a Poisson variable of mean 1.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]


def draw_weight(unit: Column, draw: Column) -> Column:
    """How often a unit is drawn in a resampling: a Poisson variable by hash of both, the same on every run and machine."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", unit.cast("string"), draw.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    w = F.when(u < POISSON[0], 0)
    for i, p in enumerate(POISSON[1:], 1):
        w = w.when(u < p, i)
    return w.otherwise(len(POISSON))


def _drawn(units: DataFrame, draws: int) -> DataFrame:
    """Units with each draw in which they have a weight."""
    d = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return d.withColumn("w", draw_weight(F.col("unit"), F.col("draw"))).where("w > 0")


def _bounds(per_draw: DataFrame, tail: float) -> DataFrame:
    """(draw, diff) -> the interval that leaves `tail` of the draws on each side."""
    return per_draw.agg(F.percentile("diff", F.lit(tail)).alias("low"), F.percentile("diff", F.lit(1 - tail)).alias("high"))


def rate_difference(units: DataFrame, draws: int = 200, tail: float = 0.025) -> DataFrame:
    """(unit, grp, hits, tries), grp 1 treated and 0 not -> one row: rate_0, rate_1, diff, low, high.

    A unit (a user) is drawn whole.  Sums are by draw and group in the tasks,
    so what is shuffled is draws times groups, whatever the units.  Units of
    other groups, null counts and units without tries count for nothing; diff
    is null where a group has no tries, and the bounds leave out such draws.
    """
    u = units.where("grp in (0, 1) and tries > 0").select("unit", "grp", F.coalesce("hits", F.lit(0)).alias("hits"), "tries")
    rate = lambda g, h, t: F.try_divide(F.sum(F.when(F.col("grp") == g, h)), F.sum(F.when(F.col("grp") == g, t)))
    whole = u.agg(rate(0, F.col("hits"), F.col("tries")).alias("rate_0"), rate(1, F.col("hits"), F.col("tries")).alias("rate_1"))
    w = F.col("w")
    per = _drawn(u, draws).groupBy("draw").agg((rate(1, w * F.col("hits"), w * F.col("tries")) - rate(0, w * F.col("hits"), w * F.col("tries"))).alias("diff"))
    return whole.withColumn("diff", F.col("rate_1") - F.col("rate_0")).crossJoin(_bounds(per, tail))  # one row by one row


def quantile_difference(rows: DataFrame, share: float = 0.95, width: float = 1.0, draws: int = 200, tail: float = 0.025) -> DataFrame:
    """(unit, grp, value) -> one row: q_0, q_1, diff, low, high of a quantile, to the upper end of cells of `width`.

    Values are counted by unit and cell first; a draw's quantile is the first
    cell whose weighted count reaches the share.  What is shuffled is draws by
    groups by cells.
    """
    r = rows.where("grp in (0, 1) and value is not null").groupBy("unit", "grp", F.floor(F.col("value") / width).alias("cell")).agg(F.count("*").alias("n"))

    def quantile(cells: DataFrame, by: list[str]) -> DataFrame:
        up = Window.partitionBy(*by, "grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        c = cells.withColumn("_up", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by, "grp")))
        q = c.where(F.col("_up") >= share * F.col("_all")).groupBy(*by, "grp").agg(((F.min("cell") + 1) * width).alias("q"))
        return q.groupBy(*by).agg(*[F.max(F.when(F.col("grp") == g, F.col("q"))).alias(f"q_{g}") for g in (0, 1)])

    whole = quantile(r.groupBy("grp", "cell").agg(F.sum("n").alias("n")), [])
    per = quantile(_drawn(r, draws).groupBy("draw", "grp", "cell").agg(F.sum(F.col("w") * F.col("n")).alias("n")), ["draw"])
    return whole.withColumn("diff", F.col("q_1") - F.col("q_0")).crossJoin(_bounds(per.select("draw", (F.col("q_1") - F.col("q_0")).alias("diff")), tail))  # one row by one row


def decide(sizes: DataFrame, red: DataFrame, least_days: int = 7, least_sessions: int = 2000) -> DataFrame:
    """sizes (grp, sessions, days), red (name, low, high), where lower is worse -> (decision, why).

    A red line crossed for certain (high < 0) stops at once; else too few
    days or sessions in either group go on waiting; else a red line that may
    be crossed (low < 0 with high >= 0) goes on waiting too; else the share of
    the treated group may rise.
    """
    s = sizes.agg(F.coalesce(F.min("days"), F.lit(0)).alias("days"), F.coalesce(F.min("sessions"), F.lit(0)).alias("sessions"), F.count("*").alias("groups"))
    r = red.agg(F.coalesce(F.bool_or(F.col("high") < 0), F.lit(False)).alias("crossed"), F.coalesce(F.bool_or(F.col("low") < 0), F.lit(False)).alias("open"))
    short = (F.col("groups") < 2) | (F.col("days") < least_days) | (F.col("sessions") < least_sessions)
    j = s.crossJoin(r)  # one row by one row
    return j.select(F.when(F.col("crossed"), "stop").when(short | F.col("open"), "wait").otherwise("raise").alias("decision"), F.when(F.col("crossed"), "red_line").when(short, "too_few").when(F.col("open"), "uncertain").otherwise("clear").alias("why"))
