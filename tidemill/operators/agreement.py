"""Agreement of raters: Krippendorff's alpha, Spearman's rho, the golden median and the gate before a judge goes live.

Alpha's coincidence matrix is never made of pairs of raters.  A unit's m
ratings bring the pairs' mean distance, and for all three scales that is a
matter of sums: nominal, m^2 less the squares of equal ratings' counts;
interval, 2 (m sum x^2 - (sum x)^2); ordinal, the same over mid-ranks, as the
ordinal distance of two values is the distance of their mid-ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

SCALES = ("nominal", "ordinal", "interval")


def mid_ranks(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """(by, value, n) with one row a value -> with `below`: the n of smaller values of its group, plus half its own.

    Values are dealt into ranges over all tasks; what lies before a range is
    the sum of the ranges before it, so no group is ranked in one task.
    """
    ranged = cut(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_part").agg(F.sum(n).alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    inside = F.sum(n).over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("_inside", inside).join(before.drop("_n"), [*by, "_part"])
    return out.select(*by, value, n, (F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)) + F.col(n) / 2).alias("below"))


def alpha(ratings: DataFrame, batch: str, unit: str, value: str) -> DataFrame:
    """(batch, unit, value), a row a rating -> (batch, pairable, nominal, ordinal, interval).

    Any number of raters and any gaps: null ratings, and units with one rating,
    cannot be paired and are left out (null batches and units too).  Alpha is
    null where no rating can be paired or all pairable ratings are equal.
    """
    r = ratings.select(F.col(batch).alias("_b"), F.col(unit).alias("_u"), F.col(value).cast("double").alias("_v")).where("_b is not null and _u is not null and _v is not null")
    cells = r.groupBy("_b", "_u", "_v").agg(F.count("*").alias("_k"))
    units = cells.groupBy("_b", "_u").agg(F.sum("_k").alias("_m")).where("_m > 1")
    cells = cut(cells.join(units, ["_b", "_u"]))
    totals = cells.groupBy("_b", "_v").agg(F.sum("_k").alias("_n"))
    ranks = cut(mid_ranks(totals, ["_b"], "_v", "_n"))

    def spread(weight: str, x: str) -> Column:
        """Twice (w sum k x^2 - (sum k x)^2): the squared distances of all ordered pairs."""
        k, v = F.col(weight), F.col(x)
        return 2 * (F.sum(k) * F.sum(k * v * v) - F.sum(k * v) * F.sum(k * v))

    per_unit = cells.join(ranks.select("_b", "_v", F.col("below").alias("_r")), ["_b", "_v"]).groupBy("_b", "_u", "_m").agg((F.col("_m") * F.col("_m") - F.sum(F.col("_k") * F.col("_k"))).alias("nominal"), spread("_k", "_r").alias("ordinal"), spread("_k", "_v").alias("interval"))
    seen = per_unit.groupBy("_b").agg(F.sum("_m").alias("_n"), *[F.sum(F.col(s) / (F.col("_m") - 1)).alias(f"_o_{s}") for s in SCALES])
    n = F.sum("_n")
    due = ranks.groupBy("_b").agg((n * n - F.sum(F.col("_n") * F.col("_n"))).alias("_e_nominal"), spread("_n", "below").alias("_e_ordinal"), spread("_n", "_v").alias("_e_interval"))
    j = seen.join(due, "_b")
    return j.select(F.col("_b").alias(batch), F.col("_n").alias("pairable"), *[F.when(F.col(f"_e_{s}") > 0, 1 - (F.col("_n") - 1) * F.col(f"_o_{s}") / F.col(f"_e_{s}")).alias(s) for s in SCALES])


def golden(ratings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median of each unit's ratings, and how many there are; units without any are left out."""
    return ratings.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(F.col(value).cast("double")).alias("golden"), F.count("*").alias("raters"))


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, rho): the correlation of mid-ranks; rows without both values are left out, rho is null where one never varies."""
    r = cut(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(by).isNotNull()).select(by, a, b))
    for c, name in ((a, "_ra"), (b, "_rb")):
        ranks = mid_ranks(r.groupBy(by, c).agg(F.count("*").alias("_n")), [by], c, "_n")
        r = r.join(ranks.select(by, c, F.col("below").alias(name)), [by, c])
    return r.groupBy(by).agg(F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("rho"))


def judge_gate(ratings: DataFrame, judged: DataFrame, least_alpha: float = 0.7, least_rho: float = 0.7, most_error: float = 0.5, far: float = 2.0, most_far: float = 0.05) -> DataFrame:
    """ratings (batch, unit, rater, value) and judged (batch, unit, score) -> a row a batch: sample_count, alpha, rho, mae, far_share, why, passed.

    The raters' own agreement (ordinal alpha) is asked first: where it fails,
    the rubric is at fault, whatever the judge does.  Units that only one side
    has count for neither; a batch without any fails as `no_sample`.  A rater's
    repeated ratings of a unit, and a unit judged twice, count as often.
    """
    g = cut(golden(ratings, ["batch", "unit"], "value").join(judged, ["batch", "unit"]).where("score is not null"))
    gap = F.abs(F.col("golden") - F.col("score"))
    errors = g.groupBy("batch").agg(F.count("*").alias("sample_count"), F.avg(gap).alias("mae"), F.avg((gap >= far).cast("double")).alias("far_share"))
    j = alpha(ratings, "batch", "unit", "value").select("batch", F.col("ordinal").alias("alpha")).join(errors, "batch", "full").join(spearman(g, "batch", "golden", "score"), "batch", "left")
    why = F.when(F.col("sample_count").isNull(), "no_sample").when(~F.coalesce(F.col("alpha") >= least_alpha, F.lit(False)), "raters").when(~F.coalesce(F.col("rho") >= least_rho, F.lit(False)), "rho").when(F.col("mae") > most_error, "error").when(F.col("far_share") > most_far, "far")
    return j.select("batch", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), "alpha", "rho", "mae", "far_share", why.alias("why"), why.isNull().alias("passed"))
