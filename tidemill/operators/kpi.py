"""Service quality by rule: response times, follow-ups, vetoes, and the weighted score of a session."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.rules import ABSOLUTE_WORDS, MEDICAL_WORDS, PROMISE_REWRITES, has_any


@dataclass(frozen=True)
class Template:
    """Weights of a post's metrics, the seconds that count, and words that fail a session whatever else it is."""

    # Weights in percent of first and mean response, late replies and follow-ups; seconds until a reply is late, and of silence.
    weights: dict[str, float] = field(default_factory=lambda: {"first": 8.0, "mean": 7.0, "late": 5.0, "follow": 5.0})
    late_s: float = 180.0
    silent_s: float = 300.0
    #: Up to so many seconds a reply has full marks; from there they fall to none at late_s.
    prompt_s: float = 30.0
    veto: tuple[str, ...] = (*ABSOLUTE_WORDS, *MEDICAL_WORDS, *(w for w, _ in PROMISE_REWRITES))


def metrics(turns: DataFrame, t: Template | None = None) -> DataFrame:
    """(session, at, turn, role, text) -> a row a session: first_s, mean_s, replies, late, silences, followed, vetoed.

    A reply is a staff turn right after a user's; first_s is from the user's
    first turn to the first reply.  A silence is a gap of more than silent_s after a
    staff turn; it is followed if the staff speak next.  What comes after the
    last turn is unknown and counts for nothing.  Turns of other roles are left
    out first, and so are rows without session or time; a session without a
    reply has null times.  Rows of one time come in order of turn.
    """
    t = t or Template()
    r = turns.where("session is not null and at is not null and role in ('user', 'agent')").withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))
    w = W.partitionBy("session").orderBy("_us", "turn")
    gap = (F.col("_us") - F.lag("_us").over(w)) / 1e6
    r = r.withColumn("_gap", gap).withColumn("_before", F.lag("role").over(w))
    is_reply = (F.col("role") == "agent") & (F.col("_before") == "user")
    silence = (F.col("_before") == "agent") & (F.col("_gap") > t.silent_s)
    out = r.groupBy("session").agg(
        ((F.min(F.when(is_reply, F.col("_us"))) - F.min(F.when(F.col("role") == "user", F.col("_us")))) / 1e6).alias("first_s"),
        F.avg(F.when(is_reply, F.col("_gap"))).alias("mean_s"), F.count_if(is_reply).alias("replies"), F.count_if(is_reply & (F.col("_gap") > t.late_s)).alias("late"),
        F.count_if(silence).alias("silences"), F.count_if(silence & (F.col("role") == "agent")).alias("followed"),
        F.coalesce(F.bool_or((F.col("role") == "agent") & has_any(F.col("text"), list(t.veto))), F.lit(False)).alias("vetoed"),
    )
    return out


def scores(found: DataFrame, t: Template | None = None) -> DataFrame:
    """metrics -> with score (0 to 100) and grade: `veto`, `unrated` or `rated`.

    A vetoed session scores 0.  Each metric is worth 0 to 1: times are full up
    to prompt_s and nothing from late_s on, late replies 1 / (1 + late),
    follow-ups their share.  Metrics a session has nothing for are left out,
    and the weights of the others made up to the whole; without any it is
    `unrated`, its score null.
    """
    t = t or Template()
    timed = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(t.late_s) - F.col(c)) / (t.late_s - t.prompt_s)))
    worth = {"first": timed("first_s"), "mean": timed("mean_s"), "late": F.when(F.col("replies") > 0, F.lit(1.0) / (1 + F.col("late"))), "follow": F.try_divide("followed", "silences")}
    total = weight = F.lit(0.0)
    for name, x in worth.items():
        x = F.when(F.col("first_s").isNull(), None).otherwise(x) if name == "first" else F.when(F.col("mean_s").isNull(), None).otherwise(x) if name == "mean" else x
        total = total + F.coalesce(x * t.weights[name], F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), F.lit(t.weights[name])).otherwise(F.lit(0.0))
    rated = F.try_divide(total * 100, weight)
    return found.withColumn("score", F.when(F.col("vetoed"), 0.0).otherwise(rated)).withColumn("grade", F.when(F.col("vetoed"), "veto").when(rated.isNull(), "unrated").otherwise("rated"))


def by_agent(scored: DataFrame, owners: DataFrame, least: int = 5) -> DataFrame:
    """scores and owners (session, agent) -> a row an agent: sessions, vetoes, mean score of rated ones, null below `least` of them."""
    j = scored.join(owners.select("session", "agent").distinct(), "session")
    n = F.count_if(F.col("grade") == "rated")
    return j.groupBy("agent").agg(F.count("*").alias("sessions"), F.count_if("vetoed").alias("vetoes"), F.when(n >= least, F.avg(F.when(F.col("grade") == "rated", F.col("score")))).alias("score"))
