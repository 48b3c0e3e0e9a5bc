"""The cleaning funnel's first gates over sessions of turns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.textops import content_hash, shingles
from ..sources.tables import cut
from . import greedy


@dataclass
class Gate1:
    """Gate 1's limits; the defaults are the Chinese profile."""

    min_turns: int = 2
    min_chars: int = 10
    max_chars: int = 8000
    letters: str = r"[一-鿿]"
    min_letter_ratio: float = 0.5
    contact: str = rules.CONTACT
    near: float = 0.85
    flagged: list[str] = field(default_factory=lambda: list(rules.FLAGGED_WORDS))


def latin_profile(**over) -> Gate1:
    """Gate 1 for European languages."""
    return Gate1(**({"letters": r"[A-Za-zÀ-ÿ]", "flagged": ["password", "guarantee"]} | over))


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row a session, turns in order; assistant counts as agent."""
    role = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    turn = F.struct(F.col("turn").alias("turn_index"), role.alias("role"), F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def content(turns: Column) -> Column:
    """The turns' texts, a line each."""
    return F.array_join(F.transform(turns, lambda t: F.coalesce(t["content"], F.lit(""))), "\n")


def gate1_whole(rows: DataFrame, limits: Gate1 | None = None) -> DataFrame:
    """gate1 and its last rule: in conv_id order, a session goes whose whole text is like one's that passed before it (Jaccard of four-character shingles, exact)."""
    g = limits or Gate1()
    found = cut(gate1(rows, g))
    passed = found.where("drop_reason is null").select("conv_id", content(F.col("turns")).alias("_text"))
    near = passed.join(greedy.without_similar(passed, "conv_id", shingles(F.col("_text")), g.near).withColumnRenamed("id", "conv_id"), "conv_id", "left_anti")
    near = cut(near.select("conv_id", F.lit("near_duplicate").alias("_near")))
    return found.join(near, "conv_id", "left").withColumn("drop_reason", F.coalesce("drop_reason", "_near")).drop("_near")


def gate1(rows: DataFrame, limits: Gate1 | None = None) -> DataFrame:
    """Adds drop_reason: the first rule of a session by itself that fails, or null for sessions that pass."""
    g = limits or Gate1()
    text = F.col("_text")
    bare = F.regexp_replace(text, r"(?U)\s", "")
    ratio = F.when(F.length(bare) > 0, F.regexp_count(bare, F.lit(g.letters)) / F.length(bare)).otherwise(F.lit(0.0))
    reason = (
        F.when(F.size("turns") < g.min_turns, "too_few_turns")
        .when(F.length(text) < g.min_chars, "too_short")
        .when(F.length(text) > g.max_chars, "too_long")
        .when(ratio < g.min_letter_ratio, "wrong_language")
        .when(text.rlike(rules.GARBLED), "garbled")
        .when(text.rlike(g.contact), "contact")
        .when(rules.has_any(text, g.flagged), "flagged_word")
    )
    return rows.withColumn("_text", content(F.col("turns"))).withColumn("drop_reason", reason).drop("_text")


def gate2_turns(rows: DataFrame, pleasantries: str = rules.PLEASANTRY_WORDS, system_phrases=None) -> DataFrame:
    """Sessions' turns with what gate 2 makes of each: system, system_phrase, pleasantry, empty or kept."""
    t = rows.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn_index", "t.role", "t.content")
    text = F.coalesce("content", F.lit(""))
    kind = (
        F.when(F.col("role") == "system", "system")
        .when(rules.is_system_phrase(text, system_phrases), "system_phrase")
        .when(F.length(F.trim(text)) == 0, "empty")
        .when(rules.is_pleasantry(text, pleasantries), "pleasantry")
        .otherwise("kept")
    )
    return t.withColumn("kind", kind)


def gate2(rows: DataFrame, min_turns: int = 2, **profile) -> DataFrame:
    """Sessions rebuilt from kept turns, numbered anew, that still hold a question and an answer."""
    kept = gate2_turns(rows, **profile).where("kind = 'kept'")
    kept = kept.withColumn("new_index", F.row_number().over(W.partitionBy("conv_id").orderBy("turn_index")) - 1)
    turn = F.struct(F.col("new_index").alias("turn_index"), "role", rules.parameterized(F.col("content"))["text"].alias("content"))
    out = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    has = lambda role: F.exists("turns", lambda t: t["role"] == role)
    return out.where((F.size("turns") >= min_turns) & has("user") & has("agent"))


def fix_roles(turns: Column) -> Column:
    """A user turn that follows a user turn and reads like an answer is the agent's; it sees fixed roles.

    Turns are folded in order, so that a role set right counts for the next turn.
    """
    empty = F.slice(turns, 1, 0)

    def step(acc, t):
        last = F.element_at(acc, -1)
        flip = (F.size(acc) > 0) & (t["role"] == "user") & F.coalesce(last["role"] == "user", F.lit(False)) & t["content"].rlike(r"^(亲|您好|您)[,，~～]?")
        return F.concat(acc, F.array(t.withField("role", F.when(flip, F.lit("agent")).otherwise(t["role"]))))

    # a get on an empty list would fail under ANSI rules, so the first turn starts the list
    return F.when(F.size(turns) > 0, F.aggregate(F.slice(turns, 2, 1 << 30), F.slice(turns, 1, 1), step)).otherwise(empty)


def append_new(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions whose content is neither stored nor repeated in the batch, the least conv_id of each."""
    hashed = found.withColumn("payload_hash", content_hash(F.col("turns")))
    first = hashed.withColumn("_n", F.row_number().over(W.partitionBy("payload_hash").orderBy("conv_id"))).where("_n = 1").drop("_n")
    return first.join(stored.select("payload_hash").distinct(), "payload_hash", "left_anti")


def unprocessed(ods: DataFrame, log: DataFrame, limit: int = 5000) -> DataFrame:
    """Sessions without an outcome, oldest first."""
    return ods.join(log.select("conv_id"), "conv_id", "left_anti").orderBy("conv_id").limit(limit)


def funnel(rows: DataFrame) -> DataFrame:
    """Sessions by drop reason; `passed` for those that no rule stops."""
    return rows.groupBy(F.coalesce("drop_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("sessions"))
