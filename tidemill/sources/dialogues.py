"""Dialogue files: tab-separated turns and JSON lines, as sessions of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

JSON_SCHEMA = """session_id STRING, id STRING, turns ARRAY<STRUCT<role STRING, content STRING, text STRING, images ARRAY<STRING>, image_urls ARRAY<STRING>, time STRING>>,
    dialogue ARRAY<STRUCT<role STRING, content STRING, text STRING, images ARRAY<STRING>, image_urls ARRAY<STRING>, time STRING>>"""
# How files name the speakers; whoever is not named is the user.
ROLES = {"0": "user", "1": "agent", "user": "user", "agent": "agent", "sys": "system", "system": "system"}


def parse_time(raw: Column) -> Column:
    """Three formats, then digits as seconds, or milliseconds above 1e11; else null."""
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    n = F.try_to_number(F.when(raw.rlike(r"^[0-9]{1,15}$"), raw), F.lit("9" * 15))
    digits = F.when(n > 100_000_000_000, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_seconds(n.cast("long")))
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats], digits)


def role(raw: Column) -> Column:
    """A file's speaker as user, agent or system."""
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(raw))), F.lit("user"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """session, sentence, speaker, text[, time] by tabs; rows of fewer fields and empty texts go.

    Runs of one session that another interrupts are sessions of their own, as
    the files are written session after session; `run` tells them apart.  A
    large file is read in splits: runs are numbered within each split, and a
    table of one row a split joins the runs that go on from one to the next.
    An empty file gives no row.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.split("value", "\t", -1).alias("f")).where("size(f) >= 4")
    rows = lines.select("file", "block", "line", F.col("f")[0].alias("session_no"), role(F.col("f")[2]).alias("role"), F.trim(F.col("f")[3]).alias("content"), parse_time(F.get("f", F.lit(4))).alias("said_at"))
    w = W.partitionBy("file", "block").orderBy("line")
    rows = rows.withColumn("_new", F.coalesce((F.lag("session_no").over(w) != F.col("session_no")).cast("long"), F.lit(0)))
    splits = rows.groupBy("file", "block").agg(F.min_by("session_no", "line").alias("_first"), F.max_by("session_no", "line").alias("_last"), F.sum("_new").alias("_runs"))
    by_file = W.partitionBy("file").orderBy("block")  # a row for each split
    splits = splits.withColumn("_begins", F.coalesce((F.lag("_last").over(by_file) != F.col("_first")).cast("long"), F.lit(1)))
    splits = splits.select("file", "block", (F.sum(F.col("_begins") + F.col("_runs")).over(by_file) - F.col("_runs")).alias("_from"))
    rows = rows.withColumn("_in", F.sum("_new").over(w)).join(splits, ["file", "block"]).withColumn("run", F.col("_from") + F.col("_in")).where("content <> ''")
    turn = F.struct("block", "line", "role", "content", "said_at")
    grouped = rows.groupBy("file", "run", "session_no").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda t, i: F.struct(i.alias("turn_index"), t["role"].alias("role"), t["content"].alias("content"), t["said_at"].alias("said_at")))
    return grouped.select("session_no", "run", turns.alias("turns"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One session a line, under either of the known field names; broken lines and empty sessions go.

    Turns with images but no text stay; turn_index is the place in the file.
    """
    raw = spark.read.schema(JSON_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    turns = F.coalesce("turns", "dialogue", F.array().cast("array<struct<role string, content string, text string, images array<string>, image_urls array<string>, time string>>"))

    def turn(t, i):
        images = F.coalesce(t["images"], t["image_urls"], F.array().cast("array<string>"))
        return F.struct(i.alias("turn_index"), role(t["role"]).alias("role"), F.coalesce(t["content"], t["text"], F.lit("")).alias("content"), images.alias("image_urls"), parse_time(t["time"]).alias("said_at"))

    kept = F.filter(F.transform(turns, turn), lambda t: (F.trim(t["content"]) != "") | (F.size(t["image_urls"]) > 0))
    return raw.select(F.coalesce("session_id", "id").alias("session_no"), kept.alias("turns")).where("session_no is not null and size(turns) > 0")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a file by its extension."""
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path)
    if path.endswith((".tsv", ".txt")):
        return read_tsv(spark, path)
    raise ValueError(f"unknown kind of dialogue file: {path}")
