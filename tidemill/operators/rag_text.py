"""Text steps around retrieval: chunks, replies, marks, keys and lenient JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds that are never cut; ends of sentences.
ATOMIC = ["qa", "faq", "spec"]
SENTENCE_END = r"(?<=[。！？；!?;])\s*"


def sentences(text: Column) -> Column:
    """Sentences with their end marks, blanks dropped."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def packed(parts: Column, size: int, overlap: int = 0) -> Column:
    """Sentences joined into chunks of at most `size` characters.

    A chunk begins with the last sentences of the one before, up to `overlap`
    characters, if they fit; a longer sentence is a chunk of its own.
    """
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        fits = F.length(acc["open"]) + F.length(s) <= size
        tail = F.when(F.length(acc["open"]) > overlap, F.substring(acc["open"], -overlap, overlap) if overlap else F.lit("")).otherwise(F.lit(""))
        begin = F.when(F.length(tail) + F.length(s) <= size, F.concat(tail, s)).otherwise(s)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, F.concat(acc["open"], s)).otherwise(begin).alias("open"))

    end = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    return F.aggregate(parts, first, step, end)


def chunks(items: DataFrame, script_size: int = 400, script_overlap: int = 50, policy_size: int = 500) -> DataFrame:
    """(id, biz_type, title, content) -> (id, seq, heading_path, text).

    Atomic kinds are one chunk, title and text; scripts are packed sentences
    with an overlap; policies are cut at headings, then packed; others are atomic.
    """
    text = F.coalesce("content", F.lit(""))
    parts = F.filter(F.split(text, r"(?m)^(?=#{1,6}\s)"), lambda s: F.trim(s) != "")
    heading = lambda s: F.regexp_extract(s, r"^#{1,6}\s+(.*)", 1)
    body = lambda s: F.trim(F.regexp_replace(s, r"^#{1,6}\s+.*\n?", ""))
    policy = F.flatten(F.transform(parts, lambda p: F.transform(packed(sentences(body(p)), policy_size), lambda t: F.struct(heading(p).alias("heading_path"), t.alias("text")))))
    script = F.transform(packed(sentences(text), script_size, script_overlap), lambda t: F.struct(F.lit("").alias("heading_path"), t.alias("text")))
    whole = F.array(F.struct(F.lit("").alias("heading_path"), F.trim(F.concat_ws("\n", "title", text)).alias("text")))
    made = F.when(F.col("biz_type") == "script", script).when(F.col("biz_type") == "policy", policy).otherwise(whole)
    return items.select("id", F.posexplode(made).alias("seq", "c")).select("id", "seq", "c.heading_path", "c.text").where("text <> ''")


def replies(text: Column, longest: int = 200) -> Column:
    """An answer cut at sentence ends into messages of at most `longest` characters."""
    return packed(sentences(text), longest)


def order_number(text: Column) -> Column:
    """The first run of 10 to 24 digits, or null."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{10,24})(?!\d)", 1), F.lit(""))


def task_key(kind: Column, product: Column, text: Column) -> Column:
    """kind:product: and 16 hex digits that equal questions share, whatever their case and punctuation."""
    return F.concat_ws(":", kind, F.coalesce(product.cast("string"), F.lit("-")), F.substring(F.sha1(F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))), 1, 16))


def cited(answer: Column, hits: Column) -> Column:
    """The hits whose mark [#id] the answer holds."""
    return F.filter(hits, lambda h: F.contains(answer, F.concat(F.lit("[#"), h["item_id"].cast("string"), F.lit("]"))))


def picked(answer: Column, valid: Column) -> Column:
    """Ids marked in the answer, in its order, each once, valid ones only."""
    ids = F.transform(F.regexp_extract_all(answer, F.lit(r"\[#(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    return F.filter(F.array_distinct(ids), lambda x: F.array_contains(valid, x))


def lenient_json(text: Column, schema: str) -> Column:
    """JSON from a model's answer: out of a fence, else from the first { to the last }; null if it cannot be read."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.from_json(F.coalesce(fenced, bare), schema)


def ask_model(rows: DataFrame, client, column: str, out: str = "answer", status: str = "status") -> DataFrame:
    """Adds a model's answer and `ok`, `drop` or `infra` for each row.

    client(list of texts) -> list of texts, None where the model refuses; it is
    called a batch at a time.  What it raises marks the whole batch as infra, so
    that these rows get no outcome; ValueError is a wrong set-up and stops the job.
    """
    names = [f.name for f in rows.schema.fields]

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            try:
                got = client(f[column].tolist())
                f[out], f[status] = got, ["drop" if x is None else "ok" for x in got]
            except ValueError:
                raise
            except Exception:
                f[out], f[status] = None, "infra"
            yield f[[*names, out, status]]

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` string, `{status}` string")


def ask_each(rows: DataFrame, client, column: str, in_a_row: int = 10, out: str = "answer", status: str = "status", failure: str = "failure") -> DataFrame:
    """Adds a model's answer to each row's text, a status and the kind of failure.

    client(text) -> text, or None where the model refuses (`drop`).  What it
    raises is no answer: the row is `infra` with the name of what was raised, so
    that it gets no outcome and comes again.  After `in_a_row` such rows one
    after the other a task takes the service for gone and asks no more: the rest
    of its rows are `infra` with `not_asked`.  An answer, a refusal too, starts
    the count anew.  ValueError is a wrong set-up and stops the job.  A null
    text is not asked: `drop`.
    """
    names = [f.name for f in rows.schema.fields]

    def run(frames: Iterator[pd.DataFrame]):
        failed = 0
        for f in frames:
            got = []
            for text in f[column].tolist():
                if text is None:
                    got.append((None, "drop", None))
                elif failed >= in_a_row:
                    got.append((None, "infra", "not_asked"))
                else:
                    try:
                        answer = client(text)
                        failed = 0
                        got.append((answer, "drop" if answer is None else "ok", None))
                    except ValueError:
                        raise
                    except Exception as e:
                        failed += 1
                        got.append((None, "infra", type(e).__name__))
            f[out], f[status], f[failure] = (pd.Series([g[i] for g in got], dtype=object, index=f.index) for i in range(3))
            yield f[[*names, out, status, failure]]

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` string, `{status}` string, `{failure}` string")
