"""Candidates by nearness: texts within two edits by an equi-join, entities by weighted matchers, answers that contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .items import LEAST_LEAD, LEAST_MATCH, MATCH_WEIGHTS


def without_one(texts: Column) -> Column:
    """The texts and all that are left of them when one character is taken out, each once."""
    less = F.transform(texts, lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(texts, F.flatten(less)))


def deletions(text: Column, most: int = 2) -> Column:
    """The text with up to `most` characters taken out: two texts within as many edits have one of these in common."""
    out = F.array(text)
    for _ in range(most):
        out = without_one(out)
    return out


def near_texts(a: DataFrame, b: DataFrame, by: str, most: int = 2) -> DataFrame:
    """a, b (by, text) -> (by, text_a, text_b, edits): different texts of one `by` within `most` edits.

    Texts meet where they are equal after deletions, as 64-bit hashes, so
    that none meets what is not near but by chance; the distance is then
    measured.  Each text counts once on each side.  Nulls are near nothing;
    equal texts are an equi-join of the caller's.  A text of n characters
    brings about n^most / most! rows, so this is for names and titles.
    """
    side = lambda t, name: t.where(F.col(by).isNotNull() & F.col("text").isNotNull()).select(by, F.col("text").alias(name)).distinct().select(by, name, F.explode(F.transform(deletions(F.col(name), most), lambda x: F.xxhash64(x))).alias("_h"))
    met = side(a, "text_a").join(side(b, "text_b"), [by, "_h"]).where("text_a <> text_b").select(by, "text_a", "text_b").distinct()
    return met.withColumn("edits", F.levenshtein("text_a", "text_b")).where(F.col("edits") <= most)


def _least_two(products: DataFrame) -> DataFrame:
    """Of the products of each (live, mention), those of the two least ids."""
    w = Window.partitionBy("live", "mention").orderBy("product_id")
    known = products.where("live is not null and mention is not null").distinct()
    return known.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r")


def match_entities(spoken: DataFrame, scheduled: DataFrame, similar: DataFrame | None = None, most: int = 2, weight: float = 0.75) -> DataFrame:
    """(live, mention) by the products (live, product_id, name, aliases) of the same session -> best product, score, whether it binds by itself.

    Four matchers, of which a product's best counts: its name, an alias, a name
    within `most` edits, and, if given, `similar` (live, mention, product_id,
    cosine), a vector matcher's candidates, times `weight`.  Every matcher
    is an equi-join; no mention meets all products.  A match binds at
    LEAST_MATCH with a lead of more than LEAST_LEAD over the next product.
    Mentions without a candidate have no row; ties go to the least product_id.
    """
    exact, alias, near = MATCH_WEIGHTS
    m = spoken.select("live", "mention").where("live is not null and mention is not null").distinct()
    # products of one name or alias get the same from it, so what is best and next are of its two least ids
    names = _least_two(scheduled.select("live", "product_id", F.col("name").alias("mention")))
    found = m.join(names, ["live", "mention"]).select("live", "mention", "product_id", F.lit(exact).alias("score"))
    aliases = _least_two(scheduled.select("live", "product_id", F.explode("aliases").alias("mention")))
    found = found.unionAll(m.join(aliases, ["live", "mention"]).select("live", "mention", "product_id", F.lit(alias).alias("score")))
    close = near_texts(m.select("live", F.col("mention").alias("text")), names.select("live", F.col("mention").alias("text")), "live", most)
    close = close.withColumn("score", near * (1 - F.col("edits") / F.greatest(F.length("text_a"), F.length("text_b"), F.lit(1))))
    found = found.unionAll(close.join(names.withColumnRenamed("mention", "text_b"), ["live", "text_b"]).select("live", F.col("text_a").alias("mention"), "product_id", "score"))
    if similar is not None:
        found = found.unionAll(similar.join(m, ["live", "mention"], "left_semi").select("live", "mention", "product_id", (weight * F.col("cosine")).alias("score")))
    best = found.groupBy("live", "mention", "product_id").agg(F.max("score").alias("score"))
    # the two best of each mention, in the tasks first
    w = Window.partitionBy("live", "mention").orderBy(F.desc("score"), "product_id")
    two = best.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    one = two.groupBy("live", "mention").agg(F.min_by(F.struct("product_id", "score"), "rank").alias("b"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    lead = F.col("b.score") - F.col("second")
    return one.select("live", "mention", "b.product_id", F.round("b.score", 6).alias("score"), ((F.col("b.score") >= LEAST_MATCH) & (lead > LEAST_LEAD)).alias("bound"))


def contradictions(items: DataFrame, most: int = 2) -> DataFrame:
    """items (id, product_id, title, content) -> (a, b): answers on one product under near titles whose numbers differ.

    Titles within `most` edits, equal ones too, are found here.  Items of one
    title and the same numbers go on as one, the least id, so that copies of
    an answer bring no pairs.  Items without numbers contradict nothing.
    """
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))))
    i = items.where("product_id is not null and title is not null").select("id", "product_id", F.trim("title").alias("text"), numbers.alias("n")).where("size(n) > 0")
    i = cut(i.groupBy("product_id", "text", "n").agg(F.min("id").alias("id")))
    titles = i.select("product_id", "text").distinct()
    near = near_texts(titles, titles, "product_id", most).where("text_a < text_b").select("product_id", "text_a", "text_b")
    pairs = near.unionAll(titles.select("product_id", F.col("text").alias("text_a"), F.col("text").alias("text_b")))
    a, b = i.select("product_id", F.col("text").alias("text_a"), F.col("id").alias("a"), F.col("n").alias("na")), i.select("product_id", F.col("text").alias("text_b"), F.col("id").alias("b"), F.col("n").alias("nb"))
    both = pairs.join(a, ["product_id", "text_a"]).join(b, ["product_id", "text_b"]).where((F.col("na") != F.col("nb")) & ((F.col("text_a") != F.col("text_b")) | (F.col("a") < F.col("b"))))
    return both.select("product_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
