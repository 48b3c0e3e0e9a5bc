"""Tokens, shingles, hashes and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_grams(text: Column, n: int) -> Column:
    """Overlapping runs of n characters; a shorter text is one run, an empty one none."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).when(size > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def text_pieces(text: Column, n: int, size: int = 512) -> Column:
    """Pieces of a text, each going n - 1 characters into the next, so that every run of n characters lies in one.

    Finding a character costs as many steps as its place, so runs of a long text
    are taken from its pieces.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size + n - 1)))


def shingles(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams without white space."""
    # an element of a list is worked out once, an expression within a lambda at every place
    bare = F.array(F.regexp_replace(text, r"(?U)\s+", ""))
    grams = F.transform(bare, lambda t: F.flatten(F.transform(text_pieces(t, n), lambda p: char_grams(p, n))))
    return F.array_distinct(grams[0])


def tokenize(text: Column, mode: str = "word") -> Column:
    """Terms of a text: `word` splits on what is no letter or digit; `ref` drops
    white space, keeps placeholders and ASCII runs whole, and pairs CJK characters."""
    low = F.lower(text)
    if mode == "word":
        return F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), F.lit(1))
    low = F.regexp_replace(low, r"(?U)\s+", "")
    ascii_runs = F.regexp_extract_all(low, F.lit(r"(<[a-z_]+>|[a-z0-9]+)"), F.lit(1))
    cjk = F.array_join(F.regexp_extract_all(low, F.lit(r"([一-鿿])"), F.lit(1)), "")
    return F.concat(ascii_runs, char_grams(cjk, 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def min_hashes(grams: Column, n: int = 64) -> Column:
    """A signature of n seeded least hashes."""
    return F.array(*[F.array_min(F.transform(grams, lambda s, i=i: F.xxhash64(s, F.lit(i)))) for i in range(n)])


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dedup_key(biz_type: Column, title: Column, product_ids: Column) -> Column:
    """16 hex digits that equal items share: type, trimmed title and sorted products."""
    ids = F.concat(F.lit("["), F.array_join(F.sort_array(product_ids).cast("array<string>"), ", "), F.lit("]"))
    return F.substring(F.sha2(F.concat_ws("|", biz_type, F.trim(title), ids), 256), 1, 16)


def content_hash(turns: Column) -> Column:
    """SHA-256 of the compact JSON [[role, content], ...]."""
    return F.sha2(F.to_json(F.transform(turns, lambda t: F.array(t["role"], t["content"]))), 256)
