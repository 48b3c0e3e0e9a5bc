"""A table function that cuts documents into chunks, line by line, with its place among the headings as state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
# Beginnings of a clause in a policy, and ends of sentences.
CLAUSE = re.compile(r"^\s*(?:第[一二三四五六七八九十百零\d]+[条款章]|[一二三四五六七八九十]+、|\(?\d{1,3}[.)、])")
SENTENCE = re.compile(r"(?<=[。！？；!?;])\s*|(?<=[.])\s+")


class LineChunks:
    """Rows (doc, line, text) of one document in order -> chunks of at most `size` characters.

    A heading opens a new path and ends the chunk before it; so does the
    beginning of a clause.  A line too long for a chunk is cut at sentence
    ends, a sentence too long for one stays whole.
    """

    def __init__(self):
        self.path: list[tuple[int, str]] = []
        self.open: list[str] = []
        self.length = 0
        self.seq = 0
        self.doc = None
        self.size = 400

    def _close(self):
        text = "\n".join(self.open).strip()
        self.open, self.length = [], 0
        if text:
            self.seq += 1
            yield self.doc, self.seq - 1, " > ".join(h for _, h in self.path), text

    def eval(self, row, size: int = 400):
        self.doc, self.size = row["doc"], size
        text = row["text"]
        if text is None or not text.strip():
            return
        found = HEADING.match(text)
        if found:
            yield from self._close()
            level = len(found[1])
            self.path = [(n, h) for n, h in self.path if n < level] + [(level, found[2])]
            return
        if CLAUSE.match(text):
            yield from self._close()
        parts = [text] if len(text) <= size else [s for s in SENTENCE.split(text) if s and s.strip()]
        for part in parts:
            if self.open and self.length + 1 + len(part) > size:
                yield from self._close()
            self.open.append(part)
            self.length += len(part) + (len(self.open) > 1)

    def terminate(self):
        yield from self._close()


CHUNK = "doc long, seq int, path string, text string"


def register(spark: SparkSession, name: str = "line_chunks") -> None:
    """Makes the function known to SQL: select * from line_chunks(table(t) partition by doc order by line, 400)."""
    spark.udtf.register(name, udtf(LineChunks, returnType=CHUNK))


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = 400) -> DataFrame:
    """(doc, seq, path, text) of whole documents; a document's lines are read in order by one task, as its own partition.

    Null ids and texts, and documents of white space, have no chunks.  Of an
    id with several texts the lines come in order of line, then text.
    """
    spark = docs.sparkSession
    register(spark)
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line", "text")).where("trim(text) <> ''")
    return spark.sql(f"select * from line_chunks(table({{lines}}) partition by doc order by (line, text), {int(size)})", lines=lines)
