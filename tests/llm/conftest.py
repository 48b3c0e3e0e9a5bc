import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def invented(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, periodic, long, empty, blank and null texts, repeated rows, odd columns."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["the", "of", "and"] * 30
    texts = [invented(rng, rng.randint(3, 300), words) for _ in range(60)]
    passage = invented(rng, 50, words)
    for i in range(0, 60, 4):
        w = texts[i].split()
        w[len(w) // 2 : len(w) // 2] = passage.split()
        texts[i] = " ".join(w)
    near = []
    for i in range(0, 40, 3):
        w = texts[i].split()
        for _ in range(len(w) // 60 + (len(w) > 20)):
            w[rng.randrange(len(w))] = rng.choice(words)
        near.append(" ".join(w))
    texts += near + texts[:8] + [texts[3].upper(), "A b\tC\n\nd  e f", "a b c d e f", "x " * 150, "la li lu " * 60, invented(rng, 9000, words), "", "  \n", None, "one two", "one  two"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id but " + texts[1], "en", "s0", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC)
    for clash in ("row", "shard", "bucket", "key", "n", "fp", "doc", "lead", "held_out", "label"):
        df = df.selectExpr("*", f"'x' as {clash}")
    return df.repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def pairs(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
