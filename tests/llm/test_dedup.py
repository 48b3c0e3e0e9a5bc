import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemill.llm.ngram_join import keep_one_of_each, ngram_join
from tidemill.llm.substring_dedup import Automaton, substring_dedup, without_repeats

LOW = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOW).split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_against_brute_force(corpus, pairs):
    got = ngram_join(corpus).collect()
    assert len(got) == len(pairs)
    want = brute_join([p for p in pairs if p[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_join_in_many_parts(corpus, pairs):
    """Blocks cut into parts lose no link."""
    want = brute_join([p for p in pairs if p[0] is not None])
    got = ngram_join(corpus.where("doc_id is not null"), block_grams=150).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_of_ids_with_two_texts(spark):
    """Each text of an id has links of its own."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([25, 40, 90, 300]))]
        near = [*w[:7], "other", *w[8:]]
        apart = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([20, 400]))]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(near)), (1000 + i, " ".join(apart))]
    found = brute_join([(x, t) for x, (_, t) in enumerate(rows)])
    least = {}
    for x, (_, c) in found.items():
        least[c] = min(rows[x][0], least.get(c, 10**9))
    want = Counter((rows[x][0], n, least[c]) for x, (n, c) in found.items())
    assert sum(i != c for i, _, c in want) > 30
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_keep_one_of_each(corpus, pairs):
    want = {i for i, (_, c) in brute_join([p for p in pairs if p[0] is not None]).items() if i == c}
    kept = keep_one_of_each(corpus)
    assert kept.columns == corpus.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([*want, None])


def test_join_of_nothing(nothing):
    assert ngram_join(nothing).count() == 0 and keep_one_of_each(nothing).count() == 0


def brute_dedup(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in docs for j in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def test_dedup_against_brute_force(corpus, pairs):
    for window, shard in ((35, 256), (35, 1), (6, 3)):
        got = substring_dedup(corpus, window, shard).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_dedup(pairs, window), (window, shard)
        for r in got:
            assert hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest() == r.kept_sha256


def test_without_repeats(corpus, nothing):
    got = {(r.doc_id, r.left): r for r in substring_dedup(corpus).select("doc_id", F.col("kept_text").alias("left"), "n_words", "n_removed").collect()}
    out = without_repeats(corpus)
    assert out.columns == corpus.columns
    rows = out.collect()
    assert {(r.doc_id, r.text) for r in rows} == {k for k, r in got.items() if not r.n_words or r.n_removed < r.n_words}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert without_repeats(nothing).count() == 0 and substring_dedup(nothing).count() == 0


def test_automaton_counts_places():
    a = Automaton()
    texts = ["a b c d".split(), "b c d e".split(), "x b c y b c".split()]
    for t in texts:
        a.add(t, 1)
    a.count()
    want = defaultdict(int)
    for t in texts:
        for j in range(len(t) - 1):
            want[tuple(t[j : j + 2])] += 1
    for t in texts:
        assert a.repeated(t, 2) == [want[tuple(t[j : j + 2])] > 1 for j in range(len(t) - 1)]
