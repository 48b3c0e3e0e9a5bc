"""Collocations, the filter audit and nearest neighbours, each against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import automata, collocations, filter_audit, kmeans_tree

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(rows, least, first):
    """rows: (lang, text) -> what collocations returns."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * counts[p[i : i + k]]}
        found = []
        for p, a in cand.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)}
    return out


def test_collocations(corpus, spark, nothing):
    rng = random.Random(5)
    words = ["the", "of", "a", "new", "york", "ny", "é", "\x01", "x" * 300] + [f"w{i}" for i in range(30)]
    odd = [("en", " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\t", "\n"]) for _ in range(400))) for _ in range(20)]
    odd += [("en", "New  York\tCity is " * 40), (None, "in new york city; " * 9), ("", "a b " * 30), ("fr", None), ("fr", ""), ("fr", " ,.;\n"), ("en", odd[0][1]), ("en", odd[0][1]), ("und", "in new york " * 7)]
    both = spark.createDataFrame(odd, "lang string, text string").unionByName(corpus.select("lang", "text")).withColumn("phrase", F.lit("x")).repartition(4)
    rows = [(r.lang, r.text) for r in both.collect()]
    for least, first in ((5, 2000), (12, 7)):
        got = collocations.collocations(both, least=least, first=first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        want = phrases_by_hand(rows, least, first)
        assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 20
    assert collocations.collocations(nothing, least=1).count() == 0


def test_collocations_with_sieves_that_let_all_through(corpus, monkeypatch):
    """What a sieve lets through by chance is counted exactly and goes."""
    monkeypatch.setattr(collocations, "SPARSE", 0)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 500)
    rows = [(r.lang, r.text) for r in corpus.select("lang", "text").collect()]
    got = collocations.collocations(corpus, least=9).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert {tuple(r) for r in got} == phrases_by_hand(rows, 9, 2000)


def test_large_counts_are_exact(spark):
    """a n passes 64 bits."""
    a, n, left, right = 3 * 10**16 + 7, 8 * 10**14 + 1, 4 * 10**16 + 9, 5 * 10**16 + 3
    expr = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(15, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    assert spark.sql(f"select {expr} s from values ({a}L, {n}L, {left}L, {right}L) t(a, n, l, r)").first().s == 1000 * a * n // (left * right)


def test_automata():
    rng = random.Random(1)
    shards = [Counter(tuple(rng.choice([b"a", b"b", b"cc", b"\xc3\xa9"]) for _ in range(rng.randint(1, 5))) for _ in range(200)) for _ in range(4)]
    made = [automata.Automaton.build(sorted(s.items())) for s in shards]
    assert [dict(a) for a in made] == [dict(s) for s in shards]
    assert all(list(automata.Automaton.unpack(a.pack())) == sorted(s.items()) for a, s in zip(made, shards))
    total = sum(shards, Counter())
    assert dict(automata.union(made, 3)) == {p: n for p, n in total.items() if n >= 3}
    both = {p: (n, shards[1][p]) for p, n in shards[0].items() if p in shards[1]}
    assert {p: (x, y) for p, x, y in made[0].compose(made[1])} == both
    # equal endings of equal weights are one state
    same = automata.Automaton.build([((w, b"x", b"y"), 7) for w in (b"a", b"b", b"c")])
    assert len(same.arcs) == 4 and list(automata.union([])) == []


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, *x in labels if x[j] == 1 and i is not None} for j in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out, fails = {}, []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails.append((lang or "", f + "E" * (i is not None and i > least[t]), i))
    for part in {p for p, _, _ in fails}:
        mine = [(f, i) for p, f, i in fails if p == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(f, i) for f, i in left if x in f]
                left = [(f, i) for f, i in left if x not in f]
                removed_by[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in f for f, _ in mine) - len(gone), sum(f == x for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), x]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = removed_by[v[-1]]
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit(corpus, spark, nothing):
    labels = [(i, i % 3 and 1, i % 5 == 0 and 1 or 0) for i in range(50)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (7, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x"))
    rows = [(r.doc_id, r.text, r.lang) for r in corpus.select("doc_id", "text", "lang").collect()]
    got = filter_audit.filter_audit(corpus, table).select("part", "filter_order", "step", *filter_audit.COUNTS).collect()
    assert {tuple(r) for r in got} == audit_by_hand(rows, labels) and len(got) == 3 * 600
    assert filter_audit.filter_audit(nothing, table).count() == 0
    assert filter_audit.filter_audit(corpus, table.limit(0)).count() == 1800


def test_removal_steps():
    masks = np.array([[m >> i & 1 for i in range(4)] for m in range(16)], bool)
    orders, at = filter_audit.positions(4)
    got = filter_audit.removal_steps(masks, at)
    for m, row in zip(masks, got):
        assert row.tolist() == [next((s for s, f in enumerate(o, 1) if m[f]), filter_audit.NEVER) for o in orders]


def near_by_hand(rows, queries, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in ok & {(i, tuple(v)) for i, v in queries if v}:
        near = sorted((float(np.sqrt(np.square(np.array(x, float) - np.array(v, float)).sum())), i) for i, x in ok if i != q)
        out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(600)]  # one vector many times, query ids among them
    rows += [rows[0]] * 3 + [(100, rows[7][1]), (None, rows[1][1]), (3000, None), (3100, []), (3200, [0.0] * 8), (3300, [-0.0] * 8), (3400, [float("nan")] + [1.0] * 7), (3500, [float("inf")] + [1.0] * 7), (3600, [None] + [1.0] * 7), (3700, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("h", "leaf", "rank", "score", "chunk", "part", "rep", "q"):
        df = df.withColumn(c, F.lit("x"))
    return rows, df.repartition(6)


def test_every_leaf_is_brute_force(vectors, spark):
    rows, df = vectors
    asked = df.where("vec_id % 100 = 0")
    want = near_by_hand(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)
    for bounds in ({}, {"rows": 16, "asked": 2}):
        got = sorted(tuple(r) for r in kmeans_tree.neighbours(df, asked, target=2.0, leaf=16, depth=3, **bounds).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_recall_and_few_vectors(vectors, spark):
    rows, df = vectors
    got = kmeans_tree.neighbours(df, df.where("vec_id % 100 = 0"), leaf=16, depth=3, sample=400, calibrators=64, target=0.95).collect()
    want = near_by_hand(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)
    by = lambda x: {(r[0], r[2]) for r in x}
    assert len(by(got) & by(want)) >= 0.9 * len(by(want))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0])], "vec_id int, embedding array<double>")
    assert sorted(map(tuple, kmeans_tree.neighbours(few, few.where("vec_id = 0")).collect())) == [(0, 1, 1, 0.0), (0, 2, 2, 5.0)]
    assert kmeans_tree.neighbours(few.where("vec_id = 0"), few).count() == 2
    assert kmeans_tree.neighbours(few.limit(0), few).count() == 0
    assert kmeans_tree.neighbours(few, few.limit(0)).count() == 0
