import re
import zlib
from collections import Counter, defaultdict
from math import log10
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tidemill.llm import kneser_ney as kn
from tidemill.llm import language_id as li
from tidemill.llm import quality, toxicity

LOW = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
SF = "/root/testdata/sf0.01"


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def base(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(hit)


def test_quality_statistics(corpus, pairs, spark, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(corpus, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *base(t)) for i, t in pairs)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept)
    tricky = ["# a\n# a\n\n \n# a", "<b> é|é $", "a\x0bb\x0cc\x1fd", None]
    s = quality.statistics(pa.array(tricky))
    assert [tuple(int(s[c][i]) for c in quality.COUNTS) for i in range(4)] == [base(t) for t in tricky]
    assert quality.quality_rules(nothing, labels.limit(0)).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.4) & (x[:, 2] + 0.2 * rng.random(3000) < 0.7)).astype(float)
    t = quality.grow(x, y)
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    for j in quality.FALLING:
        line = np.repeat(rng.random((40, x.shape[1])), 50, axis=0)
        line[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        s = t.score(line).reshape(40, 50)
        assert (np.diff(s, axis=1) <= 1e-12).all()
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_language_shares():
    rng = np.random.default_rng(1)
    a, b = (["".join(rng.choice(list(s), 6)) for _ in range(200)] for s in ("abcdefg", "mnopqrs"))
    text = lambda words, n: " ".join(rng.choice(words, n))
    counts = [r for r in li._count([pa.record_batch([pa.array(["x"] * 20 + ["y"] * 20), pa.array([text(a, 50) for _ in range(20)] + [text(b, 50) for _ in range(20)])], names=["lang", "text"])])][0].to_pylist()
    c = np.stack([np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in counts]) + 0.05
    table = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
    s = li.infer(pa.array([text(a, 60), text(a, 30) + " " + text(b, 30), text(a, 15) + " " + text(b, 45), "123", None, ""]), table)
    assert s[0].tolist() == [1, 0] and abs(s[1][0] - 0.5) < 0.05 and abs(s[2][1] - 0.75) < 0.05
    assert not s[3:].any()


def plain_mixture(text, table, rounds=6, penalty=4.0):
    """Shares of languages of one text in plain Python, or None without letters."""
    from math import exp, log

    data = [x if 97 <= x <= 122 or x >= 128 else x + 32 if 65 <= x <= 90 else 32 for x in text.encode()]
    words = []
    for i, b in enumerate(data):
        if b == 32:
            continue
        left, right = data[i - 1] if i else 32, data[i + 1] if i + 1 < len(data) else 32
        if left == 32:
            words.append([])
        words[-1].append(((left << 16 | b << 8 | right) * 2654435761 % 2**32) >> 16)
    if not words:
        return None
    langs = len(table)
    ll = [[sum(float(table[j][c]) for c in w) for j in range(langs)] for w in words]
    ll = [[max(x - max(row), -12) for x in row] for row in ll]

    def mixture(allowed, rounds):
        share = [1 / len(allowed) if j in allowed else 0 for j in range(langs)]
        for _ in range(rounds):
            new = [0.0] * langs
            for row in ll:
                part = [exp(x) * s for x, s in zip(row, share)]
                for j in range(langs):
                    new[j] += part[j] / sum(part) / len(ll)
            share = new
        return share, sum(log(sum(exp(x) * s for x, s in zip(row, share))) for row in ll)

    full, _ = mixture(set(range(langs)), rounds)
    order = sorted(range(langs), key=lambda j: -full[j])
    best = None
    for m in range(1, langs + 1):
        share, like = mixture(set(order[:m]), rounds if m > 1 else 1)
        paid = like - (m - 1) * penalty * 0.5 * log(len(words) + 1)
        if best is None or paid > best[0]:
            best = (paid, share)
    return best[1]


def test_mixtures_against_plain_python():
    rng = np.random.default_rng(9)
    table = np.log(rng.dirichlet(np.full(li.CELLS, 0.3), 5) + 1e-7).astype(np.float32)
    alphabets = ("abcde", "cdefgh", "ijkl", "éèab", "xyz")
    texts = [" ".join("".join(rng.choice(list(s), rng.integers(1, 8))) for _ in range(rng.integers(1, 40)) for s in rng.choice(alphabets, rng.integers(1, 5))) for _ in range(25)] + ["a", "12 3", "", "A b\tC!d"]
    got = li.infer(pa.array(texts), table)
    for text, share in zip(texts, got):
        want = plain_mixture(text, table)
        assert np.allclose(share, 0 if want is None else want, atol=1e-4) and (want is None or (share > 0).tolist() == [x > 0 for x in want])


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc def", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        li.language_id(docs)


def test_balanced_mixtures_of_many_languages(spark):
    rng = np.random.default_rng(2)
    alphabets = ("abcde", "fghij", "klmno", "pqrst", "uvwxy")
    words = [["".join(rng.choice(list(s), 6)) for _ in range(100)] for s in alphabets]
    text = lambda n, *of: " ".join(rng.permutation(np.concatenate([rng.choice(words[i], n) for i in of])))
    rows = [(j * 5 + i, text(40, i), f"l{i}") for j in range(40) for i in range(5)]
    odd = {1001: text(40, 0, 1, 2), 1002: text(40, 0, 1, 2, 3), 1003: text(40, 0, 1, 2, 3, 4), 1004: "中文文本 没有学过", 1005: "12 34"}
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in odd.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in li.language_id(docs).where("doc_id > 1000").collect()}
    for i, m in ((1001, 3), (1002, 4), (1003, 5)):
        assert sorted(got[i].languages) == [f"l{j}" for j in range(m)] and abs(got[i].score - 1 / m) < 0.02
    assert {r.doc_id for r in li.keep_known_languages(docs).where("doc_id > 1000").collect()} == {1001, 1002, 1003}
    assert li.keep_known_languages(docs).count() == len(rows) + 3


def test_language_on_tables(spark, corpus, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    got = li.language_id(corpus).collect()
    assert len(got) == corpus.count()
    assert all((r.lang_pred == "und") == (r.languages == []) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    kept = li.keep_known_languages(corpus)
    assert kept.columns == corpus.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert li.language_id(nothing).count() == 0
    assert {r.lang_pred for r in li.language_id(corpus.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("order", [3, 2])
def test_kneser_ney_against_dictionaries(corpus, pairs, nothing, order):
    rows = [(i, (t or "").encode().translate(LOW).split() + [None]) for i, t in pairs]
    train = [w for i, w in rows if fold(i, 7) != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    threes = Counter(g for w in train for g in zip([0, 0, *w[:-2]] if len(w) > 1 else [0], [0, *w[:-1]], w))
    twos = Counter(g[1:] for g in threes) if order == 3 else Counter(g[1:] for g, x in threes.items() for _ in range(x))
    ones = Counter(g[1] for g in twos)
    d3, d2, d1 = (kn.discounts([sum(x == i for x in t.values()) for i in range(1, 5)]) for t in (threes, twos, ones))

    def sums(grams):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for g, x in grams.items():
            out[g[:-1]][0] += x
            out[g[:-1]][min(x, 3)] += 1
        return out

    s3, s2 = sums(threes), sums(twos)
    rest = sum(d1[min(x, 3)] for x in ones.values()) / sum(ones.values())

    def mixed(x, stats, d, lower):
        return max(x - d[min(x, 3)], 0) / stats[0] + sum(d[i] * stats[i] for i in (1, 2, 3)) / stats[0] * lower if stats else lower

    def p(u, h, w):
        x = (max(ones[w] - d1[min(ones[w], 3)], 0) if w in ones else 0) / sum(ones.values()) + rest / (v + 1)
        x = mixed(twos.get((h, w), 0), s2.get((h,)), d2, x)
        return mixed(threes.get((u, h, w), 0), s3.get((u, h)), d3, x) if order == 3 else x

    context = next(g[:2] for g, x in threes.most_common() if g[1] == b"the")
    assert abs(sum(p(*context, w) for w in c) + p(*context, b"never seen") - 1) < 1e-9
    grams = lambda w: zip([0, 0, *w[:-2]] if len(w) > 1 else [0], [0, *w[:-1]], w)
    want = Counter((i, len(w), sum(t in c for t in w), n, round(sum(log10((c[t] + 1) / (n + v + 1)) for t in w), 6), round(sum(log10(p(*g)) for g in grams(w)), 6)) for i, w in rows)
    got = kn.kneser_ney(corpus, order).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert all(r.held_out == (fold(r.doc_id, 7) == 2) for r in got)
    assert kn.kneser_ney(nothing, order).count() == 0


def test_kneser_ney_counts_are_wide(tmp_path, monkeypatch):
    keys, counts, last = np.arange(5, dtype=np.uint64) * np.uint64(1 << 60), np.array([1, 1 << 33, 2**40 + 7, 3, 1]), np.arange(5, dtype=np.uint32)
    assert [x.tolist() for x in kn._unpack(kn._pack(keys, counts, last))] == [keys.tolist(), counts.tolist(), last.tolist()]
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 40, 3000, dtype=np.uint64) & ~np.uint64(0x3FF) | np.uint64(3))
    h = np.sort(np.r_[h, h + np.uint64(1)])  # every upper part stands twice
    values = np.c_[np.arange(len(h)) % 300, (np.arange(len(h)) << 20)]
    arrays, sizes = kn._table(h, values)
    name = kn._store(f"file://{tmp_path}", "t", 0, arrays)
    for fs in (pafs.LocalFileSystem(), pafs.SubTreeFileSystem("/", pafs.LocalFileSystem())):  # mounted, and not
        monkeypatch.setattr(kn, "pafs", SimpleNamespace(LocalFileSystem=pafs.LocalFileSystem, FileSystem=SimpleNamespace(from_uri=lambda uri, fs=fs: (fs, uri.removeprefix("file://")))))
        table = kn.Table(kn._load(name, kn._kinds(sizes)), sizes)
        assert (table.find(h) == values).all() and not table.find(h + np.uint64(2)).any()


def test_toxicity(spark, corpus, nothing):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(words) for _ in range(80)]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(["zworthless", "qidiotic", "vmoronic"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    r = toxicity.toxicity(docs, lab).join(lab.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.toxic for x in r) / len(r) > 0.97
    got = toxicity.toxicity(corpus, lab).collect()
    assert len(got) == corpus.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert len({x.score for x in toxicity.toxicity(corpus, lab.limit(0)).collect()}) == 1 and toxicity.toxicity(nothing, lab).count() == 0


@pytest.mark.parametrize("c", [[0, 0, 0, 0], [5, 0, 0, 0], [10, 4, 2, 1], [10, 4, 0, 0]])
def test_discounts_stay_below_counts(c):
    d = kn.discounts(c)
    assert d[0] == 0 and all(0 < d[i] <= i for i in (1, 2, 3))


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(3)
    texts = [" ".join("x" * rng.integers(1, 9) for _ in range(n)) for n in (0, 1, 7, 8, 9, 12, 13, 40)] + [None, "  \n", "y" * 5000 + " z " + "w" * 2048, "a\tb\nc " * 9]
    w = toxicity.Words(pa.array(texts), lower=True)
    row, begin, end = toxicity.windows(w)
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        mine = [(int(a) - int(w.offs[i]), int(z) - int(w.offs[i])) for r, a, z in zip(row, begin, end) if r == i]
        if not any(len(x) >= toxicity.PIECE for x in words):
            starts = range(0, max(1, len(words) - toxicity.SPAN + toxicity.STEP), toxicity.STEP) if words else []
            assert [(t or "").encode()[a:z].split() for a, z in mine] == [words[s : s + toxicity.SPAN] for s in starts]
        covered = np.zeros(len((t or "").encode()) + 1, bool)
        for a, z in mine:
            assert z - a <= toxicity.PIECE
            covered[a:z] = True
        assert all(covered[j] for j, c in enumerate((t or "").encode()) if not chr(c).isspace())


def auc(scores, labels):
    pairs = [(a, b) for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


def test_toxic_phrases_of_ordinary_words(spark):
    """Toxic is a phrase, not a word: ordinary texts hold the same words apart, and many copies teach nothing."""
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    phrase, rows, labels = rng.sample(words, 4), [], []
    for i in range(1500):
        t, toxic = [rng.choice(words) for _ in range(80)], int(i % 2 == 0)
        for at in (rng.randrange(0, 36), rng.randrange(40, 76)):
            if toxic:
                t[at : at + 4] = phrase
            else:
                for w in phrase:
                    t[rng.randrange(80)] = w
        rows.append((i, " ".join(t)))
        labels.append((i, 1, toxic))
    copy = " ".join(rng.choice(words) for _ in range(80))
    rows += [(2000 + i, copy) for i in range(200)]
    labels += [(2000 + i, 1, 1) for i in range(200)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).where("held_out and doc_id < 2000").collect()
    assert auc([r.score for r in got], [r.doc_id % 2 == 0 for r in got]) > 0.9
