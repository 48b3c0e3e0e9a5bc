"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .decontaminate import find_leaks
from .filter_audit import filter_audit
from .kmeans_tree import neighbours
from .kneser_ney import kneser_ney
from .language_id import language_id
from .ngram_join import ngram_join
from .packing import best_fit_packing
from .quality import quality_rules
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .token_files import read_tokens, write_tokens
from .toxicity import toxicity

TOKENIZER = "byte_bpe_50k.json"


def _tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each text, the base rules, and the verdict of the trees."""
    return quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without words of repeated 35-word windows."""
    return substring_dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading language of each document's mixture, learned from four folds of five."""
    return language_id(_documents(spark, sf_dir))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of each text under add-one words and Kneser-Ney bigrams."""
    return kneser_ney(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each text, by two dictionaries trained on four folds of five."""
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, as read back from the files they were written to."""
    return read_tokens(write_tokens(_documents(spark, sf_dir), _tokenizer()))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, within a fifth of its words of edits."""
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in bins of 2048 words, one of a source and of a duplicate cluster in each."""
    return best_fit_packing(_documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: five-word n-grams, Jaccard of 0.75 or more."""
    return ngram_join(_documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes, equal texts together."""
    return shard_documents(_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language, by counts of 100 and more."""
    return collocations(_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth vector, by a tree of k-means."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def queries() -> dict:
    """name -> function of (spark, sf_dir)."""
    return {name: f for name, f in globals().items() if name[:2] == "op" and callable(f)}


_WORDS = r"""w as (select doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') w from documents)"""

ORACLES = {
    "op2_substring_dedup": f"""with {_WORDS.format(text="coalesce(text, '')")},
        win as (select doc_id, s, array_to_string(w[s:s + 34], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 33)) s from w where len(w) >= 35)),
        hit as (select distinct doc_id, s + o p from win, range(35) t(o) where k in (select k from win group by k having count(*) > 1)),
        kept as (select doc_id, string_agg(x, ' ' order by p) t from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from w) anti join hit using (doc_id, p) group by doc_id),
        n as (select doc_id, count(*) n from hit group by doc_id)
        select doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id) left join n using (doc_id)""",
    "op9_ngram_join": f"""with recursive {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
        g as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[s:s + 4], ' ') end g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) s from w where len(w) > 0)),
        n as (select doc_id, count(*) n from g group by doc_id),
        i as (select a.doc_id a, b.doc_id b, count(*) i from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        e as (select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 175 * i >= 75 * (x.n + y.n)),
        r as (select doc_id d, doc_id c from documents union select e.b, r.c from r join e on e.a = r.d)
        select doc_id, coalesce(n, 0) n_shingles, c component_id from documents left join n using (doc_id) join (select d, min(c) c from r group by d) on d = doc_id""",
    "op11_collocations": r"""with
        p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
        w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
        n as (select lang, sum(len(w)) n from w group by lang),
        g as (select lang, w[s:s + k - 1] g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) s from w, range(1, 6) t(k) where len(w) >= k)),
        f as (select lang, g, count(*) f from g group by all having count(*) >= 100),
        c as (select * from f where len(g) > 1),
        inside as (select lang, g[i:i + k - 1] g, max(f) f from (select lang, g, f, k, unnest(range(1, len(g) - k + 2)) i from c, range(2, 5) t(k) where len(g) > k) group by all),
        x as (select c.lang, c.g, c.f a, k from c left join inside i on i.lang = c.lang and i.g = c.g, range(1, 5) t(k) where k < len(c.g) and coalesce(i.f, 0) < c.f),
        s as (select x.lang, array_to_string(x.g, ' ') phrase, a, k, l.f l, r.f r, n::hugeint n, (1000::hugeint * a * n::hugeint) // (l.f::hugeint * r.f::hugeint) score from x join n on n.lang = x.lang join f l on l.lang = x.lang and l.g = x.g[:k] join f r on r.lang = x.lang and r.g = x.g[k + 1:]),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) "rank", phrase, a, l, r, n::bigint n, score::bigint score from b qualify "rank" <= 2000""",
    "op12_filter_audit": f"""with {_WORDS.format(text="coalesce(text, '')")},
        t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
        d as (select doc_id, part, len(w) n, len(list_distinct(w)) u, len(t) - len(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) c, len(t) l, regexp_matches(t, '[#$%&*|]') s, doc_id > min(doc_id) over (partition by t) e from t join w using (doc_id)),
        f as (select doc_id, part, (case when n < 100 then 'A' else '' end) || (case when 100 * u < 80 * n then 'B' else '' end) || (case when 100 * c > 10 * l then 'C' else '' end) || (case when s then 'D' else '' end) || (case when e then 'E' else '' end) f from d),
        m as (select part, f, count(*) n, count(*) filter (where quality = 1) good, count(*) filter (where toxic = 1) toxic from f left join labels using (doc_id) group by all),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
        o as (select a.x || b.x || c.x || d.x || e.x o from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        r as (select part, o, m.n, good, toxic, f, case when f = '' then 6 else list_min([strpos(o, x) for x in string_split(f, '')]) end k from m, o),
        s as (select part, o, s, substr(o, s, 1) x, sum(n) filter (where k > s) kept, sum(n) filter (where k = s) removed, sum(n) filter (where k < s and contains(f, substr(o, s, 1))) redundant, sum(n) filter (where f = substr(o, s, 1)) uniq, sum(good) filter (where k = s) good, sum(toxic) filter (where k = s) toxic from r, range(1, 6) t(s) group by all)
        select part, o filter_order, s::int step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(uniq, 0)::bigint unique_fails, coalesce(good, 0)::bigint good_lost, coalesce(toxic, 0)::bigint toxic_lost, coalesce(sum(removed) over (partition by part, x), 0)::bigint shapley from s""",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return dict(ORACLES)
