"""Queries opN_<name> over the driver tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import (
    decontaminate, fingerprints, jaccard, mixing, pitman_yor, planes, quality, repetition, sampling, spelling, substrings, toxicity, urls, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are; every worker has them installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query(f"""
with recursive w as (select doc_id, {WORDS.format(LOWER.format("text"))} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
          else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
e as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
      join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
      group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on e.x = r.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(y) from r where r.x = d.doc_id) as component_id
from documents d left join n using (doc_id)""")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query()
def op4_bit_plane_shuffling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.encode_table(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query(rf"""
with i as (select item_id, {WORDS.format(LOWER.format("text"))} as w,
             len({WORDS.format("regexp_extract(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^((?s).*)' || chr(10) || '[^' || chr(10) || ']*$', 1)")}) as nq
           from benchmark),
longest as (select max(len(w)) as l from i),
ig as (select item_id, nq, p, s, array_to_string(w[p + 1:p + s], ' ') as g
       from (select *, least(len(w), 5) as s, unnest(range(0, len(w) - least(len(w), 5) + 1)) as p from i where len(w) > 0)),
ip as (select item_id, g, s, bool_or(nq = 0 or p < nq) as q, bool_or(nq = 0 or p + s > nq) as a from ig group by 1, 2, 3),
n as (select item_id, count(*) as n_item, count(*) filter (where q) as n_q, count(*) filter (where a) as n_a from ip group by 1),
d as (select doc_id, {WORDS.format(LOWER.format("text"))} as w from documents),
sizes as (select distinct s from ip),
dg as (select doc_id, p, s, array_to_string(w[p + 1:p + s], ' ') as g
       from (select *, unnest(range(0, len(w) - s + 1)) as p from d join sizes on len(w) >= s)),
hit as (select doc_id, p, s, item_id, g, q, a from dg join ip using (g, s)),
win as (select doc_id, item_id, g, q, a, p // l as win from hit, longest
        union select doc_id, item_id, g, q, a, p // l - 1 from hit, longest where p // l > 0 and (p + s - 1) // l = p // l),
c as (select doc_id, item_id, win, count(*) as n_shared, count(*) filter (where q) as s_q, count(*) filter (where a) as s_a from win group by 1, 2, 3),
best as (select c.*, n_item, s_q / n_q as question_overlap, s_a / n_a as answer_overlap,
           row_number() over (partition by doc_id, item_id order by n_shared desc, s_q / n_q desc, s_a / n_a desc) as k
         from c join n using (item_id) where 100 * n_shared >= 80 * n_item and s_q > 0 and s_a > 0)
select doc_id, item_id, n_item, n_shared from best where k = 1""")
def op10_bm25_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_item", "n_shared")


def verdict(scores: DataFrame, folds: int, held_out: int, least: float) -> DataFrame:
    return scores.select("doc_id", (sampling.fold("doc_id", folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


@query()
def op3_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdict(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 4, 2, 0.3)


@query()
def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdict(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 3, 1, 0.5)


@query()
def op6_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query()
def op9_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


MIX = {"good": 0.88, "low": 0.03, "toxic": 0.09}


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table as domains: low quality, or else toxic, or else good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), "good").alias("domain"))


@query()
def op1_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), MIX)


@query()
def op7_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query(vector_codes.oracle())
def op13_value_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


@query(spelling.oracle())
def op11_trie_pair_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@query(fingerprints.oracle())
def op12_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))
