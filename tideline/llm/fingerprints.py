"""Document fingerprints: bottom-k sketches of word shingles, in built-in functions only.

A sketch is the ascending array of the ``k`` smallest distinct hashes of a text's five-word shingles (a shorter text with words is one
shingle). A hash is the first 16 hex digits of the shingle's md5. Sketches of parts merge into the sketch of the whole. They estimate

* resemblance: the share of the union's ``k`` smallest hashes that both sides hold; exact while the union has at most ``k``;
* containment: of those, the share among the ones that the first side holds;
* the number of distinct shingles: (k - 1) / (k-th hash as a fraction), or the exact size below ``k``.

Defined cases: a null text is an empty one; a text without words has the empty sketch, and two empty sketches are alike (1). The text
after a document is the one with the next doc_id, ids ascending, nulls first, equal ids by two 64-bit hashes of the text; after the last comes the
first. A repeated row (same id and text) counts once there, and each copy gets the same result. Columns besides doc_id and text are ignored.
A text is handled whole, in memory of some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators import prefix
from tideline.session import durable

K = 128
WORDS = 5
DIGITS = 16
SEPARATORS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, k: int = WORDS) -> Column:
    """The k-word windows of a text, joined by a space; fewer words are one window."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) == 0, none).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(
        # Single elements are read in place; a slice would copy the whole array for every window.
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom(F.array_distinct(F.transform(shingles(text), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS))), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.array_union(a, b), k)


def _shares(a: Column, b: Column, k: int) -> Column:
    """(resemblance, containment) of two sketches: shares among the union's smallest hashes, found with one union and one intersection."""
    def upto(hashes: Column, last: Column) -> Column:
        return F.size(F.filter(hashes, lambda h: h <= last)).cast("double")

    return let(merge(a, b, k), lambda u: let(F.element_at(u, -1), lambda last: let(upto(F.array_intersect(a, b), last), lambda both: F.struct(
        (both / F.size(u)).alias("resemblance"), (both / F.when(upto(a, last) > 0, upto(a, last))).alias("containment")))))


def _likeness(a: Column, b: Column, k: int) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _shares(a, b, k)).otherwise(F.struct(
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0).alias("resemblance"), F.when(F.size(a) == 0, 1.0).otherwise(0.0).alias("containment")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    return _likeness(a, b, k)["resemblance"]


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b holds; 1 if a has none, and null if none of a's hashes is among the union's smallest."""
    return _likeness(a, b, k)["containment"]


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The number of distinct shingles, exact below k."""
    last = F.conv(F.substring(F.element_at(a, -1), 1, 12), 16, 10).cast("double") / F.lit(2.0 ** 48)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / last)


def merged_by(parts: DataFrame, keys: Sequence[str], column: str, k: int = K) -> DataFrame:
    """(keys, column): the sketch of each group of parts.

    Hashes are deduplicated in each task, and tasks send at most their k smallest of a group, so a hot group reaches its task
    as k hashes from each of the others. A group of empty sketches has the empty sketch.
    """
    alone = parts.select(*keys, F.explode_outer(column).alias("_h")).distinct()
    least = alone.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last("_h")))).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, following): each text, its edit, and the sketch of the next document.

    The edit replaces the last quarter of the code points (rounded down) by the first as many, or all, of the next text.
    The order of documents is found on ids and hashes only. Texts are shuffled once by that key; a predecessor
    is then sent as much of the text as it needs, and the sketch.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        F.struct("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).alias("_key"), "text")
    rows = texts.groupBy("_key").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    ring = durable(prefix.with_next(rows, [F.col("_key")], ["_key"]).select("_key", "copies", F.col("next._key").alias("after"), F.expr("n div 4").alias("wanted")))
    if ring.where("copies > 1").limit(1).count():
        texts = texts.dropDuplicates(["_key"])
    wants = ring.select(F.col("after").alias("_key"), F.col("_key").alias("before"), "wanted")
    heads = texts.join(wants, "_key").select(
        F.col("before").alias("_key"), F.expr("substring(text, 1, wanted)").alias("head"), F.unhex(F.array_join(sketch(F.col("text")), "")).alias("following"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.col("head"))
    copies = ring.where("copies > 1").select("_key", "copies")
    pairs = texts.join(heads, "_key").select("_key", "text", edited.alias("edited"), "following")
    return pairs.join(copies, "_key", "left").select(
        "_key.doc_id", "text", "edited", spelled(F.col("following")).alias("following"),
        F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))).alias("_copy")).drop("_copy")


def spelled(packed: Column) -> Column:
    """The hashes of a sketch from their bytes, one after the other."""
    size = DIGITS // 2
    return F.when(F.length(packed) == 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(packed), F.lit(1)), F.lit(size)), lambda i: F.lower(F.hex(F.substring(packed, i, F.lit(size))))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: length, edit, both fingerprints, likeness to the edit and to the next document, and estimates.

    ``n_shingles`` estimates the distinct shingles, ``kept_share`` how many of them the edit still holds.
    """
    rows = with_edits(docs).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                                   "following", sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"))
    own, other = F.col("own"), F.col("other")
    rows = rows.withColumn("likeness", _likeness(own, other, K))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join(own, "").alias("fingerprint"), F.array_join(other, "").alias("edited_fingerprint"),
        F.col("likeness.resemblance").alias("near_edited"), resemblance(own, F.col("following")).alias("near_next"),
        distinct_shingles(own).alias("n_shingles"), F.col("likeness.containment").alias("kept_share"))


def oracle() -> str:
    """DuckDB SQL for ``fingerprints`` over ``documents`` with distinct doc_ids."""
    def alike(a: str, b: str, base: str, size: str) -> str:
        return f"case when len({size}) = 0 then 1.0 else len(list_intersect(list_intersect(u_{b}, {a}), {b}))::double / len({base}) end"

    held = "list_intersect(u_other, own)"
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
e as (select *, coalesce(lead(text) over o, first_value(text) over (o rows between unbounded preceding and unbounded following)) as after
  from d window o as (order by doc_id nulls first)),
f as (select doc_id, n, text, after, left(text, n - n // 4) || left(after, n // 4) as edited from e),
t as (select distinct unnest([text, edited]) as text from f),
w as (select text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t),
s as (select text, list_sort(list_distinct(list_transform(case when len(w) = 0 then []::varchar[] when len(w) < {WORDS} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end, lambda x: left(md5(x), {DIGITS}))))[1:{K}] as s from w),
j as (select doc_id, n, edited, a.s as own, b.s as other, c.s as following,
  list_sort(list_distinct(list_concat(a.s, b.s)))[1:{K}] as u_other, list_sort(list_distinct(list_concat(a.s, c.s)))[1:{K}] as u_following
  from f join s a on a.text = f.text join s b on b.text = f.edited join s c on c.text = f.after)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, array_to_string(own, '') as fingerprint, array_to_string(other, '') as edited_fingerprint,
  {alike('own', 'other', 'u_other', 'u_other')} as near_edited, {alike('own', 'following', 'u_following', 'u_following')} as near_next,
  case when len(own) < {K} then len(own)::double else {K - 1}.0::double / (('0x' || left(own[-1], 12))::ubigint::double / 2.0::double ** 48) end as n_shingles,
  case when len(own) = 0 then 1.0::double when len({held}) > 0 then len(list_intersect({held}, other))::double / len({held}) end as kept_share from j"""
