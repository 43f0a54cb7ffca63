"""Spelling variants: words that differ by one code point, found by pairs of trie nodes.

Every prefix of a word is a node of a trie, every suffix a node of the trie of reversed words, and both are numbered. A word of length L gives
the pairs (node of its first i code points, node of what follows position i + 1) that skip one position, and the pairs (node of the
first i, node of the rest) that skip none. Two words with an equal skipping pair differ in that position only; a skipping pair
equal to a pair without a skip says that one word is the other with a code point inserted there. A code point of a run of
equal ones can be taken out anywhere in the run with the same result, so only the run's first is used for that. Every near pair is then found once.
A skipping pair is shared by at most as many words as the alphabet has letters, so no group of the joins grows with the data.
All joins are by sorting: their tables grow with the vocabulary, and Spark would broadcast them by the size of short compressed files,
or of the words before they are exploded, a fraction of what the driver then holds.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the hash; repeated rows count each. Words may be long: a node deeper
than ``DEEP`` is named by its depth and md5, so a word of L code points takes space in proportion to L. Equal counts go to
the word smallest in code-point order. An empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import durable

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_FACTOR = 5
SLIP = 199
DEEP = 32


def words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word): one row for each run of Latin letters of each text, A-Z lower-cased, of at least that many code points.

    Where the crc32 of ``<doc_id>:<word>`` divides by ``SLIP``, the code point at crc32 modulo length is taken out, as a planted slip.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_length},}})"))).alias("run")
    found = docs.select("doc_id", run).select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    crc = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = found.select("run", crc.alias("h"), (crc % F.length("run")).cast("int").alias("at"))
    slipped = F.when(F.col("h") % SLIP == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return hashed.select(slipped.alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words found at least ``least_count`` times."""
    return words(docs, least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _numbered(labels: DataFrame, name: str) -> DataFrame:
    """(label, name): distinct labels with an integer each; written, so every reader sees the same numbers."""
    return durable(labels.distinct().withColumn(name, F.monotonically_increasing_id()))


def _node(part: str, length: str) -> Column:
    text = F.expr(part)
    return F.when(F.expr(f"{length} <= {DEEP}"), text).otherwise(F.concat(F.lit("#"), F.expr(length), F.lit("#"), F.md5(text.cast("binary"))))


def node_pairs(vocabulary: DataFrame) -> DataFrame:
    """(id, skips, first, head, tail): the integer pairs of every word, written.

    ``skips`` tells whether the pair leaves out the position after its prefix, ``first`` whether that position opens a run of equal letters.
    The empty prefix and short ones belong to many words; they meet a written dictionary in the joins, so their rows can be split.
    """
    cut = vocabulary.select("id", "word", F.length("word").alias("l"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    cut = cut.select("id", "word", "l", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).where("i + s <= l")
    labelled = cut.select(
        "id", (F.col("s") == 1).alias("skips"),
        ((F.col("s") == 1) & ((F.col("i") == 0) | (F.expr("substring(word, i, 1)") != F.expr("substring(word, i + 1, 1)")))).alias("first"),
        _node("substring(word, 1, i)", "i").alias("prefix"), _node("substring(word, i + s + 1)", "(l - i - s)").alias("suffix"))
    heads = _numbered(labelled.select("prefix"), "head")
    tails = _numbered(labelled.select("suffix"), "tail")
    return durable(labelled.join(heads.hint("merge"), "prefix").join(tails.hint("merge"), "suffix").select("id", "skips", "first", "head", "tail"))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b): ids of words that differ by exactly one inserted, deleted or replaced code point, each pair in both directions once."""
    pairs = node_pairs(vocabulary)
    skips = pairs.where("skips").select("id", "head", "tail", "first")
    other = skips.select(F.col("id").alias("b"), "head", "tail")
    replaced = skips.select(F.col("id").alias("a"), "head", "tail").join(other.hint("merge"), ["head", "tail"]).where("a <> b").select("a", "b")
    shorter = pairs.where("not skips").select(F.col("id").alias("b"), "head", "tail")
    longer = skips.where("first").select(F.col("id").alias("a"), "head", "tail").join(shorter.hint("merge"), ["head", "tail"]).select("a", "b")
    return replaced.unionAll(longer).unionAll(longer.select(F.col("b").alias("a"), F.col("a").alias("b")))


def followed(links: DataFrame, start: str, to: str) -> DataFrame:
    """(start, to): the last node that each start reaches along links without cycles; every pass doubles the steps taken."""
    now = durable(links.select(F.col(start).alias("start"), F.col(to).alias("to")))
    while True:
        on = now.select(F.col("start").alias("to"), F.col("to").alias("further"))
        now = durable(now.join(on.hint("merge"), "to", "left").select("start", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select(F.col("start").alias(start), F.col("to").alias(to))


def variant_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    ``form`` is the near word of largest count, if that is at least ``factor`` times the word's; counts rise along forms, so they end.
    """
    known = durable(vocabulary(docs, least_length, least_count).withColumn("id", F.monotonically_increasing_id()))
    of_b = known.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other"))
    best = durable(near_pairs(known).join(of_b.hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("other").alias("best")))
    form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best"))
    rows = durable(known.join(best.hint("merge"), "id", "left").withColumn("best", form).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = followed(rows.where("form is not null"), "word", "form").withColumnRenamed("form", "root")
    return rows.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    """DuckDB SQL for ``variant_groups`` over ``documents``; crc32 is folded over bytes with its table built from the polynomial."""
    low = f"translate(r, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
with recursive crc as (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, x)) as tab),
runs as (select doc_id, {low} as r, count(*) as c from (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{LEAST_LENGTH},}}')) as r from documents) group by all),
hashed as (select r, c, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || r, ''),
    lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195::bigint, unicode(ch) - 64] end)),
  lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) as h from runs, crc),
slipped as (select case when h % {SLIP} = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, c from hashed),
voc as (select word, sum(c)::bigint as n from slipped where length(word) >= {LEAST_LENGTH} group by 1 having sum(c) >= {LEAST_COUNT}),
cut as (select word, left(word, i) || '*' || substr(word, i + 2) as skip, left(word, i) || substr(word, i + 2) as less
  from (select word, unnest(range(length(word))) as i from voc)),
gone as (select distinct c.word as a, v.word as b from cut c join voc v on v.word = c.less),
near as (select a.word as a, b.word as b from cut a join cut b on a.skip = b.skip and a.word <> b.word union select a, b from gone union select b, a from gone),
best as (select a as word, count(*) as n_near, max(v.n) as top, arg_min(v.word, (-v.n, v.word)) as form from near join voc v on v.word = near.b group by 1),
forms as (select voc.word, n, coalesce(n_near, 0) as n_near, case when top >= {FORM_FACTOR} * n then form end as form, case when top >= {FORM_FACTOR} * n then top end as form_n
  from voc left join best using (word)),
walk as (select word, form as root, 1 as step from forms where form is not null
  union all select walk.word, forms.form, step + 1 from walk join forms on forms.word = walk.root where forms.form is not null),
ends as (select word, arg_max(root, step) as root from walk group by 1)
select word, n, n_near, form, form_n, coalesce(root, word) as root from forms left join ends using (word)"""
