"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Built-in column functions and MLlib only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import durable

SAMPLE = 12_000
TREES, DEPTH = 10, 4
PRIOR = 20.0
FOLDS = 5

FEATURES = ["length", "host_length", "host_depth", "path_depth", "path_length", "digit_ratio", "entropy", "parameters", "query_length",
            "fragment", "tail_digits", "suffix_rate", "domain_rate"]


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules: list[tuple[str, str]], host_: str = "host", path_: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are (allow or block, host/path). A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host_) == name) | F.col(host_).endswith(f".{name}")) & F.col(path_).startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features (all but the suffix rates), and the host's last label and last two labels."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    some = F.greatest(size, F.lit(1))
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / some
    # Distinct characters are few, so the fold is short even for very long urls.
    letters = F.array_distinct(F.split(url, ""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return pages.select(
        "*", size.cast("double").alias("length"), F.length("host").cast("double").alias("host_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_depth"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("path_depth"),
        F.length("path").cast("double").alias("path_length"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / some).alias("digit_ratio"),
        F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"),
        F.length(query).cast("double").alias("query_length"), url.contains("#").cast("double").alias("fragment"),
        F.length(F.regexp_extract(F.reverse("path"), r"^[^0-9]*([0-9]*)", 1)).cast("double").alias("tail_digits"),
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"))


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS))


def smoothed(there: Column | None = None) -> Column:
    """Smoothed share of blocked rows among those that are ``there``."""
    of = lambda c: F.sum(c) if there is None else F.coalesce(F.sum(F.when(there, c)), F.lit(0.0))
    return (of(F.col("label") * F.col("copies")) + PRIOR / 2) / (of(F.col("copies").cast("double")) + PRIOR)


def rates(taught: DataFrame, key: str, name: str) -> DataFrame:
    """Smoothed share of blocked rows for each key of all rows that rules decide; ``taught`` has distinct urls and their copies."""
    return taught.groupBy(key).agg(smoothed().alias(name))


def fold_rates(taught: DataFrame, key: str, name: str) -> DataFrame:
    """``rates``, and in ``<name>s`` the same without the urls of each fold.

    A url that teaches the trees has the rate without its own fold, so that it is not told its own verdict: a key whose urls all lie
    in one fold has the rate of an unseen key there.
    """
    return taught.groupBy(key).agg(smoothed().alias(name), F.array(*[smoothed(fold(F.col("url")) != i) for i in range(FOLDS)]).alias(f"{name}s"))


def picked(taught: DataFrame, sizes: dict[float, int], sample: int) -> DataFrame:
    """At most ``sample`` distinct urls in hash order, half of each verdict or what the other one leaves; weights stand for all rows."""
    parts = []
    for label, size in sizes.items():
        others = sum(sizes.values()) - size
        quota = min(size, max(sample // 2, sample - others))
        parts.append(taught.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(quota)
                     .withColumn("weight", F.col("copies") * (size / quota)))
    return parts[0].union(parts[1])


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, the rule that fits and its verdict (``ruled``)."""
    known = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = ruled(rules)
    return known.withColumns({"rule": rule, "ruled": verdict})


def judged(known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``known`` (see ``with_rules``); trees learn from its ruled rows."""
    taught = durable(known.where("ruled is not null").groupBy("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
                     .agg(F.count("*").alias("copies")).withColumns(
        {"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)}))
    sizes = {r["label"]: r["count"] for r in taught.groupBy("label").count().orderBy("label").collect()}
    if len(sizes) < 2:
        return known.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    suffix, domain = (durable(fold_rates(taught, k, f"{k}_rate")) for k in ("suffix", "domain"))

    def vectors(df: DataFrame, teaches: bool) -> DataFrame:
        joined = df.join(suffix, "suffix", "left").join(domain, "domain", "left")
        if teaches:
            joined = joined.withColumns({r: F.element_at(f"{r}s", (fold(F.col("url")) + 1).cast("int")) for r in ("suffix_rate", "domain_rate")})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined.fillna(0.5, ["suffix_rate", "domain_rate"]))

    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=3).fit(
        durable(vectors(lexical(picked(taught.drop("suffix", "domain"), sizes, sample)), True).select("features", "label", "weight").repartition(4)))
    scored = trees.transform(vectors(lexical(known), False)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url; other columns are not read).

    Rates of suffixes and domains count all rows that a rule decides. Trees learn from at most ``sample`` distinct urls of them, with
    copies as weight and rates without their own fold; if the rules leave only one verdict or none, other urls are allowed. A null url,
    or one without ``://``, has an empty host and path, which the trees judge. Repeated rows are judged each. Urls of any length are
    read whole. Rules of one length cannot both fit unless equal; the later one by text then wins.
    """
    return judged(with_rules(pages, rules), sample)
