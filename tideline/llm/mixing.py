"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Nonnegative document rates ``r`` are then
fitted so that the expected domain token totals ``t_k = sum_d r_d n_d p_dk`` match the targets ``T_k``: projected gradient on
``sum_k (t_k - T_k)^2 / s_k`` (``s_k``: totals at rate 1) in the metric of the token counts, which has step bound 1 because
posteriors sum to one. A document's rate depends on its posterior and on the few residual vectors so far, so an iteration is one pass
that sums ``K`` numbers. After some iterations the rates so far are written, so that a pass replays few of them. The fit ends when
every domain meets its own target, or when the targets cannot be met within the bounds on rates and no domain's total moves any more;
``targets_reached`` tells which. Built-in column functions and MLlib only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import durable, forget

DIMENSIONS = 1 << 13
PER_DOMAIN = 2500
ROUNDS = 60
REPLAY = 8  # steps that a pass replays before rates are written
TOLERANCE = 1e-3  # of a domain's target
PROGRESS = 1e-4  # of a domain's target: least move of some domain in an iteration
SCARCE = 1e-3  # share of the total that stands for smaller targets in both
SEPARATORS = "[ \\t\\n\\x0B\\f\\r]+"


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_words`` (lower-cased words of the whole text; null: none) and ``_tokens``, their number."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    return docs.withColumn("_words", words).withColumn("_tokens", F.size("_words").cast("double"))


def fit_domains(docs: DataFrame, labelled: DataFrame, per_domain: int = PER_DOMAIN):
    """Domain names and the pair (hashing, model) of a softmax regression over hashed words.

    ``labelled`` has (doc_id, domain); at most ``per_domain`` rows of each domain, by hash order, are used (broadcast ids) and weighed by
    the domain's true share among the labelled rows that ``docs`` holds. A doc_id with several domains counts with the first by name.
    """
    known = (labelled.where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
             .join(docs.select("doc_id"), "doc_id", "left_semi"))
    size = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    names = sorted(size)
    if not names:
        return [], None
    picked = None
    for i, name in enumerate(names):
        part = known.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain).select(
            "doc_id", F.lit(float(i)).alias("label"), F.lit(max(1.0, size[name] / per_domain)).alias("weight"))
        picked = part if picked is None else picked.union(part)
    hashing = HashingTF(numFeatures=DIMENSIONS, inputCol="_words", outputCol="_tf")
    scale = Normalizer(inputCol="_tf", outputCol="_features")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = durable(scale.transform(hashing.transform(with_words(rows))).select("label", "weight", "_features"))
    if len(names) < 2 or sample.select("label").distinct().count() < 2:
        return names[:1], None
    model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", family="multinomial", maxIter=25,
                               regParam=1e-4, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw").fit(sample)
    return names[:model.numClasses], (hashing, scale, model)


def posteriors(docs: DataFrame, names: list[str], model) -> DataFrame:
    """``docs`` with ``_tokens`` and ``_p``, the posterior over ``names``; one domain alone has probability 1."""
    docs = with_words(docs)
    if model is None:
        return docs.withColumn("_p", F.array(F.lit(1.0))).drop("_words")
    hashing, scale, regression = model
    return (regression.transform(scale.transform(hashing.transform(docs))).withColumn("_p", vector_to_array("_probability"))
            .drop("_words", "_tf", "_features", "_raw", "_probability", "_prediction"))


def rate_column(history: list[list[float]], least: float, most: float, start: Column | None = None) -> Column:
    """The rate after the given gradient steps, starting at 1 (or ``start``) and projected to [least, most] after each."""
    if not history:
        return F.lit(min(max(1.0, least), most)) if start is None else start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
    down = lambda g: F.aggregate(F.zip_with("_p", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(1.0) if start is None else start, lambda r, g: F.least(F.lit(most), F.greatest(F.lit(least), r - down(g))))


def fit_rates(members: DataFrame, weights: list[float], total: float | None = None, least: float = 0.0, most: float = 1e9) -> list[list[float]]:
    """Gradient steps that bring the expected domain totals of ``members`` (_tokens, _p) to ``weights`` of ``total``.

    Without ``total``, the tokens there are, or, if ``least`` is 1, the least total at which no domain has to shrink. A fit with
    bounds that keep a target out of reach ends at the bounded optimum, or after ``ROUNDS`` steps.
    """
    k = len(weights)
    sums = lambda rate: members.select("_tokens", "_p", rate.alias("_now")).agg(
        *[F.sum(F.col("_tokens") * F.col("_now") * F.col("_p")[i]).alias(f"s{i}") for i in range(k)]).first()
    now = [x or 0.0 for x in sums(F.lit(1.0))]
    size = [max(x, 1e-9) for x in now]
    if total is None:
        total = sum(now) if least < 1 else max([s / w for s, w in zip(now, weights, strict=True) if w > 0], default=0.0)
    target = [w * total for w in weights]
    history: list[list[float]] = []
    members, written = members.select("_tokens", "_p").withColumn("_rate", rate_column([], least, most)), 0
    scale = [max(t, SCARCE * total, 1e-9) for t in target]
    before = None
    for _ in range(ROUNDS):
        gap = [a - b for a, b in zip(now, target, strict=True)]
        if all(abs(g) <= TOLERANCE * c for g, c in zip(gap, scale, strict=True)):
            break
        if before and all(abs(a - b) <= PROGRESS * c for a, b, c in zip(now, before, scale, strict=True)):
            break
        before = now
        if len(history) - written == REPLAY:
            old = members
            members = durable(members.withColumn("_rate", rate_column(history[written:], least, most, F.col("_rate"))))
            if written:
                forget(old)
            written = len(history)
        history.append([g / s for g, s in zip(gap, size, strict=True)])
        now = [x or 0.0 for x in sums(rate_column(history[written:], least, most, F.col("_rate")))]
    return history


def targets_reached(members: DataFrame, names: list[str], weights: list[float], rate: Column) -> DataFrame:
    """domain, target_share and reached_share of the expected tokens of ``members`` at ``rate``; without tokens, reached is 0."""
    sums = [F.sum(F.col("_tokens") * rate * F.col("_p")[i]) for i in range(len(names))]
    total = F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x)
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("domain"), F.lit(w).alias("target_share"), F.coalesce(
        F.try_divide(F.col("_sums")[i], total), F.lit(0.0)).alias("reached_share")) for i, (n, w) in enumerate(zip(names, weights, strict=True))]))
    return members.agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in sums]).alias("_sums")).select(rows)


def aligned(weights: dict[str, float], names: list[str]) -> list[float]:
    """Target weights in the order of ``names``, scaled to sum to one; a domain without a weight gets none."""
    found = [max(0.0, weights.get(n, 0.0)) for n in names]
    return [w / sum(found) for w in found] if sum(found) > 0 else [1 / max(len(names), 1)] * len(names)


def copies(rate: Column, *key: str) -> Column:
    """Whole number of copies: the rate rounded up or down with a chance (by hash) that keeps its mean."""
    chance = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, domain posteriors (p_<domain>), rate and copies of every row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens and the posterior of an empty text; they do not move the totals. Repeated rows and ties in the
    posterior get the same rate each. Texts of any length are read whole. Other columns are not read. target_<domain> and
    reached_<domain> are the shares asked for and those of the fitted rates, the same in every row.
    """
    names, model = fit_domains(docs, labelled)
    names = names or ["all"]
    members = durable(posteriors(docs.select("doc_id", "text"), names, model).select("doc_id", "_tokens", "_p"))
    wanted = aligned(weights, names)
    rate = rate_column(fit_rates(members, wanted, total), 0.0, 1e9)
    shares = {r["domain"]: r for r in targets_reached(members, names, wanted, rate).collect()}  # a row a domain
    return members.withColumn("rate", rate).select(
        "doc_id", F.col("_tokens").cast("long").alias("n_tokens"), *[F.col("_p")[i].alias(f"p_{n}") for i, n in enumerate(names)], "rate",
        copies(F.col("rate"), "doc_id", "_tokens").alias("copies"),
        *[F.lit(shares[n][f"{kind}_share"]).alias(f"{kind}_{n}") for n in names for kind in ("target", "reached")])


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], least: float = 1.0, most: float = 8.0) -> DataFrame:
    """``docs`` with each row repeated as its rate says, columns kept. With ``least`` 1 no row is lost: scarce domains are repeated
    instead of others being thinned. Rows and posteriors are written once, so that no gradient step computes a posterior again;
    the fitted steps are few numbers, so the second pass computes rates in place: no shuffle."""
    names, model = fit_domains(docs, labelled)
    names = names or ["all"]
    own = docs.columns
    boxed = docs.select(F.struct(*own).alias("_row"), "text")
    members = durable(posteriors(boxed, names, model).select("_row", "_tokens", "_p"))
    history = fit_rates(members, aligned(weights, names), None, least, most)
    rated = members.withColumn("_copies", copies(rate_column(history, least, most), "_row.doc_id", "_row.text"))
    again = F.sequence(F.lit(1).cast("long"), F.col("_copies"))
    return rated.where(F.col("_copies") > 0).select("_row", F.explode(again).alias("_copy")).select(
        *[F.col("_row")[c].alias(c) for c in own])
