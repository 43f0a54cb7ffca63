"""Collection data: attempt journals, work planning, manifests, evidence ledgers, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators import prefix
from tideline.operators.features import count_violations
from tideline.operators.windows import Calendar


# ------------------------------------------------------------------ journal
def journal_counts(events: DataFrame) -> DataFrame:
    """Attempts, successful and failed results, and attempts without a known outcome."""
    kind, ok = F.col("kind"), F.coalesce(F.col("http_status") == 200, F.lit(False))
    return events.agg(
        F.count_if(kind == "attempt").alias("attempts"), F.count_if((kind == "result") & ok).alias("successful"),
        F.count_if((kind == "result") & ~ok).alias("failed"),
        (F.count_if(kind == "attempt") - F.count_if(kind == "result")).alias("unknown_outcome"))


def with_round(events: DataFrame) -> DataFrame:
    """Add the retry round in force for the entity: rounds opened before this event.

    For attempts and rounds; results carry no entity of their own.
    """
    opened = F.when(F.col("kind") == "round", 1).otherwise(0).cast("bigint")
    return prefix.prefix_sums(events, ["entity_id"], [F.col("pos")], {"rounds": opened}) \
        .withColumnRenamed("rounds_before", "current_round")


def journal_violations(events: DataFrame) -> DataFrame:
    """Sequence rules of an append-only journal, one row per rule.

    Expected numbers come from bucketed ranks and running counts, so the one global attempt
    sequence is not checked in a single task.
    """
    kind = F.col("kind")
    attempts = events.where(kind == "attempt").withColumn("_all", F.lit(1))
    numbered = prefix.ranked(attempts, ["_all"], [F.col("pos")], "expected")
    gap = numbered.agg(F.lit("attempt_sequence").alias("rule"), F.count_if(F.col("sequence") != F.col("expected")).alias("violations"))
    per_round = count_violations(with_round(events.where(kind.isin("attempt", "round"))), {
        "round_sequence": (kind == "round") & (F.col("round") != F.col("current_round") + 1),
        "attempt_round": (kind == "attempt") & (F.col("round") != F.col("current_round"))})
    status = count_violations(events, {
        "http_status": (kind == "result") & F.col("http_status").isNotNull() & ~F.col("http_status").between(100, 599)})
    results = events.where(kind == "result").groupBy("sequence").agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    made = events.where(kind == "attempt").groupBy("sequence").agg(F.min("pos").alias("_made"))
    pairs = results.join(made, "sequence", "left")
    outcome = pairs.agg(F.array(
        F.struct(F.lit("repeated_result").alias("rule"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")),
        F.struct(F.lit("result_without_earlier_attempt").alias("rule"),
                 F.count_if(F.col("_made").isNull() | (F.col("_made") > F.col("_first"))).alias("violations"))).alias("a")) \
        .select(F.inline("a"))
    return gap.unionByName(per_round).unionByName(status).unionByName(outcome)


def attempt_usage(events: DataFrame, per_key: int = 3, budget: int | None = None) -> DataFrame:
    """Number every attempt per (entity, endpoint, round) and overall; mark those over a cap."""
    attempts = events.where(F.col("kind") == "attempt").withColumn("_all", F.lit(1))
    own = prefix.ranked(attempts, ["entity_id", "endpoint", "round"], [F.col("pos")], "use")
    every = prefix.ranked(own, ["_all"], [F.col("pos")], "overall")
    over = (F.col("overall") > budget) if budget is not None else F.lit(False)
    return every.select("entity_id", "endpoint", "round", "pos", "use", "overall",
                        ((F.col("use") > per_key) | over).alias("over_cap"))


def plan_work(cohort: DataFrame, *, retry_failed: bool, limit: int | None = None) -> DataFrame:
    """Entities still to collect, in cohort order, with the requests each needs.

    ``cohort``: ``position, entity_id, status (valid/invalid/incomplete/absent), lookup_status,
    history_status, stale``. Valid and invalid copies are skipped unless stale; incomplete ones
    need a retry or an interruption.
    """
    c = F.col
    interrupted = F.coalesce((c("lookup_status") == "matched") & (c("history_status") == "not_requested"), F.lit(False))
    todo = c("stale") | (c("status") == "absent") | ((c("status") == "incomplete") & (F.lit(retry_failed) | interrupted))
    reuse = F.coalesce((c("status") == "incomplete") & (c("lookup_status") == "matched"), F.lit(False)) & ~c("stale")
    rows = cohort.where(todo).select(
        "position", "entity_id", reuse.alias("reuse_lookup"),
        (c("stale") | (F.lit(retry_failed) & (c("status") == "incomplete") & ~interrupted)).alias("new_round"),
        F.when(reuse, 1).otherwise(2).alias("requests"))
    return rows if limit is None else rows.orderBy("position").limit(limit)


# ------------------------------------------------------------------ manifest
def manifest_rollup(manifest: DataFrame) -> DataFrame:
    """Status counts and record totals of a collection manifest, with the exact median."""
    good = F.col("history_status").isin("history_received", "empty_history")
    full = F.col("history_status") == "history_received"
    base = manifest.agg(
        F.count("*").alias("entities"), F.count_if(F.col("lookup_status") == "matched").alias("matched"),
        F.count_if(F.col("lookup_status") == "not_found").alias("not_found"), F.count_if(good).alias("successful"),
        F.count_if(full).alias("nonempty"), F.count_if(F.col("history_status") == "empty_history").alias("empty"),
        F.count_if(F.col("history_status") == "request_failed").alias("failed"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("own_shop_records"), F.lit(0)).alias("own_shop_records"),
        F.coalesce(F.sum("other_shop_records"), F.lit(0)).alias("other_shop_records"),
        F.min(F.when(full, F.col("first_ts"))).alias("earliest_from"), F.max(F.when(full, F.col("first_ts"))).alias("earliest_to"),
        F.min(F.when(full, F.col("last_ts"))).alias("latest_from"), F.max(F.when(full, F.col("last_ts"))).alias("latest_to"),
        F.min(F.when(good, F.col("records"))).alias("fewest"), F.max(F.when(good, F.col("records"))).alias("most"))
    median = prefix.quantiles(manifest.where(good), [], "records", {"m": .5}).select("m").scalar()
    return base.withColumn("median_records", F.round(median, 6))


def boundary_coverage(manifest: DataFrame, calendar: Calendar) -> DataFrame:
    """Per window: entities observed before its start date and after its end date."""
    rows = calendar.each_window(manifest.where(F.col("history_status").isin("history_received", "empty_history")))
    return rows.groupBy("window_year").agg(
        F.count_if(F.col("first_ts").cast("date") < F.col("start_date")).alias("observed_before_start"),
        F.count_if(F.col("last_ts").cast("date") > F.col("end_date")).alias("observed_after_end"))


# ------------------------------------------------------------------ receipts
def receipt_evidence(receipts: DataFrame, received: str, cutoff: Column) -> DataFrame:
    """Was the snapshot received before the cutoff, and how many days after it otherwise."""
    from tideline.functions import rules

    before = F.col(received) < cutoff
    return receipts.select("*", before.alias("received_before_cutoff"),
                           F.round(rules.gap_days(cutoff, F.col(received)), 6).alias("days_after_cutoff"),
                           F.when(before, "receipt_before_cutoff").otherwise("later_snapshot_proves_nothing").alias("interpretation"))


# ------------------------------------------------------------------ evidence ledger
def ledger_violations(ledger: DataFrame, pairs: DataFrame, windows: Calendar, end: Column) -> DataFrame:
    """Rules of a reviewed evidence ledger, one row per rule.

    Reuse references are checked by a self-join on the attempt id, coverage of the selected
    pairs by anti-joins.
    """
    c = F.col
    inlined = windows.literal_array()
    known = ledger.select("*", F.filter(inlined, lambda w: w["window_year"] == c("window_year"))[0].alias("w"))
    inside = F.coalesce((c("observed_ts") >= c("w.window_start")) & (c("observed_ts") < c("w.window_end")), F.lit(False))
    fields = ["observed_ts", "observed_price", "regular_price", "discount_percent", "currency", "region"]
    any_field = F.lit(False)
    for f in fields:
        any_field = any_field | c(f).isNotNull()
    scoped = c("currency").isNotNull() & c("region").isNotNull()
    number_ok = F.coalesce((c("observed_price") >= 0) & (c("observed_price") < c("regular_price"))
                           & (c("discount_percent") > 0) & (c("discount_percent") <= 100), F.lit(False))
    covers = F.coalesce((c("coverage_start") <= c("w.window_start")) & (c("w.window_end") <= c("coverage_end"))
                        & (c("coverage_end") <= end), F.lit(False))
    own = count_violations(known, {
        "source_address": ~c("source_url").startswith("https://"),
        "future_observation": F.coalesce(c("observed_ts") >= end, F.lit(False)),
        "fabricated_fields": ~c("observation_available") & any_field,
        "unsupported_claim": ~c("observation_available") & (c("supports_discount") | c("supports_absence")),
        "inaccessible_observation": c("observation_available") & ~c("page_accessible"),
        "observation_without_time": c("observation_available") & c("observed_ts").isNull()
        & (c("coverage_start").isNull() | c("coverage_end").isNull()),
        "discount_claim": c("supports_discount") & ~(inside & scoped & number_ok),
        "absence_claim": c("supports_absence") & ~(covers & scoped)})
    ids = ledger.groupBy("attempt_id").agg(F.count("*").alias("_n"), F.first("source_url").alias("_url"))
    reuse = ledger.where(c("reuse_of").isNotNull()).select(c("reuse_of").alias("attempt_id"), "source_url") \
        .join(ids, "attempt_id", "left")
    bad_reuse = reuse.agg(F.lit("reuse_reference").alias("rule"), F.count_if(
        c("_url").isNull() | (c("_url") != c("source_url"))).alias("violations"))
    dup = ids.agg(F.lit("duplicate_attempt").alias("rule"), F.count_if(c("_n") > 1).alias("violations"))
    key = ["entity_id", "window_year"]
    stray = ledger.join(pairs, key, "left_anti").agg(F.lit("outside_selected_pairs").alias("rule"), F.count("*").alias("violations"))
    bare = pairs.join(ledger, key, "left_anti").agg(F.lit("pair_without_attempt").alias("rule"), F.count("*").alias("violations"))
    return own.unionByName(bad_reuse).unionByName(dup).unionByName(stray).unionByName(bare)


# What a reviewer may say about a conflict, and the one kind of coverage that can prove an absence.
CONFLICTS = ("YES", "NO", "NOT_ASSESSABLE")
COMPLETE = "continuous_documented_complete"


def _scoped() -> Column:
    """A claim names shop, currency, region and purchase scope, and can be verified independently."""
    c = F.col
    return F.coalesce(c("store_explicit") & c("verifiable"), F.lit(False)) & c("currency").isNotNull() & c("region").isNotNull() & c("purchase_scope").isNotNull()


def _documented() -> Column:
    """Coverage of the complete kind, with a document and a proof."""
    c = F.col
    return F.coalesce((c("coverage_kind") == COMPLETE) & c("completeness_url").startswith("https://") & (F.trim("coverage_proof") != ""), F.lit(False))


def ledger_provenance_violations(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules on where reviewed evidence comes from and what a claim must bring along, one row per rule.

    Besides the columns of ``ledger_violations``: ``source_id``, known to ``sources``; ``conflict``; ``store_explicit, verifiable, purchase_scope``;
    and for absences ``coverage_kind, completeness_url, coverage_proof``.
    """
    c = F.col
    own = count_violations(ledger, {
        "conflict_value": ~c("conflict").isin(*CONFLICTS),
        "conflict_without_observation": ~c("observation_available") & (c("conflict") != "NOT_ASSESSABLE"),
        "verified_without_observation": ~c("observation_available") & (F.coalesce("verifiable", F.lit(False)) | F.coalesce("store_explicit", F.lit(False)) | c("purchase_scope").isNotNull()),
        "discount_scope": c("supports_discount") & ~_scoped(),
        "absence_scope": c("supports_absence") & ~_scoped(),
        "absence_documentation": c("supports_absence") & ~_documented()})
    named = sources.groupBy("source_id").agg(F.count("*").alias("_n"))
    count = lambda rows, name: rows.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    return own.unionByName(count(ledger.join(named, "source_id", "left_anti"), "unknown_source")).unionByName(count(named.where("_n > 1"), "repeated_source"))


def absence_coverage(ledger: DataFrame, windows: Calendar, end: Column) -> DataFrame:
    """(entity_id, window_year, covered, first_gap): whether a pair's documented intervals together cover its whole window.

    Only scoped and documented absence claims that end by ``end`` count, clipped to the half-open window. Openings and closings are summed for each time and
    running sums over times (``prefix.prefix_sums``) give how many intervals are open after it, so a pair with a third of
    all rows is no single task. A time without an open interval begins a gap; pairs without a usable claim are uncovered from the window's start.
    """
    c, pair = F.col, ["entity_id", "window_year"]
    claims = ledger.where("supports_absence").withColumn("w", F.filter(windows.literal_array(), lambda w: w["window_year"] == c("window_year"))[0]).where("w IS NOT NULL")
    usable = F.coalesce(_scoped() & _documented() & (c("coverage_end") <= end), F.lit(False))
    start, stop = F.greatest("coverage_start", "w.window_start"), F.least("coverage_end", "w.window_end")
    times = claims.where(usable).select(*pair, start.alias("a"), stop.alias("z")).where("a < z").select(
        *pair, F.inline(F.array(F.struct(c("a").alias("t"), F.lit(1).alias("step")), F.struct(c("z").alias("t"), F.lit(-1).alias("step")))))
    steps = times.groupBy(*pair, "t").agg(F.sum("step").alias("step"))
    depth = prefix.prefix_sums(steps, pair, [c("t")], {"open": c("step")})
    found = depth.groupBy(*pair).agg(F.min("t").alias("first"), F.min(F.when(c("open_before") + c("step") == 0, c("t"))).alias("closed"))
    all_pairs = claims.groupBy(*pair).agg(F.min("w.window_start").alias("begin"), F.min("w.window_end").alias("stop"))
    gap = F.when(c("first").isNull() | (c("first") > c("begin")), c("begin")).when(c("closed") < c("stop"), c("closed"))
    return all_pairs.join(found, pair, "left").select(*pair, gap.isNull().alias("covered"), gap.alias("first_gap"))


def ledger_summary(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair counts by what the ledger holds for them; one row per pair is enough to count."""
    key = ["entity_id", "window_year"]
    flags = ledger.groupBy(*key).agg(*[F.bool_or(f).alias(f) for f in (
        "page_accessible", "observation_available", "supports_discount", "supports_absence", "contradicts")])
    rows = pairs.join(flags, key, "left")
    f = lambda n: F.coalesce(F.col(n), F.lit(False))
    return rows.agg(
        F.count("*").alias("pairs"), F.count_if(f("page_accessible")).alias("accessible_pairs"),
        F.count_if(f("observation_available")).alias("observed_pairs"), F.count_if(f("supports_discount")).alias("positive_pairs"),
        F.count_if(f("supports_absence")).alias("absence_pairs"),
        F.count_if(f("observation_available") & ~f("supports_discount") & ~f("supports_absence")).alias("partial_pairs"),
        F.count_if(f("contradicts")).alias("conflicting_pairs"), F.count_if(~f("observation_available")).alias("not_verifiable_pairs"))
