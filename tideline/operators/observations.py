"""Raw nested records to typed observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import rules

# The eight fields that make up the state a record shows.
SIGNATURE = ("price", "price_amount_int", "price_currency", "regular", "regular_amount_int",
             "regular_currency", "cut", "deal_status")
OBSERVATION = ("entity_id", "record_index", "ts", "shop_id", "shop_name", "deal_status", "price",
               "price_amount_int", "price_currency", "regular", "regular_amount_int",
               "regular_currency", "cut", "kind", "issue")


def record_problem(record_ok: Column, shop_id: Column, ts: Column) -> Column:
    return (F.when(~record_ok, "record_not_object").when(shop_id.isNull(), "invalid_shop_id")
            .when(ts.isNull(), "invalid_timestamp"))


def type_records(raw: DataFrame, *, ts: Column | None = None,
                 deal_status: Column | None = None) -> DataFrame:
    """Flatten ``entity_id, record_index, timestamp, shop, deal`` into typed observations.

    ``timestamp`` may be zone-free UTC or ISO text; ``deal`` is a nullable struct. A null or
    contradictory deal stays ambiguous, never full price, and zero prices are kept.
    """
    if ts is None:
        is_text = dict(raw.dtypes)["timestamp"] == "string"
        ts = rules.utc_instant(F.col("timestamp")) if is_text else F.col("timestamp")
    if deal_status is None:
        deal_status = F.when(F.col("deal").isNull(), "null").otherwise("object")
    flat = raw.select(
        "entity_id", "record_index", ts.alias("ts"),
        F.col("shop.id").alias("shop_id"), F.col("shop.name").alias("shop_name"),
        deal_status.alias("deal_status"),
        F.col("deal.price.amount").alias("price"),
        F.col("deal.price.amountInt").alias("price_amount_int"),
        F.col("deal.price.currency").alias("price_currency"),
        F.col("deal.regular.amount").alias("regular"),
        F.col("deal.regular.amountInt").alias("regular_amount_int"),
        F.col("deal.regular.currency").alias("regular_currency"),
        F.col("deal.cut").cast("double").alias("cut"))
    issue = rules.observation_issue(*[F.col(c) for c in (
        "deal_status", "price", "regular", "cut", "price_currency", "regular_currency")])
    typed = flat.withColumn("issue", issue)
    return typed.select("*", rules.observation_kind(F.col("issue"), F.col("cut")).alias("kind")) \
        .select(*OBSERVATION)


def of_shop(observations: DataFrame, shop_id: int) -> DataFrame:
    """Records of one shop with a usable time."""
    return observations.where((F.col("shop_id") == shop_id) & F.col("ts").isNotNull())


def parse_counts(observations: DataFrame, shop_id: int) -> DataFrame:
    """Records per outcome: kept, other shop, or the reason they cannot be used."""
    problem = record_problem(F.lit(True), F.col("shop_id"), F.col("ts"))
    outcome = (F.when(F.col("shop_id").isNotNull() & (F.col("shop_id") != shop_id), "other_shop")
               .when(problem.isNotNull(), problem).otherwise("kept"))
    return observations.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("records"))


def deal_gate(observations: DataFrame) -> DataFrame:
    """Strict validity of each record's deal, one reason per record (null = valid)."""
    money_bad = lambda amount, units, cur: ~F.coalesce(
        ~F.isnan(F.col(amount)) & (F.col(amount) >= 0) & (F.col(units) >= 0)
        & F.col(cur).rlike(rules.CURRENCY_PATTERN), F.lit(False))
    reason = (F.when(F.col("ts").isNull(), "invalid_timestamp")
              .when(F.col("shop_id").isNull(), "invalid_shop")
              .when(F.col("deal_status") == "null", None)
              .when(~F.coalesce(F.col("cut").between(0, 100), F.lit(False)), "invalid_cut")
              .when(money_bad("price", "price_amount_int", "price_currency"), "invalid_price")
              .when(money_bad("regular", "regular_amount_int", "regular_currency"), "invalid_regular"))
    return observations.withColumn("gate_reason", reason)


def history_diagnostics(observations: DataFrame, shop_id: int) -> DataFrame:
    """Per entity: record, shop, null-deal and invalid counts with first and last time."""
    own = F.col("shop_id") == shop_id
    return deal_gate(observations).groupBy("entity_id").agg(
        F.count("*").alias("records"), F.count_if(own).alias("own_shop_records"),
        F.count_if(~own).alias("other_shop_records"),
        F.count_if(F.col("deal_status") == "null").alias("null_deals"),
        F.count_if(F.col("gate_reason").isNotNull()).alias("invalid_records"),
        F.min(F.when(own, F.col("ts"))).alias("first_ts"),
        F.max(F.when(own, F.col("ts"))).alias("last_ts"))


def state_hash(seed: int) -> Column:
    """Hash of the eight state fields with nulls as values of their own."""
    nulls = F.lit(0)
    for i, name in enumerate(SIGNATURE):
        nulls = nulls + F.when(F.col(name).isNull(), 1 << i).otherwise(0)
    return F.xxhash64(F.lit(seed), nulls, *SIGNATURE)


def with_state(observations: DataFrame) -> DataFrame:
    """Add a 128-bit state identity as two longs, cheap to min/max in a hash aggregate."""
    return observations.select("*", state_hash(1).alias("state_a"), state_hash(2).alias("state_b"))


def instants(observations: DataFrame, *tags: str) -> DataFrame:
    """One row per entity and timestamp (and tag columns); the only shuffle that carries every observation.

    All buffers are fixed-width, so this is a hash aggregate with map-side combining: a hot
    entity spreads over its timestamps and a hot timestamp collapses before the shuffle.
    """
    kind = F.col("kind")
    valid = kind != "ambiguous"
    discount = kind == "discount"
    code = rules.currency_code(F.col("price_currency"))
    rows = with_state(observations)
    differ = lambda cond: (F.min(F.when(cond, F.col("state_a"))) != F.max(F.when(cond, F.col("state_a")))) \
        | (F.min(F.when(cond, F.col("state_b"))) != F.max(F.when(cond, F.col("state_b"))))
    return rows.groupBy("entity_id", "ts", *tags).agg(
        F.count("*").alias("n"), F.count_if(discount).alias("n_discount"),
        F.count_if(kind == "full_price").alias("n_full"),
        F.count_if(kind == "ambiguous").alias("n_ambiguous"),
        F.count_if(F.col("deal_status") == "null").alias("n_null_deal"),
        differ(F.lit(True)).alias("conflict"),
        F.coalesce(differ(valid), F.lit(False)).alias("valid_conflict"),
        F.min("state_a").alias("state_a"), F.min("state_b").alias("state_b"),
        F.min("record_index").alias("lowest_index"),
        F.max(F.when(valid, F.col("price"))).alias("valid_price"),
        F.max(F.when(valid, F.col("cut"))).alias("valid_cut"),
        F.min(F.when(valid, code)).alias("currency_low"),
        F.max(F.when(valid, code)).alias("currency_high"),
        F.sum(F.when(discount, F.col("cut"))).alias("discount_cut_sum"),
        F.max(F.when(discount, F.col("cut"))).alias("discount_cut_max"))
