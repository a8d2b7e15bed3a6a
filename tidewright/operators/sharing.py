"""Conditions with several consumers, outgoing envelopes, and keys behind surrogates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import identity

FAN_OUT = 1_000


def cost(conditions: dict[str, DataFrame], consumers: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Per shared condition its rows, its consumers (columns condition, consumer), and whether they are too many."""
    rows = None
    for name, df in conditions.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("condition"), "rows")
        rows = one if rows is None else rows.union(one)
    used = consumers.groupBy("condition").agg(F.count_distinct("consumer").alias("consumers"))
    return rows.join(used, "condition", "left").na.fill(0, ["consumers"]).withColumn("over_limit", F.col("consumers") > fan_out)


def envelopes(events: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Events as JSON documents for an outbox, with the idempotency key that receivers drop repeats by."""
    body = F.to_json(F.struct(F.lit(1).alias("envelope_version"), F.lit(rule).alias("rule"), *keys, "kind", "generation", "revision"))
    key = identity.event_key(F.lit(rule), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.col("generation"), F.col("kind"), F.col("revision"))
    return events.select(key.alias("idempotency_key"), body.alias("body"))


def public_keys(surrogates: DataFrame, facts: DataFrame, parts: list[tuple[str, str]]) -> DataFrame:
    """The public key columns of facts for rows that carry only a surrogate."""
    known = facts.select(identity.surrogate(identity.canonical_tuple([(F.col(c), k) for c, k in parts])).alias("surrogate"), *(c for c, _ in parts)).distinct()
    return surrogates.join(known, "surrogate")


def page(rows: DataFrame, order: str, after: object | None, limit: int) -> DataFrame:
    """The next rows in an order, one more than limit so that the reader sees whether others follow."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    return (rows if after is None else rows.filter(F.col(order) > F.lit(after))).orderBy(order).limit(limit + 1)


def listed(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Values of each key in an order, joined by commas; ties by value. Made for bounded groups: a list is one row."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return rows.groupBy(*keys).agg(both.alias("l")).select(*keys, F.expr("array_join(transform(l, x -> x.v), ',')").alias("listed"), F.size("l").cast("bigint").alias("n"))
