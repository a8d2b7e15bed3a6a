"""Comparison of a proposed result with the deployed one, without side effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta(current: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: ADDED, REMOVED, CHANGED or UNCHANGED, with both values as structs."""
    values = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*values).alias("before"))
    new = proposed.select(*keys, F.struct(*values).alias("after"))
    same: Column = reduce(Column.__and__, (F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in values), F.lit(True))
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("CHANGED")
    return old.join(new, keys, "full_outer").withColumn("change", change)


def counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def results(current: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Current, proposed and changed rows as one relation, told apart by result_set."""
    values = [c for c in current.columns if c not in keys]
    changed = delta(current, proposed, keys).filter("change <> 'UNCHANGED'")
    pick = [F.when(F.col("after").isNotNull(), F.col(f"after.{c}")).otherwise(F.col(f"before.{c}")).alias(c) for c in values]
    tag = lambda df, name: df.select(F.lit(name).alias("result_set"), *keys, *values)
    return tag(current, "current").unionByName(tag(proposed, "proposed")).unionByName(tag(changed.select(*keys, *pick), "delta"))


def five_results(current: DataFrame, proposed: DataFrame, keys: list[str], events: DataFrame, work: DataFrame) -> DataFrame:
    """results() and, as result sets of their own, the lifecycle events and the work that a deployment would make (keys and kind)."""
    told = lambda df, name: df.select(F.lit(name).alias("result_set"), *keys, "kind")
    return results(current, proposed, keys).unionByName(told(events, "lifecycle").unionByName(told(work, "work")), allowMissingColumns=True)


def report(current: DataFrame, proposed: DataFrame, keys: list[str], most: int, before: tuple, after: tuple) -> DataFrame:
    """One row about a comparison: READY with counts by change, or PARTIAL without them.

    PARTIAL: either side has more than `most` rows, or the source's checksum (rows and
    checksum, as checksum() gives them) before the comparison is not the one after it.
    """
    moved = tuple(before) != tuple(after)
    sizes = current.agg(F.count(F.lit(1)).alias("current_rows")).crossJoin(proposed.agg(F.count(F.lit(1)).alias("proposed_rows")))  # one row each
    kinds = ("ADDED", "REMOVED", "CHANGED", "UNCHANGED")
    counted = delta(current, proposed, keys).agg(*(F.count_if(F.col("change") == k).alias(k.lower()) for k in kinds))  # one row
    ready = F.lit(not moved) & (F.col("current_rows") <= most) & (F.col("proposed_rows") <= most)
    return sizes.crossJoin(counted).select(F.when(ready, "READY").otherwise("PARTIAL").alias("state"), "current_rows", "proposed_rows", *(F.when(ready, F.col(k.lower())).alias(k.lower()) for k in kinds))


def policy_rows(members: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """A policy set for comparisons: MEMBER rows member:<kind>:<name>:<version> and ELIGIBLE rows subject:<hex of the canonical key>."""
    member = members.select(F.lit("MEMBER").alias("state"), F.concat_ws(":", F.lit("member"), "kind", "name", F.col("version").cast("string")).alias("key"))
    text = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    return member.union(subjects.select(*keys).distinct().select(F.lit("ELIGIBLE"), F.concat(F.lit("subject:"), F.lower(F.hex(text.cast("binary"))))))


def checksum(rows: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of them: the sum of 32 bits of each row's MD5.

    Sums combine before the shuffle; no list of rows is made anywhere.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns))
    return rows.select(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint").alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("bigint").alias("checksum"))


def source_current(source: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether stored rows are still the source's. state, missing (only the source has them), extra (only stored).

    SCHEMA_CHANGED: columns have other names or types, and rows are not compared. Else rows
    are compared as multisets: STALE or CURRENT. Sums combine before the shuffle.
    """
    shape = lambda df: sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    if shape(source) != shape(stored):
        return source.sparkSession.createDataFrame([("SCHEMA_CHANGED", None, None)], "state string, missing long, extra long")
    both = source.withColumn("_n", F.lit(1)).unionByName(stored.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*source.columns).agg(F.sum("_n").alias("_n"))
    none = F.lit(0).cast("bigint")
    said = left.agg(F.coalesce(F.sum(F.greatest("_n", none)), none).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("_n"), none)), none).alias("extra"))
    return said.select(F.when(F.col("missing") + F.col("extra") > 0, "STALE").otherwise("CURRENT").alias("state"), "missing", "extra")
