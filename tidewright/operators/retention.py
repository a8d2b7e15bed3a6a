"""Retention: what is old enough to go, what is protected, and how it goes in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview(rows: DataFrame, old: Column, protected: DataFrame, keys: list[str], family: str) -> DataFrame:
    """One row of the family: how many rows are eligible, and how many are old but protected."""
    kept = protected.select(*keys).distinct().withColumn("kept", F.lit(True))
    marked = rows.filter(old).join(kept, keys, "left").agg(F.count_if(F.col("kept").isNull()).alias("eligible"), F.count_if(F.col("kept").isNotNull()).alias("protected"))
    return marked.select(F.lit(family).alias("family"), "eligible", "protected")


def batch(rows: DataFrame, old: Column, protected: DataFrame, keys: list[str], identity: str, limit: int) -> DataFrame:
    """The next rows to go, in the order of their identity (a batch; limit is the feature)."""
    return rows.filter(old).join(protected.select(*keys).distinct(), keys, "left_anti").orderBy(identity).limit(limit)


def tombstones(gone: DataFrame, identity: str, family: str, at: int) -> DataFrame:
    return gone.select(F.lit(family).alias("family"), F.col(identity).cast("string").alias("identity"), F.lit(at).cast("bigint").alias("removed_at"))


def remaining(rows: DataFrame, gone: DataFrame, identity: str) -> DataFrame:
    return rows.join(gone.select(identity), identity, "left_anti")


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that may go: those without children left."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def families(tables: dict[str, tuple[DataFrame, Column, str]], parents: dict[str, str], protected: dict[str, DataFrame]) -> DataFrame:
    """Every family's preview, in the order in which families go: children before parents.

    tables has (rows, old, key) by family, parents the parent of each child family and
    protected the keys of a family that stay. Columns: ordinal, family, eligible, protected.
    """
    depth = {name: 0 for name in tables}
    for _ in tables:
        for child, parent in parents.items():
            depth[child] = max(depth[child], depth[parent] + 1)
    if max(depth.values(), default=0) > len(tables) - 1:
        raise ValueError("families are their own parents")
    out = None
    for k, name in enumerate(sorted(tables, key=lambda n: (-depth[n], n))):
        rows, old, key = tables[name]
        kept = protected.get(name, rows.select(key).filter("false"))
        one = preview(rows, old, kept, [key], name).select(F.lit(k).alias("ordinal"), "family", "eligible", "protected")
        out = one if out is None else out.union(one)
    return out


def without_payloads(rows: DataFrame, old: Column, payloads: list[str]) -> DataFrame:
    """rows with the payload columns of old ones emptied."""
    return rows.withColumns({p: F.when(~F.coalesce(old, F.lit(False)), F.col(p)) for p in payloads})
