"""Effective-dated versions and parameter families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import written


def state_at(frontier: Column, valid_from: Column, valid_to: Column, status: Column) -> Column:
    """PAUSED and REMOVED as declared; else FUTURE, EXPIRED or CURRENT; intervals are half-open."""
    return F.when(status.isin("PAUSED", "REMOVED"), status).when(frontier < valid_from, "FUTURE").when(valid_to.isNotNull() & (frontier >= valid_to), "EXPIRED").otherwise("CURRENT")


def authority(versions: DataFrame, keys: list[str], frontier: int) -> DataFrame:
    """The version of each key that holds at the frontier: the latest start among those that contain it."""
    holding = versions.filter((F.col("valid_from") <= frontier) & (F.col("valid_to").isNull() | (F.col("valid_to") > frontier)))
    rest = [c for c in versions.columns if c not in keys]
    latest = F.max(F.struct("valid_from", *(c for c in rest if c != "valid_from"))).alias("v")
    return holding.groupBy(*keys).agg(latest).select(*keys, *(F.col(f"v.{c}").alias(c) for c in rest))


def rejected(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Versions that can't be admitted: EMPTY or inverted intervals and OVERLAP with the one before."""
    at = Window.partitionBy(*keys).orderBy("valid_from", "version")
    ends = F.max(F.coalesce("valid_to", F.lit(2**63 - 1))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    code = F.when(F.col("valid_to") <= F.col("valid_from"), "EMPTY").when(ends > F.col("valid_from"), "OVERLAP")
    return versions.withColumn("code", code).filter("code IS NOT NULL").select(*keys, "version", "code")


def retroactive(versions: DataFrame, keys: list[str], frontier: int) -> DataFrame:
    """Versions not admitted yet (admitted is false) that would change what has been decided up to the frontier."""
    return versions.filter(~F.col("admitted") & (F.col("valid_from") <= frontier)).select(*keys, "version", F.lit("RETROACTIVE").alias("code"))


def history(versions: DataFrame, keys: list[str], previous: int, frontier: int) -> DataFrame:
    """What moving the frontier makes of each key's authority: EFFECTIVE (a version begins to hold), EXPIRED (one ends), GAP (none holds any more)."""
    old = authority(versions, keys, previous).select(*keys, F.col("version").alias("old"))
    new = authority(versions, keys, frontier).select(*keys, F.col("version").alias("new"))
    moved = old.join(new, keys, "full_outer").filter("NOT old <=> new")
    row = lambda kind, version: F.struct(F.lit(kind).alias("kind"), version.alias("version"))
    told = F.array(F.when(F.col("old").isNotNull(), row("EXPIRED", F.col("old"))), F.when(F.col("new").isNotNull(), row("EFFECTIVE", F.col("new"))), F.when(F.col("new").isNull(), row("GAP", F.col("new"))))
    return moved.select(*keys, F.explode(F.filter(told, lambda x: x.isNotNull())).alias("h")).select(*keys, "h.kind", "h.version")


def superseded(episodes: DataFrame, keys: list[str], versions: DataFrame) -> DataFrame:
    """Episodes after a switch: waiting work of versions (keys, rule_version) that hold no more is SUPERSEDED."""
    gone = versions.select(*keys, "rule_version").distinct().withColumn("gone", F.lit(True))
    waiting = F.col("state").isin("PENDING", "RETRY_WAIT") & F.col("gone").isNotNull()
    return episodes.join(gone, [*keys, "rule_version"], "left").withColumn("state", F.when(waiting, "SUPERSEDED").otherwise(F.col("state"))).drop("gone")


#: Versions of one key up to which rows meet all of their key's versions.
FEW_VERSIONS = 64


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, few: int = FEW_VERSIONS) -> DataFrame:
    """Each row with the version of its key that holds at the row's own time; rows without one, or with nulls in key or time, go.

    Versions of a key don't overlap (see rejected()). Where no key has more than `few`, an
    equi-join on the key and a range filter give the version; beyond, rows and starts of versions are sorted together.
    """
    most = versions.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    joined = rows.join(versions, keys) if most <= few else _latest_start(rows, versions, keys, at)
    return joined.filter((F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))


def _latest_start(rows: DataFrame, versions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each row with the version of its key that starts last, but not after the row's time.

    Both are cut into ranges of (key, time, row): a hot key has many of them, whatever its
    rows' times. Inside a range a window carries the last start on; what came before a
    range is the last start of the key's earlier ranges, one row each.
    """
    own, rest = [c for c in rows.columns if c not in keys], [c for c in versions.columns if c not in keys]
    starts = versions.filter("valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)").select(*keys, F.col("valid_from").alias("_time"), F.struct(*rest).alias("_version"))
    timed = rows.dropna(subset=[*keys, at]).select(*keys, F.col(at).alias("_time"), F.struct(*own).alias("_row"))
    both = starts.unionByName(timed, allowMissingColumns=True).withColumn("_order", F.when(F.col("_row").isNotNull(), F.xxhash64("_row").bitwiseAND(F.lit(2**63 - 1))).otherwise(F.lit(-1)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(both.repartitionByRange(parts, *keys, "_time", "_order").withColumn("_part", F.spark_partition_id()), "ranged")
    ends = ranged.filter("_version IS NOT NULL").groupBy(*keys, "_part").agg(F.max_by("_version", "_time").alias("_last"))
    every = ranged.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    before = every.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    inside = Window.partitionBy("_part", *keys).orderBy("_time", "_order").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.withColumn("_here", F.last("_version", ignorenulls=True).over(inside)).filter("_row IS NOT NULL").join(before, [*keys, "_part"])
    return held.withColumn("_v", F.coalesce("_here", "_before")).filter("_v IS NOT NULL").select(*keys, *(F.col("_row")[c].alias(c) for c in own), *(F.col("_v")[c].alias(c) for c in rest))


def parameters(condition: DataFrame, family: DataFrame, keys: list[str]) -> DataFrame:
    """The condition's rows with the parameters of their key; families too small to shuffle are broadcast by their size."""
    return condition.join(family, keys)


def switch(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The events of changing authority: all active keys of the old version go, all of the new come."""
    gone = old.filter("active").select(*keys, F.lit("DEACTIVATE").alias("kind"), F.lit("OLD").alias("side"))
    return gone.unionByName(new.select(*keys, F.lit("ACTIVATE").alias("kind"), F.lit("NEW").alias("side")))
