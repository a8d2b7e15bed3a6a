"""Event-time tumbling windows: staging, corrections, finalization and the late-input barrier.

A pass compares the staged rows with those of the pass before, as multisets, and looks only
at windows that differ. A window whose lateness boundary the complete watermark has passed
is final; rows that would change it are late, and hold the program up instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.times import bound, epoch_micros, ordinal


def stage(rows: DataFrame, groups: list[str], event_time: str, width: int, values: list[str]) -> DataFrame:
    """Rows as a multiset: groups, event time, window, values and occurrences."""
    us = epoch_micros(F.col(event_time))
    return rows.select(*groups, us.alias("at"), ordinal(us, width).alias("window"), *values).groupBy(*groups, "at", "window", *values).agg(F.count(F.lit(1)).alias("occurrences"))


def affected(before: DataFrame, after: DataFrame, groups: list[str]) -> DataFrame:
    """Groups and windows whose staged rows differ."""
    same = [c for c in after.columns if c != "occurrences"]
    signed = after.select(*same, "occurrences").unionByName(before.select(*same, (-F.col("occurrences")).alias("occurrences")))
    # A difference of multisets as one grouping: no null-safe full join on every column.
    return signed.groupBy(*same).agg(F.sum("occurrences").alias("d")).filter("d <> 0").select(*groups, "window").distinct()


def late(changed: DataFrame, width: int, lateness: int, complete: int | None) -> DataFrame:
    """Changed windows that are final already; if there are any the pass must change nothing."""
    return changed.filter(F.lit(False) if complete is None else bound(F.col("window") + 1, width) + lateness <= complete)


def measure(staged: DataFrame, groups: list[str], fn: str, value: str | None = None) -> DataFrame:
    """The windows' aggregate: count_star, count, sum, min or max."""
    n, v = F.col("occurrences"), F.col(value) if value else None
    made = {"count_star": lambda: F.sum(n), "count": lambda: F.sum(F.when(v.isNotNull(), n).otherwise(0)), "sum": lambda: F.sum(v * n), "min": lambda: F.min(v), "max": lambda: F.max(v)}[fn]()
    return staged.groupBy(*groups, "window").agg(made.alias("value"))


def corrections(before: DataFrame, after: DataFrame, changed: DataFrame, groups: list[str], truth) -> DataFrame:  # noqa: ANN001
    """One row for each changed window: value and truth before and after, and the event if the truth flips.

    before and after are measure()s; truth makes a boolean column of a value.
    """
    keys = [*groups, "window"]
    both = changed.join(before.withColumnRenamed("value", "before"), keys, "left").join(after.withColumnRenamed("value", "after"), keys, "left")
    was, now = F.coalesce(truth(F.col("before")), F.lit(False)), F.coalesce(truth(F.col("after")), F.lit(False))
    event: Column = F.when(now & ~was, "ACTIVATE").when(was & ~now, "DEACTIVATE")
    return both.select(*keys, "before", "after", was.alias("was_true"), now.alias("is_true"), event.alias("event"))


def finalizations(windows: DataFrame, width: int, lateness: int, complete: int | None, requested: int) -> DataFrame:
    """Windows whose boundary lies after the complete watermark and not after the requested one.

    All boundaries up to the request are one job; the ledger's rows are those of single steps.
    """
    if complete is not None and requested < complete:
        raise ValueError("a watermark never falls")
    edge = bound(F.col("window") + 1, width) + lateness
    after = F.lit(True) if complete is None else edge > complete
    return windows.withColumn("boundary", edge).filter(after & (F.col("boundary") <= requested))


def admit(changed: DataFrame, width: int, lateness: int, complete: int | None) -> DataFrame:
    """One row about a pass: BARRIER if any changed window is final, else ADVANCED, with how many windows changed and how many are late."""
    final = F.lit(False) if complete is None else bound(F.col("window") + 1, width) + lateness <= complete
    seen = changed.agg(F.count(F.lit(1)).alias("affected"), F.count_if(final).alias("late"))
    return seen.select(F.when(F.col("late") > 0, "BARRIER").otherwise("ADVANCED").alias("state"), "affected", "late")


def identified(corrected: DataFrame, history: DataFrame, groups: list[str], program: str, frontier: int) -> DataFrame:
    """corrections() with the support's generation after them, the frontier and an identity: program/key/window/F<frontier>.

    history has earlier corrections; a window's generation rises with every ACTIVATE.
    """
    keys = [*groups, "window"]
    old = history.groupBy(*keys).agg(F.max("support_generation").alias("old"))
    generation = F.coalesce("old", F.lit(0).cast("bigint")) + F.when(F.col("event") == "ACTIVATE", 1).otherwise(0)
    identity = F.concat_ws("/", F.lit(program), *(F.col(k).cast("string") for k in keys), F.lit(f"F{frontier}"))
    return corrected.join(old, keys, "left").select(*corrected.columns, generation.cast("bigint").alias("support_generation"), F.lit(frontier).cast("bigint").alias("frontier"), identity.alias("identity"))


def ledger(final: DataFrame, groups: list[str], known: DataFrame) -> DataFrame:
    """Finalizations with their identity, key@boundary, that the ledger does not have: a window is finalized once."""
    named = final.withColumn("identity", F.concat(F.concat_ws("/", *(F.col(g).cast("string") for g in groups)), F.lit("@"), F.col("boundary").cast("string")))
    return named.join(known.select("identity"), "identity", "left_anti")


def prune(history: DataFrame, keys: list[str], final: DataFrame, cutoff: int) -> DataFrame:
    """Corrections that may go: superseded ones, of final windows, from before the cutoff."""
    newest = history.groupBy(*keys).agg(F.max("frontier").alias("newest"))
    return history.join(newest, keys).filter((F.col("frontier") < F.col("newest")) & (F.col("frontier") < cutoff)).join(final, keys, "left_semi").drop("newest")
