"""The lifecycle state machine: from prior state and current matches to events and new state.

Both sides are compared once, as whole sets, so whatever happened in between cancels out.
A key that appears is an ACTIVATE of its next generation, one that goes a DEACTIVATE, and
one whose watched columns differ a CHANGE of its next revision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = ["active", "generation", "revision", "bindings"]


class KeyViolation(ValueError):
    """A condition's key is null or not unique."""


def check_keys(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Findings about a condition's key: KEY_NULL and KEY_DUPLICATE with their row counts."""
    null = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    nulls = matches.filter(null).agg(F.count(F.lit(1)).alias("n")).select(F.lit("KEY_NULL").alias("code"), "n")
    twice = matches.filter(~null).groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("KEY_DUPLICATE").alias("code"), "n")
    return nulls.union(twice).filter("n > 0")


def require_keys(matches: DataFrame, keys: list[str]) -> None:
    found = check_keys(matches, keys).collect()  # two rows at most
    if found:
        raise KeyViolation(", ".join(f"{r['code']}: {r['n']}" for r in found))


def bindings_of(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the other columns as one struct."""
    rest = [c for c in matches.columns if c not in keys]
    return matches.select(*keys, (F.struct(*rest) if rest else F.struct(F.lit(True).alias("present"))).alias("bindings"))


def seed(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The state of a new rule over current matches: active, generation 1, and no events."""
    return bindings_of(matches, keys).select(*keys, F.lit(True).alias("active"), F.lit(1).cast("bigint").alias("generation"), F.lit(0).cast("bigint").alias("revision"), "bindings")


def advance(state: DataFrame, matches: DataFrame, keys: list[str], watched: list[str] | None = None) -> DataFrame:
    """One row for every key in state or matches, with its event, if any, and its next state.

    state has the keys and active, generation, revision, bindings; matches has the keys and
    further columns. watched: columns whose difference is a CHANGE; all but the keys unless given, and
    none for an empty list. Values are compared null-safely; bindings follow every match.
    Columns: keys, kind (null: no event), event_revision, active, generation, revision,
    bindings, previous. Keys must be unique and not null (see require_keys).
    """
    now = bindings_of(matches, keys).withColumnRenamed("bindings", "new").withColumn("present", F.lit(True))
    both = state.withColumnRenamed("bindings", "old").join(now, keys, "full_outer")
    was, here = F.coalesce("active", F.lit(False)), F.coalesce("present", F.lit(False))
    names = [c for c in matches.columns if c not in keys] if watched is None else watched
    differs = reduce(Column.__or__, (~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in names), F.lit(False))
    kind = F.when(here & ~was, "ACTIVATE").when(was & ~here, "DEACTIVATE").when(here & was & differs, "CHANGE")
    generation = F.coalesce("generation", F.lit(0).cast("bigint")) + F.when(kind == "ACTIVATE", 1).otherwise(0)
    revision = F.when(kind == "ACTIVATE", 0).when(kind == "CHANGE", F.col("revision") + 1).otherwise(F.coalesce("revision", F.lit(0)))
    return both.select(
        *keys,
        kind.alias("kind"),
        F.when(kind == "DEACTIVATE", 0).when(kind.isNotNull(), revision).cast("bigint").alias("event_revision"),
        here.alias("active"),
        generation.cast("bigint").alias("generation"),
        revision.cast("bigint").alias("revision"),
        F.when(here, F.col("new")).otherwise(F.col("old")).alias("bindings"),
        F.when(was, F.col("old")).alias("previous"),
    )


def events(advanced: DataFrame, keys: list[str]) -> DataFrame:
    return advanced.filter("kind IS NOT NULL").select(*keys, "kind", "generation", F.col("event_revision").alias("revision"), "bindings", "previous")


def next_state(advanced: DataFrame, keys: list[str]) -> DataFrame:
    return advanced.select(*keys, *STATE)


def unseen(new: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Events that the ledger does not have, so that a repeated pass adds nothing."""
    return new.join(ledger, [*keys, "generation", "kind", "revision"], "left_anti")


def withdrawn(agenda: DataFrame, emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Pending ACTIVATE work whose generation has been deactivated."""
    gone = emitted.filter("kind = 'DEACTIVATE'").select(*keys, "generation")
    return agenda.filter("kind = 'ACTIVATE' AND state IN ('PENDING', 'RETRY_WAIT')").join(gone, [*keys, "generation"], "left_semi")


def epochs(presence: DataFrame, keys: list[str], epoch: str, first: int, last: int) -> DataFrame:
    """The events that `last - first + 1` successive passes give, without running each.

    presence has the keys and the number of every pass that sees them. A run of
    consecutive passes is a generation: it activates at its first and deactivates after
    its last, if a pass is left. One shuffle by key, whatever the number of passes.
    """
    at = Window.partitionBy(*keys).orderBy(epoch)
    seen = presence.filter(F.col(epoch).between(first, last)).select(*keys, epoch).distinct()
    begins = seen.withColumn("begins", (F.col(epoch) - F.coalesce(F.lag(epoch).over(at), F.lit(first - 2)) > 1).cast("int"))
    runs = begins.withColumn("generation", F.sum("begins").over(at)).groupBy(*keys, "generation").agg(F.min(epoch).alias("a"), F.max(epoch).alias("b"))
    edges = F.array(F.struct(F.col("a").alias(epoch), F.lit("ACTIVATE").alias("kind")), F.struct((F.col("b") + 1).alias(epoch), F.lit("DEACTIVATE").alias("kind")))
    return runs.select(*keys, "generation", F.explode(edges).alias("e")).select(*keys, "generation", f"e.{epoch}", "e.kind").filter(F.col(epoch) <= last)
