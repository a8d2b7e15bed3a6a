"""Findings about a running rule base, as one relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(episodes: DataFrame, barriers: DataFrame, now: int, most_pending: int) -> DataFrame:
    """BARRIER, FAILED_EPISODE, STALE_LEASE and AGENDA_BACKLOG (work not done, from four fifths of the limit), by rule."""
    one = lambda df, code: df.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "rule", "n")
    backlog = one(episodes.filter("state IN ('PENDING', 'RETRY_WAIT', 'LEASED')"), "AGENDA_BACKLOG").filter(F.col("n") * 5 >= most_pending * 4)
    return (
        one(barriers, "BARRIER")
        .unionByName(one(episodes.filter("state = 'FAILED'"), "FAILED_EPISODE"))
        .unionByName(one(episodes.filter((F.col("state") == "LEASED") & (F.col("lease_until") <= now)), "STALE_LEASE"))
        .unionByName(backlog)
    )


def derived_findings(stored: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """DERIVED_FACT_INVALID and DERIVED_FACT_MISSING with the facts that only one side has, counted by relation."""
    one = lambda a, b, code: a.join(b.select("relation", *keys), ["relation", *keys], "left_anti").groupBy(F.col("relation").alias("rule")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "rule", "n")
    return one(stored, expected, "DERIVED_FACT_INVALID").unionByName(one(expected, stored, "DERIVED_FACT_MISSING"))


def drift(known: DataFrame, present: DataFrame, code: str = "SOURCE_DRIFT") -> DataFrame:
    """Sources (rule, fingerprint) that are no longer what a deployment saw, with 1 for each."""
    now = present.select("rule", F.col("fingerprint").alias("now"))
    return known.join(now, "rule", "left").filter("NOT fingerprint <=> now").select(F.lit(code).alias("code"), "rule", F.lit(1).cast("bigint").alias("n"))


def metrics(episodes: DataFrame, now: int) -> DataFrame:
    """One row a rule: episodes by state, expired leases, and the age in seconds of the oldest one that is due (0 without any)."""
    state = F.col("state")
    due = state.isin("PENDING", "RETRY_WAIT") & (F.col("available_at") <= now)
    return episodes.groupBy("rule").agg(
        *(F.count_if(state == s).alias(s.lower()) for s in ("PENDING", "RETRY_WAIT", "LEASED", "DONE", "FAILED")),
        F.count_if((state == "LEASED") & (F.col("lease_until") <= now)).alias("expired_leases"),
        F.coalesce((F.lit(now) - F.min(F.when(due, F.col("available_at")))) / 1_000_000, F.lit(0.0)).alias("oldest_due_seconds"),
    )


#: What findings of a code say: severity, whether they stop claims, message and hint. Others are warnings.
MEANING = {
    "BARRIER": ("ERROR", True, "claims are blocked", "repair the condition and run the rule again"),
    "FAILED_EPISODE": ("ERROR", False, "work failed for good", "look at the episode, then repeat or cancel it"),
    "STALE_LEASE": ("WARNING", False, "a lease has expired", "sweep the rule's leases"),
    "AGENDA_BACKLOG": ("WARNING", False, "work not done nears the limit", "do or cancel work, or raise the limit"),
    "DERIVED_FACT_INVALID": ("ERROR", False, "a stored fact has no such support", "rebuild the relation"),
    "DERIVED_FACT_MISSING": ("ERROR", False, "a supported fact is not stored", "rebuild the relation"),
    "SOURCE_DRIFT": ("WARNING", False, "the source is not the one deployed", "replace the rule to adopt it"),
}


def shaped(found: DataFrame, field: str | None = None) -> DataFrame:
    """Findings (code, rule, n) in the shape that all checks share: code, severity, blocking, target, field, message, hint, details (JSON)."""
    told = lambda k, other: F.coalesce(*(F.when(F.col("code") == c, F.lit(m[k])) for c, m in MEANING.items()), F.lit(other))
    return found.select(
        "code", told(0, "WARNING").alias("severity"), told(1, False).alias("blocking"), F.col("rule").cast("string").alias("target"), F.lit(field).cast("string").alias("field"),
        told(2, "").alias("message"), told(3, "").alias("hint"), F.to_json(F.struct("n")).alias("details"),
    )
