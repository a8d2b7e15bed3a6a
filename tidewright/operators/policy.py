"""Policy sets: rules and decisions gated by who is eligible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligibility_findings(gate: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """Why a gate can't be used: NULL_SUBJECT, DUPLICATE_SUBJECT or OVER_LIMIT, with counts; one pass by key."""
    null: Column = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    per = gate.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seen = per.agg(F.sum(F.when(null, F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(~null & (F.col("n") > 1), 1).otherwise(0)).alias("twice"), F.sum("n").alias("all"))
    finding = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n"))
    rows = F.array(finding("NULL_SUBJECT", F.col("nulls")), finding("DUPLICATE_SUBJECT", F.col("twice")), finding("OVER_LIMIT", F.col("all") - most))
    return seen.select(F.explode(rows).alias("f")).select("f.code", "f.n").filter("n > 0")


def scoped(matches: DataFrame, gates: dict[str, DataFrame], subject: list[str]) -> DataFrame:
    """Matches whose subject has the support of at least one set, with supports: how many."""
    rows = None
    for name, gate in gates.items():
        one = gate.select(*subject).distinct().withColumn("policy_set", F.lit(name))
        rows = one if rows is None else rows.union(one)
    return matches.join(rows.groupBy(*subject).agg(F.count(F.lit(1)).alias("supports")), subject)


def transitions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """ADDED and REMOVED supports between two passes."""
    old, new = before.select(*keys).distinct().withColumn("o", F.lit(True)), after.select(*keys).distinct().withColumn("n", F.lit(True))
    return old.join(new, keys, "full_outer").filter("o IS NULL OR n IS NULL").select(*keys, F.when(F.col("o").isNull(), "ADDED").otherwise("REMOVED").alias("change"))


def claimable(winners: DataFrame, gate: DataFrame, subject: list[str]) -> DataFrame:
    """Decided outcomes, all of them, with claimable: a winner whose subject is eligible."""
    eligible = gate.select(*subject).distinct().withColumn("eligible", F.lit(True))
    return winners.join(eligible, subject, "left").withColumn("claimable", (F.col("state") == "WINNER") & F.coalesce("eligible", F.lit(False))).drop("eligible")


def upsert_supports(supports: DataFrame, matches: DataFrame, keys: list[str], subject: list[str], gate: DataFrame) -> DataFrame:
    """Scope supports after a pass: keys, subject, active, support_generation and the change (ADDED, REMOVED or null).

    A support that comes, comes back, or changes its subject is of the next generation.
    """
    now = matches.join(gate.select(*subject).distinct(), subject, "left_semi").select(*keys, F.struct(*subject).alias("new"))
    both = supports.select(*keys, F.col("subject").alias("old"), F.col("active").alias("was"), "support_generation").join(now, keys, "full_outer")
    was, here = F.coalesce("was", F.lit(False)), F.col("new").isNotNull()
    fresh = here & (~was | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(
        *keys,
        F.coalesce("new", "old").alias("subject"),
        here.alias("active"),
        (F.coalesce("support_generation", F.lit(0).cast("bigint")) + fresh.cast("int")).alias("support_generation"),
        F.when(here & ~was, "ADDED").when(was & ~here, "REMOVED").alias("change"),
    )


#: How many members a policy set has, how much evidence an answer may ask for, and what members are.
MEMBERS, EVIDENCE, KINDS = 64, 1_000, ("RULE", "DECISION")


def declaration_findings(members: DataFrame, evidence: int) -> DataFrame:
    """Why a policy set (kind, name, version) can't be declared: codes with counts."""
    seen = members.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kind").isin(*KINDS)).alias("kinds"), (F.count(F.lit(1)) - F.count_distinct("kind", "name")).alias("twice"))
    finding = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n"))
    rows = F.array(
        finding("MEMBERS_EMPTY", F.when(F.col("n") == 0, 1).otherwise(0)), finding("MEMBERS_OVER_LIMIT", F.col("n") - MEMBERS), finding("MEMBER_KIND", F.col("kinds")), finding("MEMBER_DUPLICATE", F.col("twice")), finding("EVIDENCE_LIMIT", F.lit(0 if 1 <= evidence <= EVIDENCE else 1))
    )
    return seen.select(F.explode(rows).alias("f")).select("f.code", "f.n").filter("n > 0")


def effective(supports: DataFrame, frontier: int, barriers: DataFrame) -> DataFrame:
    """Supports that count at the frontier: active, within their half-open interval, of a set without a barrier (policy_set)."""
    inside = (F.col("valid_from") <= frontier) & (F.col("valid_to").isNull() | (F.col("valid_to") > frontier))
    return supports.filter(F.col("active") & inside).join(barriers.select("policy_set").distinct(), "policy_set", "left_anti")


def expired(supports: DataFrame, previous: int, frontier: int) -> DataFrame:
    """Active supports whose interval ended after the previous frontier and not after this one. The frontier never falls."""
    if frontier < previous:
        raise ValueError("a frontier never falls")
    return supports.filter(F.col("active") & (F.col("valid_to") > previous) & (F.col("valid_to") <= frontier))


def blocked(prior: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """Supports after a refresh in which sets have failed (policy_set): theirs stay as they were, state BLOCKED; the others' are the fresh ones, REFRESHED."""
    bad = failed.select("policy_set").distinct()
    return prior.join(bad, "policy_set", "left_semi").withColumn("state", F.lit("BLOCKED")).unionByName(fresh.join(bad, "policy_set", "left_anti").withColumn("state", F.lit("REFRESHED")))
