"""Analysis of a decision before it is deployed: gaps, overlaps, ties and shifts of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.decisions import winners


def uncovered(population: DataFrame, candidates: DataFrame) -> DataFrame:
    """Subjects of the population without a candidate."""
    return population.select("subject").distinct().join(candidates, "subject", "left_anti")


def unreachable(catalog: DataFrame, candidates: DataFrame) -> DataFrame:
    """Catalog candidates that no subject has."""
    return catalog.select("candidate").distinct().join(candidates, "candidate", "left_anti")


def overlaps(candidates: DataFrame) -> DataFrame:
    """Subjects with more than one candidate, where one is all they may have."""
    return candidates.groupBy("subject").agg(F.count(F.lit(1)).alias("candidates")).filter("candidates > 1")


def ties(candidates: DataFrame) -> DataFrame:
    """Subjects whose least priority several candidates share, with how many."""
    per = candidates.groupBy("subject", "priority").agg(F.count(F.lit(1)).alias("tied"))
    best = per.groupBy("subject").agg(F.min(F.struct("priority", "tied")).alias("b"))
    return best.select("subject", F.col("b.priority").alias("priority"), F.col("b.tied").alias("tied")).filter("tied > 1")


def missing_default(catalog: DataFrame) -> DataFrame:
    """One row MISSING_REQUIRED_DEFAULT if no catalog row is marked as the default."""
    return catalog.agg(F.coalesce(F.count_if(F.col("required_default")), F.lit(0)).alias("defaults")).filter("defaults = 0").select(F.lit("MISSING_REQUIRED_DEFAULT").alias("code"))


def distribution(current: DataFrame, proposed: DataFrame, catalog: DataFrame, absolute: int, relative: float | None = None) -> DataFrame:
    """Every candidate's winners now and as proposed, the signed delta, and whether it breaches a limit.

    current and proposed are candidate rows (subject, candidate, priority); candidates are
    those of the catalog and of both. A delta beyond `absolute` either way is a breach, and
    with a relative limit so is one beyond that share of the winners now, or any winner of
    a candidate that has none now.
    """
    won = lambda rows, sign: winners(rows).filter("state = 'WINNER'").select("candidate", F.lit(sign).alias("side"))
    keys = catalog.select("candidate").union(current.select("candidate")).union(proposed.select("candidate")).distinct()
    sides = won(current, "current").union(won(proposed, "proposed")).groupBy("candidate").agg(*(F.count_if(F.col("side") == n).alias(n) for n in ("current", "proposed")))
    both = keys.join(sides, "candidate", "left").na.fill(0, ["current", "proposed"]).withColumn("delta", F.col("proposed") - F.col("current"))
    beyond = F.abs("delta") > absolute
    if relative is not None:
        beyond = beyond | F.when(F.col("current") == 0, F.col("proposed") > 0).otherwise(F.abs("delta") / F.col("current") > relative)
    return both.withColumn("breach", beyond)


def report(findings: dict[str, DataFrame]) -> DataFrame:
    """Findings counted by code, and PASS or BLOCKED for each."""
    rows = None
    for code, found in findings.items():
        one = found.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(code).alias("code"), "findings")
        rows = one if rows is None else rows.union(one)
    return rows.withColumn("state", F.when(F.col("findings") > 0, "BLOCKED").otherwise("PASS"))
