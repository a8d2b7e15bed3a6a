"""Decision tables: per subject the candidate with the least priority, ties told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMPETITORS = 25


def winners(candidates: DataFrame, subjects: DataFrame | None = None, results: list[str] | None = None) -> DataFrame:
    """One row a subject: state, candidate, priority, at_best and the result columns.

    candidates has subject, candidate, priority and results. WINNER: one candidate has the
    least priority; AMBIGUOUS: several, and none is chosen; NO_CANDIDATE: a subject of
    `subjects` that has none. Three partial aggregates, no window: a hot subject combines
    before the shuffle.
    """
    results = results or []
    best = F.struct("priority", "candidate", *results)
    grouped = candidates.groupBy("subject").agg(F.min(best).alias("b"), F.max(F.struct((-F.col("priority")).alias("p"), F.col("candidate").alias("c"))).alias("w"))
    # The least and the greatest candidate at the least priority are the same iff it is alone.
    one = F.col("b.candidate") == F.col("w.c")
    decided = grouped.select(
        "subject",
        F.when(one, "WINNER").otherwise("AMBIGUOUS").alias("state"),
        F.when(one, F.col("b.candidate")).alias("candidate"),
        F.col("b.priority").alias("priority"),
        *(F.when(one, F.col(f"b.{r}")).alias(r) for r in results),
    )
    if subjects is None:
        return decided
    return subjects.select("subject").distinct().join(decided, "subject", "left").withColumn("state", F.coalesce("state", F.lit("NO_CANDIDATE")))


def competitors(candidates: DataFrame, most: int = COMPETITORS) -> DataFrame:
    """The first `most` candidates of every subject by priority, with their rank and whether more exist."""
    order = Window.partitionBy("subject").orderBy("priority", "candidate")
    counts = candidates.groupBy("subject").agg((F.count(F.lit(1)) > most).alias("truncated"))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).join(counts, "subject")


def gap(previous: DataFrame, results: list[str] | None = None) -> DataFrame:
    """The events of a time without an effective version: every winner goes, every ambiguity ends, all are without a candidate."""
    return lifecycle(previous, previous.filter("false"), results)


def rows_model(candidates: DataFrame, subjects: DataFrame, most: int = COMPETITORS, results: list[str] | None = None) -> DataFrame:
    """One row a subject for comparisons: state, candidate, priority, results, its first competitors and whether there are more."""
    listed = competitors(candidates, most).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "priority"))).alias("c"), F.first("truncated").alias("truncated"))  # `most` at most
    named = listed.select("subject", F.expr("array_join(transform(c, x -> concat(x.candidate, ':', x.priority)), ',')").alias("competitors"), "truncated")
    return winners(candidates, subjects, results).join(named, "subject", "left").na.fill({"competitors": "", "truncated": False})


def violations(candidates: DataFrame) -> DataFrame:
    """Rows that a decision can't take: null fields and repeated (subject, candidate)."""
    null = candidates.filter("subject IS NULL OR candidate IS NULL OR priority IS NULL").select(F.lit("NULL_FIELD").alias("code"), "subject", "candidate")
    twice = candidates.groupBy("subject", "candidate").count().filter("count > 1 AND subject IS NOT NULL AND candidate IS NOT NULL")
    return null.union(twice.select(F.lit("DUPLICATE_CANDIDATE").alias("code"), "subject", "candidate"))


def lifecycle(previous: DataFrame, current: DataFrame, results: list[str] | None = None) -> DataFrame:
    """Events between two outcomes, numbered in the order in which they happen for a subject.

    previous has subject, state, candidate, results, generation and revision; current the first of these.
    A winner that goes is WINNER_OUT, an ambiguity that ends AMBIGUITY_EXIT; then come AMBIGUITY_ENTER,
    WINNER_IN (generation + 1, revision 0) or WINNER_REVISION (revision + 1), and NO_CANDIDATE.
    """
    results = results or []
    old = previous.select("subject", F.col("state").alias("s0"), F.col("candidate").alias("c0"), F.struct(F.lit(0), *results).alias("r0"), "generation", "revision")
    new = current.select("subject", F.col("state").alias("s1"), F.col("candidate").alias("c1"), F.struct(F.lit(0), *results).alias("r1"))
    both = old.join(new, "subject", "full_outer").na.fill("NO_CANDIDATE", ["s0", "s1"]).na.fill(0, ["generation", "revision"])
    same = (F.col("s0") == "WINNER") & (F.col("s1") == "WINNER") & (F.col("c0") == F.col("c1"))
    event = lambda cond, kind, candidate, generation, revision: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.col(candidate).alias("candidate"), generation.cast("bigint").alias("generation"), revision.cast("bigint").alias("revision")))
    g, r, none = F.col("generation"), F.col("revision"), F.lit(0)
    listed = F.array(
        event((F.col("s0") == "WINNER") & ~F.coalesce(same, F.lit(False)), "WINNER_OUT", "c0", g, r),
        event((F.col("s0") == "AMBIGUOUS") & (F.col("s1") != "AMBIGUOUS"), "AMBIGUITY_EXIT", "c0", g, r),
        event((F.col("s1") == "AMBIGUOUS") & (F.col("s0") != "AMBIGUOUS"), "AMBIGUITY_ENTER", "c1", g, r),
        event((F.col("s1") == "WINNER") & ~F.coalesce(same, F.lit(False)), "WINNER_IN", "c1", g + 1, none),
        event(same & ~F.col("r0").eqNullSafe(F.col("r1")), "WINNER_REVISION", "c1", g, r + 1),
        event((F.col("s1") == "NO_CANDIDATE") & (F.col("s0") != "NO_CANDIDATE"), "NO_CANDIDATE", "c1", g, r),
    )
    return both.select("subject", F.posexplode(F.filter(listed, lambda e: e.isNotNull())).alias("step", "e")).select("subject", "step", "e.*")


#: Types that results may have, besides decimals.
RESULT_TYPES = ("boolean", "smallint", "int", "bigint", "string", "date", "timestamp", "timestamp_ntz")


def typing(schema: StructType, results: list[str]) -> list[tuple[str, str]]:
    """(code, column) of what a candidate table's schema lacks; nulls are found in the rows, by violations().

    CANDIDATE_COLUMN and RESULT_COLUMN: no such column; IDENTITY_TYPE and PRIORITY_TYPE: subject
    and candidate, or priority, are not bigint; RESULT_TYPE: not a plain scalar.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    out = []
    for name in ("subject", "candidate", "priority"):
        if name not in kinds:
            out.append(("CANDIDATE_COLUMN", name))
        elif kinds[name] != "bigint":
            out.append(("PRIORITY_TYPE" if name == "priority" else "IDENTITY_TYPE", name))
    for name in results:
        if name not in kinds:
            out.append(("RESULT_COLUMN", name))
        elif kinds[name] not in RESULT_TYPES and not kinds[name].startswith(("decimal(", "varchar(")):
            out.append(("RESULT_TYPE", name))
    return out
