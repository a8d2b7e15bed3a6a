"""Deadlines, and conditions over time: duration, absence, cooldown and hysteresis.

A condition's state per key is one struct. The same expression makes the next state for
one pass (a full outer join with the prior state) and for a list of passes (a fold over
each key's inputs, in one shuffle). Times are microseconds; a frontier never falls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<status:string,active:boolean,at:bigint,generation:bigint>"


def advance_frontier(previous: int | None, sample: int) -> int:
    return sample if previous is None else max(previous, sample)


def due(rows: DataFrame, deadline: str, frontier: int | None) -> DataFrame:
    """Rows whose deadline is reached; equality is due, and before any frontier nothing is."""
    return rows.filter(F.lit(False) if frontier is None else F.col(deadline) <= frontier)


def crossing(rows: DataFrame, deadline: str, previous: int | None, frontier: int) -> DataFrame:
    """Rows whose deadline lies after the previous frontier and not after this one: two literal bounds, so scans prune."""
    after = F.lit(True) if previous is None else F.col(deadline) > previous
    return rows.filter(after & (F.col(deadline) <= frontier))


def _next(status: Column, active: Column, at: Column, prior: Column) -> Column:
    """The state struct; the generation rises when the condition becomes active."""
    was = F.coalesce(prior["active"], F.lit(False))
    generation = F.coalesce(prior["generation"], F.lit(0).cast("bigint")) + F.when(active & ~was, 1).otherwise(0)
    return F.struct(status.alias("status"), active.alias("active"), at.cast("bigint").alias("at"), generation.cast("bigint").alias("generation")).cast(STATE)


def duration(micros: int) -> Callable[[Column, Column, Column], Column]:
    """True for so long, from the first frontier that sees it true; `at` is when it is due."""

    def step(prior: Column, given: Column, frontier: Column) -> Column:
        true = F.coalesce(given["truth"], F.lit(False))
        at = F.when(true, F.coalesce(prior["at"], frontier + micros))
        active = F.coalesce(true & (at <= frontier), F.lit(False))
        return _next(F.when(active, "ACTIVE").when(true, "PENDING").otherwise("WAITING"), active, at, prior)

    return step


def absence() -> Callable[[Column, Column, Column], Column]:
    """Not seen again by the deadline that the last sight set; `at` is that deadline."""

    def step(prior: Column, given: Column, frontier: Column) -> Column:
        true = F.coalesce(given["truth"], F.lit(False))
        at = F.when(true, given["deadline"]).otherwise(prior["at"])
        active = F.coalesce(~true & (at <= frontier), F.lit(False))
        status = F.when(true | at.isNull(), "WAITING").when(active, "ACTIVE").otherwise("PENDING")
        return _next(status, active, at, prior)

    return step


def cooldown(micros: int) -> Callable[[Column, Column, Column], Column]:
    """True again only after a pause since it last stopped; `at` is the pause's end, null once it is over."""

    def step(prior: Column, given: Column, frontier: Column) -> Column:
        true, was = F.coalesce(given["truth"], F.lit(False)), F.coalesce(prior["active"], F.lit(False))
        blocked = F.coalesce(prior["at"] > frontier, F.lit(False))
        active = true & (was | ~blocked)
        at = F.when(~true & was, frontier + micros).when(blocked & ~was, prior["at"])
        cooling = at.isNotNull()
        return _next(F.when(active, "ACTIVE").when(cooling, "COOLDOWN").otherwise("WAITING"), active, at, prior)

    return step


def hysteresis() -> Callable[[Column, Column, Column], Column]:
    """Entered by one input and left by another; entering wins while it is inactive."""

    def step(prior: Column, given: Column, frontier: Column) -> Column:
        enter, leave = F.coalesce(given["truth"], F.lit(False)), F.coalesce(given["recovered"], F.lit(False))
        was = F.coalesce(prior["active"], F.lit(False))
        status = F.when(was & leave, "RECOVERED").when(was | enter, "ACTIVE").when(leave, "RECOVERED").otherwise("ARMED")
        return _next(status, status == "ACTIVE", F.lit(None).cast("bigint"), prior)

    return step


def advance(state: DataFrame, inputs: DataFrame, keys: list[str], frontier: int, step: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """One pass: keys, state, and the event (ACTIVATE, DEACTIVATE or null).

    state has keys and a struct `state`; inputs has keys, truth and what the step needs.
    """
    given = inputs.select(*keys, F.struct(*(c for c in inputs.columns if c not in keys)).alias("given"))
    both = state.select(*keys, F.col("state").alias("prior")).join(given, keys, "full_outer")
    moved = both.withColumn("state", step(F.col("prior"), F.col("given"), F.lit(frontier).cast("bigint")))
    return moved.select(*keys, "state", _event(F.col("prior.active"), F.col("state.active")).alias("event"))


def over_limit(keys: DataFrame, most: int = 100_000) -> DataFrame:
    """One row TEMPORAL_LIMIT with the number of keys, if a pass would hold more than it may."""
    return keys.distinct().agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.lit("TEMPORAL_LIMIT").alias("code"), "n")


def deadline_events(rows: DataFrame, keys: list[str], deadline: str, previous: int | None, frontier: int) -> DataFrame:
    """Lifecycle rows of deadlines that the frontier has reached: keys, ACTIVATE, the declared deadline and the frontier that saw it."""
    return crossing(rows, deadline, previous, frontier).select(*keys, F.lit("ACTIVATE").alias("kind"), F.col(deadline).alias("declared_deadline"), F.lit(frontier).cast("bigint").alias("observed_frontier"))


def deadline_findings(rows: DataFrame, deadline: str) -> DataFrame:
    """Why a column can't be a deadline: DEADLINE_TYPE, or DEADLINE_NULL with the number of rows."""
    kind = rows.schema[deadline].dataType.simpleString()
    if kind not in ("bigint", "timestamp", "timestamp_ntz"):
        return rows.sparkSession.range(1).select(F.lit("DEADLINE_TYPE").alias("code"), F.col("id").alias("n"))
    return rows.agg(F.count_if(F.col(deadline).isNull()).alias("n")).filter("n > 0").select(F.lit("DEADLINE_NULL").alias("code"), "n")


def _event(was: Column, now: Column) -> Column:
    was = F.coalesce(was, F.lit(False))
    return F.when(now & ~was, "ACTIVATE").when(was & ~now, "DEACTIVATE")


def replay(inputs: DataFrame, keys: list[str], frontier: str, frontiers: list[int], step: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """All passes over the listed frontiers: keys, frontier, status, active, at, generation, event.

    inputs has keys, the frontier at which they hold, truth and what the step needs; a
    frontier without a row is false there, and of several rows the greatest values hold
    (true before false). One grouping by key: its list has a row for
    each frontier at most. Keys have states from the first frontier on.
    """
    rest = [c for c in inputs.columns if c not in (*keys, frontier)]
    single = inputs.filter(F.col(frontier).isin(frontiers)).groupBy(*keys, frontier).agg(*(F.max(c).alias(c) for c in rest))
    listed = single.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(frontier), F.struct(*rest)))).alias("by"))
    passes = F.array(*(F.lit(f).cast("bigint") for f in sorted(frontiers)))
    out = f"array<struct<frontier:bigint,state:{STATE},event:string>>"

    def fold(done: Column, at: Column) -> Column:
        prior = F.try_element_at(done, F.lit(-1))["state"]
        state = step(prior, F.try_element_at(F.col("by"), at), at)
        return F.array_append(done, F.struct(at.alias("frontier"), state.alias("state"), _event(prior["active"], state["active"]).alias("event")).cast(out[6:-1]))

    return listed.select(*keys, F.explode(F.aggregate(passes, F.array().cast(out), fold)).alias("x")).select(*keys, F.col("x.frontier").alias(frontier), "x.state.*", "x.event")
