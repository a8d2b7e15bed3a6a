"""Work from events: the order in which it is claimed, what may be claimed, and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.times import SECOND

FAIRNESS = 30 * SECOND
CLAIMABLE = ("PENDING", "RETRY_WAIT")


def claim_order(now: int) -> list[Column]:
    """Work that waits beyond the fairness window, then the earliest, the most salient, the oldest."""
    return [F.when(F.col("available_at") <= now - FAIRNESS, 0).otherwise(1), F.col("available_at"), F.col("salience").desc(), F.col("episode_id")]


def claimable(episodes: DataFrame, now: int) -> DataFrame:
    """Due work, one episode of each conflict key, and none whose conflict key is leased."""
    due = episodes.filter(F.col("state").isin(*CLAIMABLE) & (F.col("available_at") <= now))
    leased = episodes.filter((F.col("state") == "LEASED") & (F.col("lease_until") > now) & F.col("conflict_key").isNotNull()).select("conflict_key").distinct()
    free = due.join(leased, "conflict_key", "left_anti")
    # The first of each conflict key by partial aggregation: a key with a third of all work
    # is one row a task, where a window would sort it in one.
    rank = F.struct(*(c.alias(f"o{k}") for k, c in enumerate([F.when(F.col("available_at") <= now - FAIRNESS, 0).otherwise(1), F.col("available_at"), -F.col("salience"), F.col("episode_id")])))
    alone = free.filter("conflict_key IS NULL")
    firsts = free.filter("conflict_key IS NOT NULL").groupBy("conflict_key").agg(F.min(rank).alias("o")).select(F.col("o.o3").alias("episode_id"))
    return alone.unionByName(free.join(firsts, "episode_id", "left_semi"))


def claim(episodes: DataFrame, now: int, limit: int) -> DataFrame:
    """The next `limit` episodes to work on (a top-k; limit is the feature)."""
    return claimable(episodes, now).orderBy(*claim_order(now)).limit(limit)


def claim_batch(episodes: DataFrame, now: int, limit: int = 32) -> DataFrame:
    """A batch of 2 to 32 episodes of the rule version and kind of the first in order; fewer than 2 give none."""
    if not 2 <= limit <= 32:
        raise ValueError("a batch has 2 to 32 episodes")
    free = claimable(episodes, now)
    first = free.orderBy(*claim_order(now)).limit(1).select("rule_version", "kind")
    batch = free.join(F.broadcast(first), ["rule_version", "kind"], "left_semi").orderBy(*claim_order(now)).limit(limit)
    return batch.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy())).filter("size >= 2").drop("size")  # 32 rows at most


def recheck(episodes: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Adds eligible: whether the activation is still as the episode's event left it."""
    now = state.select(*keys, F.col("active").alias("s_active"), F.col("generation").alias("s_generation"), F.col("revision").alias("s_revision"))
    same = F.col("generation") == F.col("s_generation")
    ok = (
        F.when(F.col("kind") == "ACTIVATE", F.col("s_active") & same)
        .when(F.col("kind") == "CHANGE", F.col("s_active") & same & (F.col("revision") == F.col("s_revision")))
        .otherwise(~(F.col("s_active") & (F.col("s_generation") > F.col("generation"))))
    )
    return episodes.join(now, keys, "left").withColumn("eligible", F.coalesce(ok, F.col("kind") == "DEACTIVATE")).drop("s_active", "s_generation", "s_revision")


def admissible(episodes: DataFrame, versions: DataFrame, barriers: DataFrame, groups: DataFrame, now: int) -> DataFrame:
    """Episodes of versions (rule_version, state, agenda_group) that are ACTIVE or DRAINING, behind no barrier
    (rule_version), and of agenda groups (agenda_group, most_leased) that have leases left; adds agenda_group."""
    live = versions.filter(F.col("state").isin("ACTIVE", "DRAINING")).select("rule_version", "agenda_group").join(barriers.select("rule_version").distinct(), "rule_version", "left_anti")
    grouped = episodes.join(live, "rule_version")
    leased = grouped.filter((F.col("state") == "LEASED") & (F.col("lease_until") > now)).groupBy("agenda_group").agg(F.count(F.lit(1)).alias("leased"))
    full = groups.join(leased, "agenda_group").filter("leased >= most_leased").select("agenda_group")
    return grouped.join(full, "agenda_group", "left_anti")


def scope_recheck(episodes: DataFrame, supports: DataFrame, keys: list[str]) -> DataFrame:
    """Adds scope_state: WITHDRAWN for waiting work whose scope has no active support left, SKIPPED for leased work, else KEPT."""
    active = supports.filter("active").select(*keys).distinct().withColumn("supported", F.lit(True))
    gone = F.col("supported").isNull()
    state = F.when(gone & F.col("state").isin(*CLAIMABLE), "WITHDRAWN").when(gone & (F.col("state") == "LEASED"), "SKIPPED").otherwise("KEPT")
    return episodes.join(active, keys, "left").withColumn("scope_state", state).drop("supported")


def settle(results: DataFrame, now: int, initial: int, multiplier: float, most: int, attempts: int) -> DataFrame:
    """The next state of executed episodes: DONE, SKIPPED, RETRY_WAIT with a delay, or FAILED.

    results has eligible, error (SQLSTATE or null) and attempt. Syntax and permission
    errors (classes 42 and 28) and exhausted attempts are final.
    """
    from tidewright.functions.times import backoff

    final = F.col("error").rlike("^(28|42)") | (F.col("attempt") >= attempts)
    state = F.when(~F.col("eligible"), "SKIPPED").when(F.col("error").isNull(), "DONE").when(final, "FAILED").otherwise("RETRY_WAIT")
    wait = F.when(state == "RETRY_WAIT", F.lit(now) + backoff(F.col("attempt"), initial, multiplier, most).cast("bigint") * SECOND)
    return results.withColumn("next_state", state).withColumn("retry_at", wait)


def sweep(episodes: DataFrame, now: int) -> DataFrame:
    """Episodes after leases that ran out have been given back."""
    stale = (F.col("state") == "LEASED") & (F.col("lease_until") <= now)
    return episodes.withColumn("available_at", F.when(stale, F.lit(now).cast("bigint")).otherwise(F.col("available_at"))).withColumn("state", F.when(stale, "RETRY_WAIT").otherwise(F.col("state")))


def replace_version(episodes: DataFrame, version: object, policy: str) -> DataFrame:
    """Episodes after a rule version has been replaced: its waiting work is cancelled, or left to drain."""
    if policy not in ("DRAIN_OLD", "CANCEL_OLD"):
        raise ValueError(f"no such policy: {policy}")
    waiting = F.col("state").isin(*CLAIMABLE) & (F.col("rule_version") == F.lit(version))
    return episodes.withColumn("state", F.when(waiting & F.lit(policy == "CANCEL_OLD"), "CANCELLED").otherwise(F.col("state")))


def backpressure(episodes: DataFrame, most_pending: int) -> DataFrame:
    """Rule versions with as much waiting work as they may have: passes drain it and add none."""
    return episodes.filter(F.col("state").isin(*CLAIMABLE)).groupBy("rule_version").agg(F.count(F.lit(1)).alias("pending")).filter(F.col("pending") >= most_pending)


def batch_rejections(batch: DataFrame) -> DataFrame:
    """Why a batch can't run as one: codes for what its episodes must share or keep apart."""
    seen = batch.agg(F.count_distinct("rule_version").alias("versions"), F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("n"), F.count("conflict_key").alias("keyed"), F.count_distinct("conflict_key").alias("conflicts"), F.count_if(~F.col("state").isin(*CLAIMABLE)).alias("taken"))
    codes = F.filter(
        F.array(
            F.when(F.col("versions") > 1, "MIXED_VERSION"), F.when(F.col("kinds") > 1, "MIXED_EVENT"), F.when(F.col("keyed") > F.col("conflicts"), "INCOMPATIBLE_CONFLICT"),
            F.when(F.col("taken") > 0, "INELIGIBLE_EPISODE"), F.when(~F.col("n").between(2, 32), "OVERSIZED_OR_EMPTY"),
        ),
        lambda c: c.isNotNull(),
    )
    return seen.select(F.explode(codes).alias("code"))
