"""Declared rules and one pass over them: refresh, diff, state, events and work."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidewright.operators import lifecycle
from tidewright.sources.scratch import written
from tidewright.sources.state import StateTable

#: Fixed value: what a rule may be called.
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_.-]*$")


@dataclass(frozen=True)
class Rule:
    """A condition over DataFrames: one row a match, told apart by its keys."""

    name: str
    condition: Callable[[SparkSession], DataFrame]
    keys: tuple[str, ...]
    watched: tuple[str, ...] | None = None
    salience: int = 0
    conflict_key: tuple[str, ...] = ()

    def validate(self, spark: SparkSession) -> list[str]:
        """Codes of what is wrong with the declaration; an empty list if nothing is."""
        names = self.condition(spark).columns
        out = [] if _NAME.match(self.name) else ["NAME_INVALID"]
        out += [] if 1 <= len(self.keys) <= 4 else ["KEY_ARITY"]
        out += [f"COLUMN_UNKNOWN:{c}" for c in (*self.keys, *(self.watched or ()), *self.conflict_key) if c not in names]
        return out

    def preview(self, spark: SparkSession) -> DataFrame:
        return lifecycle.bindings_of(self.condition(spark), list(self.keys))


class RuleState:
    """A rule's durable state, event ledger and status below one path. The ledger is partitioned by pass."""

    def __init__(self, spark: SparkSession, rule: Rule, path: str):
        self.spark, self.rule = spark, rule
        shape = rule.preview(spark).schema
        keys, bindings = [shape[k] for k in rule.keys], StructField("bindings", shape["bindings"].dataType)
        counters = [StructField("generation", LongType()), StructField("revision", LongType())]
        self.state = StateTable(spark, f"{path}/state", StructType([*keys, StructField("active", BooleanType()), *counters, bindings]))
        self.statuses = StateTable(spark, f"{path}/status", StructType([StructField("status", StringType())]))
        self.ledger_schema = StructType([*keys, StructField("kind", StringType()), *counters, bindings, StructField("previous", bindings.dataType)])
        self.ledger_path = f"{path}/ledger"

    def status(self) -> str:
        """ACTIVE, PAUSED, DRAINING (removed, with work left) or REMOVED."""
        row = self.statuses.read().first()  # one row
        return row["status"] if row else "ACTIVE"

    def _become(self, status: str, allowed: tuple[str, ...]) -> None:
        if self.status() not in allowed:
            raise ValueError(f"a rule that is {self.status()} can't become {status}")
        self.statuses.write(self.spark.createDataFrame([(status,)], self.statuses.schema))

    def ledger(self) -> DataFrame:
        """Events of all passes whose state is written."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.ledger_path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.ledger_schema)
        read = self.spark.read.schema(StructType([*self.ledger_schema, StructField("pass", LongType())])).parquet(self.ledger_path)
        return read.filter(F.col("pass") <= self.state.version()).drop("pass")

    def seed(self, policy: str = "SEED_CURRENT") -> None:
        """Current matches become active without events, or, with REQUIRE_EMPTY, are an error."""
        if policy not in ("SEED_CURRENT", "REQUIRE_EMPTY"):
            raise ValueError(f"no such policy: {policy}")
        matches = written(self.rule.condition(self.spark), "matches")
        if policy == "REQUIRE_EMPTY" and matches.limit(1).count():
            raise ValueError("BOOTSTRAP_NOT_EMPTY: the condition has matches")
        lifecycle.require_keys(matches, list(self.rule.keys))
        self.state.write(lifecycle.seed(matches, list(self.rule.keys)))

    def run(self, emit: bool = True) -> DataFrame:
        """One pass. The condition is evaluated once; events are written before the state that they lead to.

        A pass that fails in between is repeated whole: its events are a partition of
        their own, which the repetition replaces, and nobody reads it until the state is there.
        emit=False repairs the state and writes no events. A paused or removed rule stays as it is.
        """
        if self.status() != "ACTIVE":
            return self.state.read()
        keys, version = list(self.rule.keys), self.state.version() + 1
        matches = written(self.rule.condition(self.spark), "matches")
        lifecycle.require_keys(matches, keys)
        return self._advance(matches, keys, version, emit)

    def _advance(self, matches: DataFrame, keys: list[str], version: int, emit: bool) -> DataFrame:
        advanced = written(lifecycle.advance(self.state.read(), matches, keys, None if self.rule.watched is None else list(self.rule.watched)), "advanced")
        events = lifecycle.events(advanced, keys)
        (events if emit else events.filter("false")).write.mode("overwrite").parquet(f"{self.ledger_path}/pass={version}")
        self.state.write(lifecycle.next_state(advanced, keys))
        return self.state.read()

    def pause(self) -> None:
        self._become("PAUSED", ("ACTIVE",))

    def resume(self, emit: bool = True) -> DataFrame:
        """Back to work with one pass: EMIT_MISSING_EVENTS of what changed meanwhile, or STATE_ONLY with emit=False."""
        self._become("ACTIVE", ("PAUSED",))
        return self.run(emit)

    def remove(self, drain: bool = False) -> None:
        """No more passes; with drain, work that waits is still done (see removed())."""
        self._become("DRAINING" if drain else "REMOVED", ("ACTIVE", "PAUSED"))

    def removed(self) -> None:
        """The work that a removed rule had left is done."""
        self._become("REMOVED", ("DRAINING",))

    def work(self, now: int) -> DataFrame:
        """Episodes of the ledger's events, with salience and conflict key."""
        conflict = F.to_json(F.array(*(F.coalesce(F.col(f"bindings.{c}"), F.col(f"previous.{c}")).cast("string") for c in self.rule.conflict_key))) if self.rule.conflict_key else F.lit(None).cast("string")
        return self.ledger().select(*self.rule.keys, "kind", "generation", "revision", F.lit(self.rule.salience).alias("salience"), conflict.alias("conflict_key"), F.lit("PENDING").alias("state"), F.lit(now).cast("bigint").alias("available_at"))
