"""A window program over passes: staged rows, corrections and finalizations that outlive a pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidewright.sources.state import StateTable
from tidewright.streaming import windows


class LateInput(Exception):
    """Rows that would change final windows: the pass changed nothing."""


@dataclass(frozen=True)
class Shape:
    """What a program stages and measures: groups, event time, window, lateness, and an aggregate with its condition."""

    name: str
    groups: tuple[str, ...]
    event_time: str
    width: int
    lateness: int
    fn: str
    value: str
    truth: Callable[[Column], Column]


class WindowProgram:
    """One writer's state below a path; every table is a version or a partition of its own, so a failed pass leaves the last one."""

    def __init__(self, spark: SparkSession, shape: Shape, sample: DataFrame, path: str):
        """sample: rows with the program's columns, for their types."""
        self.spark, self.shape, self.path = spark, shape, path.rstrip("/")
        staged = self._staged(sample.limit(0)).schema
        kind = windows.measure(self._staged(sample.limit(0)), list(shape.groups), shape.fn, shape.value).schema["value"].dataType
        keys = [staged[g] for g in shape.groups] + [StructField("window", LongType())]
        self.staged = StateTable(spark, f"{path}/staged", staged)
        self.meta = StateTable(spark, f"{path}/meta", StructType([StructField("program_version", LongType()), StructField("frontier", LongType()), StructField("complete", LongType())]))
        told = [StructField("before", kind), StructField("after", kind), StructField("was_true", BooleanType()), StructField("is_true", BooleanType()), StructField("event", StringType())]
        self.corrections = StateTable(spark, f"{path}/corrections", StructType([*keys, *told, StructField("support_generation", LongType()), StructField("frontier", LongType()), StructField("identity", StringType())]))
        self.ledger = StateTable(spark, f"{path}/ledger", StructType([*keys, StructField("boundary", LongType()), StructField("identity", StringType())]))

    def _staged(self, rows: DataFrame) -> DataFrame:
        return windows.stage(rows, list(self.shape.groups), self.shape.event_time, self.shape.width, [self.shape.value])

    def status(self) -> dict:
        """program_version, frontier (passes so far) and the complete watermark (null before the first)."""
        row = self.meta.read().first()  # one row
        return row.asDict() if row else {"program_version": 1, "frontier": 0, "complete": None}

    def _note(self, **changed: int) -> None:
        row = self.status() | changed
        self.meta.write(self.spark.createDataFrame([tuple(row[n] for n in self.meta.schema.names)], self.meta.schema))

    def advance(self, rows: DataFrame) -> DataFrame:
        """One pass over all rows of the source; gives its corrections. Late input raises, and nothing has changed then."""
        s, at = self.shape, self.status()
        groups, frontier = list(s.groups), at["frontier"] + 1
        before, version = self.staged.read(), self.staged.write(self._staged(rows), move=False)
        after = self.staged.read(version)
        changed = windows.affected(before, after, groups)
        if windows.late(changed, s.width, s.lateness, at["complete"]).limit(1).count():
            raise LateInput(f"{s.name}: rows for windows that are final")
        count = lambda df: windows.measure(df, groups, s.fn, s.value)
        told = self.corrections.read()
        made = windows.identified(windows.corrections(count(before), count(after), changed, groups, s.truth), told, groups, f"{s.name}@{at['program_version']}", frontier)
        self.corrections.write(told.unionByName(made))
        self.staged.move(version)
        self._note(frontier=frontier)
        return self.corrections.read().filter(F.col("frontier") == frontier)

    def watermark(self, requested: int) -> DataFrame:
        """Finalizes all windows whose boundaries the requested watermark has reached; gives the new ledger rows."""
        s, at = self.shape, self.status()
        known = self.staged.read().select(*s.groups, "window").union(self.corrections.read().select(*s.groups, "window")).distinct()
        final = windows.ledger(windows.finalizations(known, s.width, s.lateness, at["complete"], requested), list(s.groups), self.ledger.read())
        was = self.ledger.version()
        self.ledger.write(self.ledger.read().unionByName(final.select(*self.ledger.schema.names)))
        self._note(complete=requested)
        return self.ledger.read().join(self.ledger.read(was).select("identity"), "identity", "left_anti")

    def replace(self) -> int:
        """A new version of the program: it keeps rows, watermark, history and identities; later corrections bear its number."""
        self._note(program_version=self.status()["program_version"] + 1)
        return self.status()["program_version"]

    def prune(self, cutoff: int) -> None:
        """Lets superseded corrections of final windows from before the cutoff pass go."""
        keys = [*self.shape.groups, "window"]
        told = self.corrections.read()
        gone = windows.prune(told, keys, self.ledger.read().select(*keys).distinct(), cutoff).select("identity")
        self.corrections.write(told.join(gone, "identity", "left_anti"))

    def export(self, path: str) -> None:
        """Everything a restore needs, as tables below path."""
        for name in ("staged", "meta", "corrections", "ledger"):
            getattr(self, name).read().write.mode("errorifexists").parquet(f"{path}/{name}")

    def restore(self, path: str) -> None:
        """The state of an export, in place of this one's."""
        for name in ("staged", "corrections", "ledger", "meta"):
            table = getattr(self, name)
            table.write(self.spark.read.schema(table.schema).parquet(f"{path}/{name}"))
