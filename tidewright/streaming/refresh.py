"""Rules and windows kept current by Structured Streaming micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewright.plans.rules import RuleState


def keep_current(changes: DataFrame, rule: RuleState, facts_path: str) -> DataStreamWriter:
    """Appends each micro-batch to the facts and runs the rule; the caller adds a checkpoint and starts it.

    A replayed batch overwrites its own directory, and the ledger takes no event twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{facts_path}/batch={number}")
        rule.run()

    return changes.writeStream.foreachBatch(batch).outputMode("append")


def tumbling(events: DataFrame, groups: list[str], event_time: str, width: str, lateness: str) -> DataFrame:
    """Windowed counts and sums in a stream. Spark drops rows later than the watermark; use
    tidewright.streaming.windows where late rows must hold a program up instead."""
    return events.withWatermark(event_time, lateness).groupBy(*groups, F.window(event_time, width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
