"""Chat formatting (operator 3): multi-party perspective rotation.

For every participant of a dialogue the whole of it is rendered with that speaker as the
assistant and the others as named users, and the assistant's turns are marked as what to
learn. Dialogues beyond a bounded number of turns are rendered in segments; each begins
with the dialogue's opening system turns, which nobody learns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import materialize

#: Turns of a segment: dialogues up to here are rendered whole.
SEGMENT = 1024
#: The markers of a turn.
START, END = "<|im_start|>", "<|im_end|>"


def rotate(
    turns: DataFrame, segment: int = SEGMENT, system_role: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each dialogue, participant and segment: conv id, perspective, segment, n_turns, n_learned, rendered, mask.

    Turns are in the order of turn, role and text; nulls come first. n_turns counts the
    segment's own turns; rendered begins with the opening system turns, those of the first
    segment before any other role, in later segments too. mask lists the
    character ranges [a, b) of rendered that hold the perspective's own texts and their
    end marks, as a-b joined by commas. System turns are everyone's context and nobody's perspective; a
    dialogue of them alone gives no rows. A null role is the participant "unknown", a null
    text is empty, a null conv id is a dialogue of its own. Repeated rows are turns of their
    own. Markers inside texts and roles are broken up, and line ends in roles become spaces.
    An empty table gives an empty result; extra columns are not read.
    """
    spark = turns.sparkSession
    broken = lambda c, null: F.replace(F.coalesce(F.col(c), F.lit(null)), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.translate(broken(role_col, "unknown"), "\n\r", "  ").alias("role"), broken(text_col, "").alias("text"))
    # A dialogue may hold a third of all turns. Ranges of the sort order split it, and a
    # turn's number follows from the sizes of the ranges before its own.
    order = ["conv", "turn", "role", "text"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumn("tie", F.rand(5)).repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "turns")
    ahead, total = [], 0
    for r in sorted(placed.groupBy("range").count().collect()):  # as many rows as ranges
        ahead.append((r["range"], total))
        total += r["count"]
    numbered = placed.join(F.broadcast(spark.createDataFrame(ahead, "range int, ahead long")), "range").withColumn("at", F.col("ahead") + F.col("i")).drop("range", "ahead", "i", "turn")
    system = F.col("role") == system_role
    begins = numbered.groupBy("conv").agg(F.min("at").alias("begin"), F.min(F.when(~system, F.col("at"))).alias("opened")).withColumnRenamed("conv", "b_conv")
    within = numbered.join(begins, F.col("conv").eqNullSafe(F.col("b_conv"))).withColumn("segment", F.expr(f"(at - begin) div {segment}"))
    shown = F.concat(F.lit(f"{START}system\n"), F.col("text"), F.lit(END + "\n"))
    # The opening system turns: of one segment at most.
    opening = within.filter((F.col("segment") == 0) & (F.col("at") < F.col("opened"))).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown")))).alias("o"))
    opening = opening.select(F.col("conv").alias("o_conv"), F.expr("array_join(transform(o, x -> x.shown), '')").alias("opening"))

    # Where a turn's text is: the sizes before it as a named user's, and by how much the
    # perspective's own turns before it are shorter. Both are sums over one segment.
    named = F.when(system, F.lit("system")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    size = F.char_length("text") + len(START) + F.char_length("named") + len(END) + 2
    inside = Window.partitionBy("conv", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv", "segment", "role").orderBy("at")
    sized = within.withColumn("named", named).withColumn("before", F.coalesce(F.sum(size).over(inside), F.lit(0))).withColumn("nth", F.row_number().over(own) - 1)
    blocks = sized.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "named", "before", "nth"))).alias("turns"))
    who = placed.filter(~system).select(F.col("conv").alias("p_conv"), F.col("role").alias("perspective")).distinct()
    seen = blocks.join(who, F.col("conv").eqNullSafe(F.col("p_conv"))).join(opening, F.col("conv").eqNullSafe(F.col("o_conv")), "left")
    seen = seen.withColumn("head", F.when(F.col("segment") > 0, F.coalesce("opening", F.lit(""))).otherwise(F.lit("")))
    shorter = f"(char_length(perspective) + {len('user name=') - len('assistant')})"
    begin = f"(char_length(head) + t.before - t.nth * {shorter} + {len(START) + len('assistant') + 1})"
    return seen.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("size(filter(turns, t -> t.role = perspective))").cast("long").alias("n_learned"),
        F.expr(f"concat(head, array_join(transform(turns, t -> concat('{START}', IF(t.role = perspective, 'assistant', t.named), '\\n', t.text, '{END}\\n')), ''))").alias("rendered"),
        F.expr(f"array_join(transform(filter(turns, t -> t.role = perspective), t -> concat({begin}, '-', {begin} + char_length(t.text) + {len(END)})), ',')").alias("mask"),
    )


ORACLE_SQL = f"""
WITH r AS (SELECT conv_id, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, turn FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM r),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
o AS (SELECT conv_id, string_agg('{START}system' || chr(10) || text || '{END}' || chr(10), '' ORDER BY k) AS opening
      FROM (SELECT *, min(CASE WHEN role <> 'system' THEN k END) OVER (PARTITION BY conv_id) AS opened FROM n) WHERE k < opened AND k < {SEGMENT} GROUP BY conv_id),
f AS (SELECT n.conv_id, perspective, k // {SEGMENT} AS segment, k, role = perspective AS own, text, CASE WHEN k >= {SEGMENT} THEN coalesce(opening, '') ELSE '' END AS opening,
             '{START}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head FROM n JOIN p USING (conv_id) LEFT JOIN o USING (conv_id)),
g AS (SELECT *, head || text || '{END}' || chr(10) AS whole,
             length(opening) + coalesce(sum(length(head) + length(text) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective, segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM f)
SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_learned, any_value(opening) || string_agg(whole, '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(begin_at + length(head) AS BIGINT) || '-' || CAST(begin_at + length(head) + length(text) + {len(END)} AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM g GROUP BY conv_id, perspective, segment
"""
