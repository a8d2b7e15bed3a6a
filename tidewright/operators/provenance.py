"""Where facts come from: bindings of source columns and bounded proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import written

#: The most steps that a proof walks, and the facts that it gives unless asked for more.
DEPTH, NODES = 32, 1_000


def bindings(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """One row for each key and source column: its order, name and value as text."""
    rest = [c for c in rows.columns if c not in keys]
    pairs = F.array(*(F.struct(F.lit(1_000_000 + k + 1).alias("position"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for k, c in enumerate(rest)))
    return rows.select(*keys, F.lit(source).alias("source"), F.explode(pairs).alias("b")).select(*keys, "source", "b.*")


#: Part of the inputs that a round of _core takes away at least if more rounds are to follow.
SHRINKS = 8


def _core(derived: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(fact): facts that may lie on a cycle: those left when facts without inputs, or that nothing rests on, are taken away again and again.

    There are up to `depth` rounds, and more while each takes away an eighth of the inputs that
    are left, so they read the inputs depth + 8 times at most. Facts that stay for no reason cost memory and change nothing.
    """
    edges, left, rounds = derived, derived.count(), 0
    while left:
        below, above = edges.select("fact").distinct(), edges.select("input").distinct()
        edges = written(edges.join(above.withColumnRenamed("input", "fact"), "fact", "left_semi").join(below.withColumnRenamed("fact", "input"), "input", "left_semi").select("fact", "input"), "core")
        before, left, rounds = left, edges.count(), rounds + 1
        if left == before or (rounds >= depth and (before - left) * SHRINKS < before):
            break
    return edges.select("fact").distinct()


def proof(roots: DataFrame, inputs: DataFrame, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """The facts below each root, one row each: root, fact, depth, state, total_nodes, omitted_nodes.

    inputs has fact and input (null: an authoritative source); depth is the least number
    of steps from the root, whose own is 0, and at most `depth` steps are walked. CYCLE is
    a fact that stands above itself, where that walk ends; GROUNDED ones have no input at all,
    TRUNCATED ones are reached by a walk of the greatest depth, others are DERIVED. Of each
    root the first `nodes` facts by depth and fact are given, and how many are left out.

    A walk remembers only facts that may be on a cycle, so walks that differ in others are one.
    """
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"depth is 1 to {DEPTH}")
    derived = written(inputs.filter("input IS NOT NULL").select("fact", "input").distinct(), "inputs")
    core = _core(derived, depth).withColumn("on_core", F.lit(True))
    known = written(derived.select("fact").distinct().join(core, "fact", "left").select("fact", F.lit(True).alias("more"), F.coalesce("on_core", F.lit(False)).alias("on_core")), "known")
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("more", "on_core")]
    onto = written(derived.join(known.withColumnRenamed("fact", "input"), "input", "left").select("fact", "input", *marks), "inputs")
    level = roots.select(F.col("fact").alias("root"), "fact").join(known, "fact", "left").select("root", "fact", *marks)
    level = level.select("root", "fact", "more", F.when(F.col("on_core"), F.array("fact")).alias("path"), F.lit(False).alias("cycle"))
    reached = None
    for d in range(depth + 1):
        level = written(level.distinct(), "level") if d < depth else level  # the last walks are grouped only
        rows = level.select("root", "fact", "more", "cycle", F.lit(d).cast("bigint").alias("depth"))
        reached = rows if reached is None else reached.union(rows)
        going = level.filter("more AND NOT cycle")
        if d == depth or going.limit(1).count() == 0:
            break
        step = going.drop("more").join(onto, "fact")
        path = F.when(F.col("on_core"), F.array_sort(F.array_union(F.coalesce("path", F.array("input")), F.array("input")))).otherwise(F.col("path"))
        cycle = F.coalesce(F.array_contains("path", F.col("input")), F.lit(False))
        level = step.select("root", F.col("input").alias("fact"), "more", path.alias("path"), cycle.alias("cycle"))
    grouped = written(reached.groupBy("root", "fact").agg(F.min("depth").alias("depth"), F.bool_or("cycle").alias("cycle"), F.max("depth").alias("deepest"), F.bool_or("more").alias("more")), "reached")
    state = F.when(F.col("cycle"), "CYCLE").when(~F.col("more"), "GROUNDED").when(F.col("deepest") >= depth, "TRUNCATED").otherwise("DERIVED")
    total = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("total_nodes"))
    first = grouped.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("depth", "fact"))).filter(F.col("nth") <= nodes)  # one proof
    return first.join(total, "root").select("root", "fact", "depth", state.alias("state"), "total_nodes", F.greatest(F.col("total_nodes") - nodes, F.lit(0).cast("bigint")).alias("omitted_nodes"))
