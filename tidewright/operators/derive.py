"""Derived facts: positive rules, stratified negation and aggregate thresholds over one key.

Every rule keeps its key, so recursion is between relations for a fixed key and a
component of n mutually recursive relations is complete after n rounds. The few
relations of a program are ordered on the driver; facts never come there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.sources.scratch import written

#: Comparisons of an aggregate with its threshold; a null aggregate is never true.
COMPARE = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Aggregate:
    """fn (count_star, count, sum, min or max) of a column of items, a source or a derived relation, against a threshold."""

    items: str
    fn: str
    column: str | None
    op: str
    threshold: object


@dataclass(frozen=True)
class Rule:
    """target gets the key of every source row that has a fact in all inputs and in no negative."""

    name: str
    target: str
    source: str
    inputs: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    aggregate: Aggregate | None = None


@dataclass(frozen=True)
class Program:
    rules: tuple[Rule, ...]
    key: tuple[str, ...]
    relations: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "relations", tuple(sorted({r.target for r in self.rules})))
        for r in self.rules:
            for name in (*r.inputs, *r.negatives):
                if name not in self.relations:
                    raise ValueError(f"PROGRAM_GRAPH_OPEN: {name} is not derived here")
        order = {n: k for k, part in enumerate(self.components()) for n in part}
        for a, b, kind in self.edges():
            if kind != "POSITIVE" and order[a] >= order[b]:
                raise ValueError(f"PROGRAM_{kind}_CYCLE: {b} and {a}")

    def edges(self) -> list[tuple[str, str, str]]:
        """(from, to, polarity) of every dependency."""
        made = {(i, r.target, "POSITIVE") for r in self.rules for i in r.inputs} | {(n, r.target, "NEGATIVE") for r in self.rules for n in r.negatives}
        return sorted(made | {(r.aggregate.items, r.target, "AGGREGATE") for r in self.rules if r.aggregate and r.aggregate.items in self.relations})

    def _above(self) -> dict[str, set[str]]:
        """What each relation depends on, however far."""
        above = {n: {a for a, b, _ in self.edges() if b == n} for n in self.relations}
        for _ in self.relations:
            for n in self.relations:
                above[n] = above[n].union(*(above[a] for a in above[n]))
        return above

    def components(self) -> list[tuple[str, ...]]:
        """Sets of mutually recursive relations, each after all that it depends on."""
        above = self._above()
        parts = {tuple(sorted({n} | {m for m in above[n] if n in above[m]})) for n in self.relations}
        return sorted(parts, key=lambda p: (len(above[p[0]] - set(p)), p))

    def strata(self) -> dict[str, int]:
        """The most negative and aggregate edges on a path to each relation."""
        level = dict.fromkeys(self.relations, 0)
        for _ in self.relations:
            for a, b, kind in self.edges():
                level[b] = max(level[b], level[a] + (kind != "POSITIVE"))
        return level


def program_order(programs: dict[str, set[str]]) -> list[str]:
    """Programs (by name, with those whose facts they read) in the order in which they run; a cycle is an error."""
    above = {n: set(p) & set(programs) for n, p in programs.items()}
    for _ in programs:
        above = {n: a.union(*(above[m] for m in a)) for n, a in above.items()}
    if loops := sorted(n for n, a in above.items() if n in a):
        raise ValueError(f"RUN_PROGRAM_CYCLE: {', '.join(loops)}")
    return sorted(programs, key=lambda n: (len(above[n]), n))


def aggregate_truth(groups: DataFrame, items: DataFrame, key: list[str], aggregate: Aggregate) -> DataFrame:
    """Each group's key with the aggregate's exact value and its truth; a missing group counts 0."""
    of = F.col(aggregate.column) if aggregate.column else None
    made = {"count_star": lambda: F.count(F.lit(1)), "count": lambda: F.count(of), "sum": lambda: F.sum(of), "min": lambda: F.min(of), "max": lambda: F.max(of)}[aggregate.fn]()
    joined = groups.select(*key).distinct().join(items.groupBy(*key).agg(made.alias("value")), key, "left")
    if aggregate.fn.startswith("count"):
        joined = joined.na.fill(0, ["value"])
    said = joined.withColumns({"comparison": F.lit(aggregate.op), "threshold": F.lit(aggregate.threshold)})
    return said.withColumn("truth", F.coalesce(COMPARE[aggregate.op](F.col("value"), F.col("threshold")), F.lit(False)))


def _once(rule: Rule, facts: dict[str, DataFrame], sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """The supports that a rule gives: its source's rows, by inputs, negatives and aggregate."""
    out = sources[rule.source]
    for name in rule.inputs:
        out = out.join(facts[name], key, "left_semi")
    for name in rule.negatives:
        out = out.join(facts[name], key, "left_anti")
    if rule.aggregate:
        items = rule.aggregate.items
        out = out.join(aggregate_truth(out, facts[items] if items in facts else sources[items], key, rule.aggregate).filter("truth"), key, "left_semi")
    return out.select(*key, F.lit(rule.name).alias("rule"))


def evaluate(program: Program, sources: dict[str, DataFrame], finish=written) -> dict[str, DataFrame]:  # noqa: ANN001
    """The facts of every relation: its keys. sources are keyed DataFrames by name.

    The least set is built up from nothing, so facts that only support one another never
    appear. finish is applied to the facts of each round of a recursive component, and of
    other relations that more than one rule uses: without it their plans would nest and repeat.
    """
    key = list(program.key)
    none = next(iter(sources.values())).select(*key).filter("false")
    facts = dict.fromkeys(program.relations, none)
    above = program._above()
    for part in program.components():
        recursive = len(part) > 1 or part[0] in above[part[0]]
        for _ in range(len(part) if recursive else 1):
            new = {}
            for name in part:
                rows = None
                for rule in program.rules:
                    if rule.target == name:
                        one = _once(rule, facts, sources, key).select(*key)
                        rows = one if rows is None else rows.union(one)
                used = sum(name in (*rule.inputs, *rule.negatives, rule.aggregate and rule.aggregate.items) for rule in program.rules)
                new[name] = finish(rows.distinct()) if recursive or used > 1 else rows.distinct()
            facts |= new
    return facts


def supports(program: Program, sources: dict[str, DataFrame], facts: dict[str, DataFrame]) -> DataFrame:
    """(relation, key, rule): which rules support which facts."""
    key, out = list(program.key), None
    for rule in program.rules:
        one = _once(rule, facts, sources, key).distinct().select(F.lit(rule.target).alias("relation"), *key, "rule")
        out = one if out is None else out.union(one)
    return out


def derived(rows: DataFrame, key: list[str]) -> DataFrame:
    """Facts from support rows (key and payload): support_count, and conflict where payloads differ."""
    payload = [c for c in rows.columns if c not in key]
    whole = F.struct(*payload)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("support_count"), F.min(whole).alias("least"), F.max(whole).alias("most")).select(*key, "support_count", (~F.col("least").eqNullSafe(F.col("most"))).alias("conflict"))


def invalid(stored: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Differences of stored facts from expected ones: MISSING and EXTRA."""
    missing = expected.join(stored, key, "left_anti").select(*key, F.lit("MISSING").alias("problem"))
    return missing.unionByName(stored.join(expected, key, "left_anti").select(*key, F.lit("EXTRA").alias("problem")))


#: What aggregate evidence says; a frontier stands as long as none of it changes.
EVIDENCE = ("value", "comparison", "threshold")


def evidence(prior: DataFrame, current: DataFrame, key: list[str], frontier: int) -> DataFrame:
    """Aggregate evidence after a pass: value, comparison, threshold, truth, and the frontier since which they stand.

    prior has all of these, current all but the frontier. Groups that are gone lose their evidence.
    """
    old = prior.select(*key, F.struct(*EVIDENCE).alias("was"), "lower_frontier")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"was.{c}")) for c in EVIDENCE))
    return current.join(old, key, "left").select(*key, *EVIDENCE, "truth", F.when(same, F.col("lower_frontier")).otherwise(F.lit(frontier).cast("bigint")).alias("lower_frontier"))


def evidence_problems(stored: DataFrame, expected: DataFrame, key: list[str], frontier: int) -> DataFrame:
    """How stored aggregate evidence differs from what a rebuild gives, one row for each key and problem.

    MISSING and EXTRA: only one side has the group. WRONG: another value, comparison,
    threshold or truth. INVALID_FRONTIER: no frontier, or one beyond the last pass; STALE: an older
    one than the rebuild's. Keys are unique on either side.
    """
    shown = (*EVIDENCE, "truth")
    old = stored.select(*key, F.struct(*shown).alias("s"), F.col("lower_frontier").alias("f_s"), F.lit(True).alias("has_s"))
    new = expected.select(*key, F.struct(*shown).alias("e"), F.col("lower_frontier").alias("f_e"), F.lit(True).alias("has_e"))
    both = old.join(new, key, "full_outer")
    here = F.col("has_s").isNotNull() & F.col("has_e").isNotNull()
    differs = reduce(Column.__or__, (~F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in shown))
    invalid_at = F.col("f_s").isNull() | (F.col("f_s") > frontier)
    codes = F.array(
        F.when(F.col("has_s").isNull(), "MISSING_AGGREGATE_EVIDENCE"),
        F.when(F.col("has_e").isNull(), "EXTRA_AGGREGATE_EVIDENCE"),
        F.when(here & differs, "WRONG_AGGREGATE_EVIDENCE"),
        F.when(here & invalid_at, "INVALID_AGGREGATE_FRONTIER"),
        F.when(here & ~invalid_at & (F.col("f_s") < F.col("f_e")), "STALE_AGGREGATE_EVIDENCE"),
    )
    return both.select(*key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("problem"))


#: Result types of aggregates over columns of a type, as names of Spark types.
_SUMS = {"smallint": "bigint", "int": "bigint", "bigint": "decimal(38,0)", "float": "float", "double": "double"}
_ORDERED = ("smallint", "int", "bigint", "float", "double", "string", "date", "timestamp", "timestamp_ntz")


def result_type(fn: str, kind: str | None) -> str:
    """The type of an aggregate's exact value, or an error where the type has no such aggregate."""
    if fn in ("count_star", "count"):
        return "bigint"
    decimal = bool(kind) and kind.startswith("decimal")
    if fn == "sum" and (decimal or kind in _SUMS):
        return kind if decimal else _SUMS[kind]
    if fn in ("min", "max") and (decimal or kind in _ORDERED):
        return kind
    raise ValueError(f"AGGREGATE_TYPE_UNSUPPORTED: {fn} of {kind}")


def negative_evidence(program: Program, facts: dict[str, DataFrame], sources: dict[str, DataFrame]) -> DataFrame:
    """(rule, relation, key, stratum): which absent facts each support of a rule with negatives rests on."""
    strata, out = program.strata(), None
    for rule in program.rules:
        for name in rule.negatives:
            one = _once(rule, facts, sources, list(program.key)).distinct().select("rule", F.lit(name).alias("relation"), *program.key, F.lit(strata[name]).alias("stratum"))
            out = one if out is None else out.union(one)
    return out


def fact_proof(program: Program, sources: dict[str, DataFrame], facts: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """What the wanted facts (relation, key) rest on, all the way down: relation, key, depth, rule, kind, name, value, cycle.

    A fact has a row for each thing that each of its supports needs: SOURCE, the rule's own row; INPUT, a
    fact that has rows of its own; NEGATIVE, a fact that is absent; AGGREGATE, a condition with its exact value. depth
    is the number of steps from the nearest wanted fact. cycle marks an input that rests on
    this very fact and is no deeper, where a walk would go round. Wanted facts that are none have no rows.
    """
    key, steps = list(program.key), None
    for rule in program.rules:
        one = _once(rule, facts, sources, key).distinct()
        needs = [("SOURCE", rule.source), *(("INPUT", n) for n in rule.inputs), *(("NEGATIVE", n) for n in rule.negatives)]
        value = F.lit(None).cast("string")
        if (a := rule.aggregate) is not None:
            truth = aggregate_truth(one, facts[a.items] if a.items in facts else sources[a.items], key, a)
            one, value = one.join(truth.select(*key, F.col("value").cast("string").alias("value")), key), F.col("value")
            needs.append(("AGGREGATE", f"{a.fn}({a.column or '*'}) of {a.items} {a.op} {a.threshold}"))
        listed = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.when(F.lit(k == "AGGREGATE"), value).alias("value")) for k, n in needs))
        made = one.select(F.lit(rule.target).alias("relation"), *key, "rule", F.explode(listed).alias("s")).select("relation", *key, "rule", "s.*")
        steps = made if steps is None else steps.unionByName(made)
    steps, fact = written(steps, "steps"), ["relation", *key]
    rests = written(steps.filter("kind = 'INPUT'").select(*fact, "name").distinct(), "rests")
    level = written(wanted.select(*fact).distinct().withColumn("depth", F.lit(0)), "level")
    reached = level
    for d in range(1, len(program.relations)):  # a walk without a cycle has no more steps
        below = level.join(rests, fact).select(F.col("name").alias("relation"), *key).distinct()
        level = written(below.join(reached, fact, "left_anti").withColumn("depth", F.lit(d)), "level")
        if not level.limit(1).count():
            break
        reached = reached.unionByName(level)
    proven = steps.join(reached, fact)
    loops = [p for p in program.components() if len(p) > 1 or (p[0], p[0], "POSITIVE") in program.edges()]
    if not loops:
        return proven.select(*fact, "depth", "rule", "kind", "name", "value", F.lit(False).alias("cycle"))
    inner = rests.filter(reduce(Column.__or__, (F.col("relation").isin(*p) & F.col("name").isin(*p) for p in loops)))
    above = inner.select(*key, F.col("relation").alias("upper"), F.col("name").alias("lower"))
    for _ in range(max(map(len, loops)) - 1):  # pairs of a key are pairs of the program's relations
        more = above.join(inner.select(*key, F.col("relation").alias("lower"), "name"), [*key, "lower"]).select(*key, "upper", F.col("name").alias("lower"))
        above = written(above.union(more).distinct(), "above")
    back = above.select(*key, F.col("upper").alias("name"), F.col("lower").alias("relation"), F.lit("INPUT").alias("kind"), F.lit(True).alias("back"))
    met = reached.select(*key, F.col("relation").alias("name"), F.lit("INPUT").alias("kind"), F.col("depth").alias("at"))
    marked = proven.join(met, [*key, "name", "kind"], "left").join(back, [*fact, "name", "kind"], "left")
    return marked.select(*fact, "depth", "rule", "kind", "name", "value", F.coalesce(F.col("back") & (F.col("at") <= F.col("depth")), F.lit(False)).alias("cycle"))
