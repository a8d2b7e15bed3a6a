"""What holds over several passes: rules, window programs, programs of programs, proofs and evidence."""

import datetime as dt

import pytest

from tidewright.operators import compare, coverage, decisions, derive, effective, provenance, temporal
from tidewright.plans.rules import Rule, RuleState
from tidewright.sources.state import StateTable
from tidewright.streaming.program import LateInput, Shape, WindowProgram

HOUR = 3_600_000_000


def at(hour, minute=0):
    return dt.datetime(1970, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.fixture
def source(spark, tmp_path):
    """A table that tests can replace, and a rule over it."""
    where = str(tmp_path / "source")

    def put(rows):
        spark.createDataFrame(rows, "id long, v long").write.mode("overwrite").parquet(where)

    return put, Rule("big", lambda s: s.read.parquet(where).filter("v > 10"), ("id",)), str(tmp_path / "rule")


def test_rule_pauses_resumes_and_goes(spark, source):
    put, rule, path = source
    put([(1, 20), (2, 5)])
    state = RuleState(spark, rule, path)
    with pytest.raises(ValueError, match="BOOTSTRAP_NOT_EMPTY"):
        state.seed("REQUIRE_EMPTY")
    state.seed()
    put([(1, 20), (2, 30)])
    state.run()
    state.pause()
    put([(2, 31), (3, 40)])
    assert rows_of(state.run().filter("active"), "id") == [(1,), (2,)] and state.ledger().count() == 1
    state.resume(emit=False)
    assert rows_of(state.state.read(), "id", "active", "generation", "revision") == [(1, False, 1, 0), (2, True, 1, 1), (3, True, 1, 0)] and state.ledger().count() == 1
    state.pause()
    put([(1, 50), (2, 31)])
    state.resume()
    assert rows_of(state.ledger(), "id", "kind", "generation") == [(1, "ACTIVATE", 2), (2, "ACTIVATE", 1), (3, "DEACTIVATE", 1)]
    state.remove(drain=True)
    assert state.status() == "DRAINING"
    put([])
    assert state.run().filter("active").count() == 2
    state.removed()
    with pytest.raises(ValueError):
        state.pause()


def test_pass_that_fails_before_its_state_is_repeated_whole(spark, source, monkeypatch):
    put, rule, path = source
    put([(1, 20)])
    state = RuleState(spark, rule, path)
    real = state.state.write
    monkeypatch.setattr(state.state, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        state.run()
    assert state.ledger().count() == 0  # nobody sees events without their state
    monkeypatch.setattr(state.state, "write", real)
    put([(2, 30)])
    state.run()
    assert rows_of(state.ledger(), "id", "kind") == [(2, "ACTIVATE")] and rows_of(state.state.read(), "id") == [(2,)]


def test_condition_runs_once_a_pass(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(it):
        for batch in it:
            reads.add(1)
            yield batch

    rule = Rule("once", lambda s: s.range(1, 2, 1, 1).mapInArrow(counted, "id long"), ("id",))
    state = RuleState(spark, rule, str(tmp_path))
    state.run()
    assert reads.value == 1


def test_state_is_not_written_again_unchanged(spark, tmp_path):
    rows = spark.range(5)
    table = StateTable(spark, str(tmp_path), rows.schema)
    assert table.write_if_changed(rows) and not table.write_if_changed(spark.range(5)) and table.write_if_changed(spark.range(6))
    assert table.version() == 2


def test_rows_that_look_alike_as_text_are_a_change(spark, tmp_path):
    schema = spark.createDataFrame([("", "")], "a string, b string").schema
    table = StateTable(spark, str(tmp_path), schema)
    assert table.write_if_changed(spark.createDataFrame([("x|y", "z"), (None, "q")], schema))
    assert table.write_if_changed(spark.createDataFrame([("x", "y|z"), (None, "q")], schema))
    assert table.write_if_changed(spark.createDataFrame([("x", "y|z"), ("~", "q")], schema))
    assert not table.write_if_changed(spark.createDataFrame([("~", "q"), ("x", "y|z")], schema))


def test_old_versions_go(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), spark.range(1).schema)
    for n in range(1, 6):
        table.write(spark.range(n))
    assert table.prune(2) == 3 and table.prune(2) == 0
    assert table.version() == 5 and table.read().count() == 5 and table.read(4).count() == 4


def test_as_of_many_versions_is_the_join(spark):
    """A hot key with many versions and gaps between them, rows at the same time, at starts and ends, and nulls."""
    versions = [("hot", 10 * k, 10 * k + (10 if k % 3 else 7), k) for k in range(1, 90)] + [("cold", 5, None, 1), ("late", 2000, None, 1), (None, 0, None, 9)]
    rows = [("hot", t, n) for n, t in enumerate([*range(0, 1000, 7), *[123] * 200, 10, 17, 20, 896, 897, 900])] + [("cold", 5, 0), ("cold", 4, 1), ("late", 1999, 2), ("none", 1, 3), (None, 1, 4), ("hot", None, 5)]
    v = spark.createDataFrame(versions, "k string, valid_from long, valid_to long, version long")
    r = spark.createDataFrame(rows + rows[:40], "k string, t long, n long")
    joined = effective.as_of(r, v, ["k"], "t", few=1000)
    assert joined.columns == effective.as_of(r, v, ["k"], "t", few=1).columns
    want = sorted((k, t, n, x) for k, t, n in rows + rows[:40] for kk, a, b, x in versions if k == kk and k and t is not None and a <= t and (b is None or t < b))
    for few in (1000, 1):
        assert sorted((x["k"], x["t"], x["n"], x["version"]) for x in effective.as_of(r, v, ["k"], "t", few).collect()) == want


def test_window_program_over_passes(spark, tmp_path):
    schema = "account long, amount long, occurred timestamp_ntz"
    make = lambda rows: spark.createDataFrame(rows, schema)
    shape = Shape("sums", ("account",), "occurred", HOUR, HOUR // 4, "sum", "amount", lambda v: v >= 10)
    program = WindowProgram(spark, shape, make([]), str(tmp_path / "p"))
    first = [(1, 6, at(0, 10)), (1, 6, at(0, 20)), (2, 3, at(0, 30)), (1, 1, at(2))]
    assert rows_of(program.advance(make(first)), "account", "window", "after", "event", "support_generation", "identity") == [
        (1, 0, 12, "ACTIVATE", 1, "sums@1/1/0/F1"), (1, 2, 1, None, 0, "sums@1/1/2/F1"), (2, 0, 3, None, 0, "sums@1/2/0/F1")]
    second = [*first[1:], (2, 9, at(0, 50))]
    assert rows_of(program.advance(make(second)), "account", "window", "before", "after", "event", "support_generation") == [(1, 0, 12, 6, "DEACTIVATE", 1), (2, 0, 3, 12, "ACTIVATE", 1)]
    assert program.advance(make(second)).count() == 0
    assert rows_of(program.watermark(HOUR + HOUR // 4), "account", "window", "identity") == [(1, 0, f"1@{HOUR + HOUR // 4}"), (2, 0, f"2@{HOUR + HOUR // 4}")]
    assert program.watermark(HOUR * 2).count() == 0
    with pytest.raises(ValueError):
        program.watermark(HOUR)
    before = rows_of(program.staged.read(), *program.staged.schema.names)
    with pytest.raises(LateInput):  # a final window would change; so nothing does
        program.advance(make([*second, (3, 99, at(0, 5)), (1, 50, at(2, 30))]))
    assert rows_of(program.staged.read(), *program.staged.schema.names) == before and program.status()["frontier"] == 3
    assert program.replace() == 2
    assert rows_of(program.advance(make([*second, (1, 50, at(2, 30))])), "identity", "after", "support_generation") == [("sums@2/1/2/F4", 51, 1)]
    program.export(str(tmp_path / "export"))
    program.prune(4)
    assert rows_of(program.corrections.read(), "identity") == [("sums@1/1/0/F2",), ("sums@1/1/2/F1",), ("sums@1/2/0/F2",), ("sums@2/1/2/F4",)]
    other = WindowProgram(spark, shape, make([]), str(tmp_path / "q"))
    other.restore(str(tmp_path / "export"))
    assert other.status() == program.status() and other.corrections.read().count() == 6 and other.ledger.read().count() == 2


def test_proof_has_one_row_a_fact(spark):
    """Diamonds, a cycle beside them, a fact that is reached early and late, and one without inputs."""
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"), ("e", "f"), ("x", "y"), ("y", "x"), ("y", "a"), ("f", None)]
    inputs = spark.createDataFrame(edges, "fact string, input string")
    proof = lambda root, depth, nodes=1000: rows_of(provenance.proof(spark.createDataFrame([(root,)], "fact string"), inputs, depth, nodes), "fact", "depth", "state", "omitted_nodes")
    assert proof("a", 32) == [("a", 0, "DERIVED", 0), ("b", 1, "DERIVED", 0), ("c", 1, "DERIVED", 0), ("d", 2, "DERIVED", 0), ("e", 1, "DERIVED", 0), ("f", 2, "GROUNDED", 0)]
    assert proof("a", 3) == [("a", 0, "DERIVED", 0), ("b", 1, "DERIVED", 0), ("c", 1, "DERIVED", 0), ("d", 2, "DERIVED", 0), ("e", 1, "TRUNCATED", 0), ("f", 2, "GROUNDED", 0)]
    assert [r[:3] for r in proof("x", 32)][-2:] == [("x", 0, "CYCLE"), ("y", 1, "DERIVED")]
    assert proof("a", 32, 2) == [("a", 0, "DERIVED", 4), ("b", 1, "DERIVED", 4)]


def test_proof_against_all_walks(spark):
    import random

    random.seed(3)
    edges = sorted({(random.randrange(9), random.randrange(9)) for _ in range(16)})
    inputs = spark.createDataFrame(edges, "fact long, input long")
    for depth in (1, 3, 5):
        seen = {}

        def walk(root, path, depth=depth, seen=seen):
            cycle = path[-1] in path[:-1]
            seen.setdefault((root, path[-1]), []).append((len(path) - 1, cycle))
            if not cycle and len(path) - 1 < depth:
                for a, b in edges:
                    if a == path[-1]:
                        walk(root, [*path, b])

        for r in range(9):
            walk(r, [r])
        more = {a for a, _ in edges}
        state = lambda f, v: "CYCLE" if any(c for _, c in v) else "GROUNDED" if f not in more else "TRUNCATED" if max(d for d, _ in v) >= depth else "DERIVED"  # noqa: B023, E731
        expected = sorted(((r, f, min(d for d, _ in v), state(f, v)) for (r, f), v in seen.items()), key=str)
        assert rows_of(provenance.proof(spark.range(9).withColumnRenamed("id", "fact"), inputs, depth), "root", "fact", "depth", "state") == expected


def test_walks_remember_only_facts_on_cycles(spark):
    """Facts by halves and thirds down to a cycle of two, and layers without any cycle: what a walk remembers multiplies the walks."""
    halves = [(n, n // by) for n in range(1, 600) for by in (2, 3)] + [(0, 1)]
    core = lambda edges, depth: rows_of(provenance._core(spark.createDataFrame(edges, "fact long, input long").distinct(), depth), "fact")
    assert core(halves, 5) == [(0,), (1,)]
    layers = [(10 * k + a, 10 * k + 10 + b) for k in range(10) for a in (0, 1) for b in (0, 1)]
    assert core(layers, 10) == [] and core([], 10) == []
    assert core([*layers, (101, 0)], 10) == sorted([(0,), (101,), *((10 * k + a,) for k in range(1, 10) for a in (0, 1))], key=str)


def test_proof_of_roots_without_inputs_or_above_themselves(spark):
    edges = [(1, 1), (1, 4), (2, 4), (2, None), (3, None)]
    roots = spark.createDataFrame([(1,), (2,), (2,), (3,), (5,)], "fact long")
    proof = lambda edges: rows_of(provenance.proof(roots, spark.createDataFrame(edges, "fact long, input long"), 3), "root", "fact", "depth", "state", "total_nodes")
    assert proof(edges) == [(1, 1, 0, "CYCLE", 2), (1, 4, 1, "GROUNDED", 2), (2, 2, 0, "DERIVED", 2), (2, 4, 1, "GROUNDED", 2), (3, 3, 0, "GROUNDED", 1), (5, 5, 0, "GROUNDED", 1)]
    assert proof([]) == [(r, r, 0, "GROUNDED", 1) for r in (1, 2, 3, 5)]


def test_evidence_stands_until_something_said_changes(spark):
    shape = "k long, value long, comparison string, threshold long, truth boolean"
    prior = spark.createDataFrame([(k, 5, ">=", 3, True, 7) for k in range(4)] + [(9, 1, ">=", 3, False, 7)], shape + ", lower_frontier long")
    current = spark.createDataFrame([(0, 5, ">=", 3, True), (1, 5, ">=", 4, True), (2, 5, ">", 3, True), (3, 6, ">=", 3, True), (4, 1, ">=", 3, False)], shape)
    assert rows_of(derive.evidence(prior, current, ["k"], 8), "k", "lower_frontier") == [(0, 7), (1, 8), (2, 8), (3, 8), (4, 8)]


def test_aggregates_over_derived_relations_and_their_cycles():
    over = lambda items: derive.Aggregate(items, "count_star", None, ">=", 1)
    program = derive.Program((derive.Rule("a", "a", "s"), derive.Rule("b", "b", "s", aggregate=over("a")), derive.Rule("c", "c", "s", ("b",))), ("k",))
    assert program.edges() == [("a", "b", "AGGREGATE"), ("b", "c", "POSITIVE")] and program.strata() == {"a": 0, "b": 1, "c": 1}
    with pytest.raises(ValueError, match="PROGRAM_AGGREGATE_CYCLE"):
        derive.Program((derive.Rule("a", "a", "s", aggregate=over("b")), derive.Rule("b", "b", "s", ("a",))), ("k",))


@pytest.mark.parametrize(("fn", "kind", "result"), [("count_star", None, "bigint"), ("count", "boolean", "bigint"), ("sum", "smallint", "bigint"), ("sum", "bigint", "decimal(38,0)"), ("sum", "float", "float"), ("min", "date", "date"), ("max", "string", "string"), ("sum", "decimal(12,2)", "decimal(12,2)")])
def test_aggregate_result_types(fn, kind, result):
    assert derive.result_type(fn, kind) == result


@pytest.mark.parametrize(("fn", "kind"), [("sum", "string"), ("sum", "date"), ("min", "boolean"), ("avg", "int")])
def test_aggregate_types_that_are_not(fn, kind):
    with pytest.raises(ValueError, match="AGGREGATE_TYPE_UNSUPPORTED"):
        derive.result_type(fn, kind)


def test_programs_run_after_what_they_read():
    assert derive.program_order({"late": {"mid", "src"}, "mid": {"early"}, "early": set(), "alone": {"elsewhere"}}) == ["alone", "early", "mid", "late"]
    with pytest.raises(ValueError, match="RUN_PROGRAM_CYCLE: a, b"):
        derive.program_order({"a": {"b"}, "b": {"a"}, "c": set()})


def test_distribution_has_every_candidate(spark):
    rows = lambda r: spark.createDataFrame(r, "subject long, candidate long, priority long")
    current, proposed = rows([(1, 101, 1), (2, 101, 1), (3, 102, 1), (3, 103, 1)]), rows([(1, 104, 1), (2, 101, 1)])
    got = lambda relative: rows_of(coverage.distribution(current, proposed, spark.createDataFrame([(105,)], "candidate long"), 1, relative), "candidate", "current", "proposed", "delta", "breach")
    plain = [(101, 2, 1, -1), (102, 0, 0, 0), (103, 0, 0, 0), (104, 0, 1, 1), (105, 0, 0, 0)]
    assert got(None) == [(*r, False) for r in plain]
    assert got(0.4) == [(*r, r[0] in (101, 104)) for r in plain]


def test_cooldown_ends_and_repeated_rows_hold_together(spark):
    inputs = spark.createDataFrame([(1, 10, True), (1, 10, False), (1, 40, True), (1, 60, True)], "k long, f long, truth boolean")
    got = temporal.replay(inputs, ["k"], "f", list(range(10, 80, 10)), temporal.cooldown(15))
    assert [(r["f"], r["status"], r["at"]) for r in got.orderBy("f").collect()] == [
        (10, "ACTIVE", None), (20, "COOLDOWN", 35), (30, "COOLDOWN", 35), (40, "ACTIVE", None), (50, "COOLDOWN", 65), (60, "COOLDOWN", 65), (70, "WAITING", None)]


def test_deadlines_are_checked(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (2, None, "y")], "k long, due long, text string")
    assert rows_of(temporal.deadline_findings(rows, "due"), "code", "n") == [("DEADLINE_NULL", 1)]
    assert [r["code"] for r in temporal.deadline_findings(rows, "text").collect()] == ["DEADLINE_TYPE"]
    assert temporal.deadline_findings(rows.filter("due IS NOT NULL"), "due").count() == 0


def test_decision_tables_have_types():
    from pyspark.sql.types import StructType

    good = StructType.fromDDL("subject long, candidate long, priority long, a decimal(9,2), b string, c timestamp")
    assert decisions.typing(good, ["a", "b", "c"]) == []
    bad = StructType.fromDDL("subject int, priority string, a array<int>, b double")
    assert decisions.typing(bad, ["a", "b", "c"]) == [("IDENTITY_TYPE", "subject"), ("CANDIDATE_COLUMN", "candidate"), ("PRIORITY_TYPE", "priority"), ("RESULT_TYPE", "a"), ("RESULT_TYPE", "b"), ("RESULT_COLUMN", "c")]


def test_source_is_current_as_a_multiset(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    state = lambda a, b: tuple(compare.source_current(a, b).first())
    assert state(rows, rows.repartition(2)) == ("CURRENT", 0, 0)
    assert state(rows, rows.distinct()) == ("STALE", 1, 0)
    assert state(rows.filter("a = 2"), rows.filter("a = 1")) == ("STALE", 1, 2)
    assert state(rows.filter("false"), rows.filter("false")) == ("CURRENT", 0, 0)
    assert state(rows, rows.withColumn("b", rows["a"]))[0] == "SCHEMA_CHANGED"


def test_proof_of_facts_that_rest_on_themselves(spark):
    """x rests on itself and on a seed, y on x; for key 2 x has the seed alone."""
    program = derive.Program((derive.Rule("seed", "x", "s"), derive.Rule("again", "x", "t", ("x",)), derive.Rule("next", "y", "s", ("x",), ("z",)), derive.Rule("never", "z", "u")), ("k",))
    sources = {"s": spark.createDataFrame([(1,), (2,)], "k long"), "t": spark.createDataFrame([(1,)], "k long"), "u": spark.createDataFrame([], "k long")}
    facts = derive.evaluate(program, sources)
    wanted = spark.createDataFrame([("y", 1), ("y", 2), ("z", 1), ("x", 9)], "relation string, k long")
    got = rows_of(derive.fact_proof(program, sources, facts, wanted), "relation", "k", "depth", "rule", "kind", "name", "value", "cycle")
    y = [("y", k, 0, "next", kind, name, None, False) for k in (1, 2) for kind, name in (("SOURCE", "s"), ("INPUT", "x"), ("NEGATIVE", "z"))]
    x = [("x", 1, 1, "again", "SOURCE", "t", None, False), ("x", 1, 1, "again", "INPUT", "x", None, True)] + [("x", k, 1, "seed", "SOURCE", "s", None, False) for k in (1, 2)]
    assert got == sorted(x + y, key=str)
