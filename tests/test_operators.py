"""Golden values, boundaries, model histories and idempotence."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import identity, times
from tidewright.operators import decisions, derive, lifecycle, temporal
from tidewright.plans.rules import Rule, RuleState
from tidewright.sources.state import StateTable
from tidewright.streaming import windows


def test_identity_golden(spark):
    d = identity.digest("00000000-0000-0000-0000-000000000000", identity.canonical_bigint(F.lit(42)))
    digest, uuid = spark.range(1).select(d, identity.uuid_of(d)).first()
    assert digest.startswith("8307bd70") and digest.endswith("fa23e")
    assert uuid == "8307bd70-b287-81d3-9b35-6a1df7c9bb60"


def test_identity_tuple_bytes(spark):
    key = identity.canonical_tuple([(F.lit(-1), "bigint"), (F.lit("é"), "text"), (F.lit("8307BD70-b287-81d3-9b35-6a1df7c9bb60"), "uuid")])
    assert spark.range(1).select(F.hex(key)).first()[0] == "0203" + "01" + "00000008" + "F" * 16 + "0300000002C3A9" + "0200000010" + "8307BD70B28781D39B356A1DF7C9BB60"


@pytest.mark.parametrize(("text", "us"), [("PT1H", 3600 * 10**6), ("P1DT2M", 86520 * 10**6), ("PT0.5S", 500_000)])
def test_fixed_intervals(text, us):
    assert times.micros(text) == us


@pytest.mark.parametrize("text", ["P1M", "P1Y", "P", "PT", "PT0S", "1H", "P1DT"])
def test_interval_rejections(text):
    with pytest.raises(ValueError):
        times.micros(text)


def test_window_ordinal_floors(spark):
    got = spark.createDataFrame([(-1,), (0,), (99,), (100,), (-100,), (-101,)], "us long").select(times.ordinal(F.col("us"), 100)).collect()
    assert [r[0] for r in got] == [-1, 0, 0, 1, -1, -2]


def test_backoff_rounds_and_stops(spark):
    got = spark.createDataFrame([(1,), (2,), (3,), (20,)], "n long").select(times.backoff(F.col("n"), 1, 1.5, 60)).collect()
    assert [r[0] for r in got] == [1, 2, 2, 60]


def test_lifecycle_follows_model(spark):
    """Random histories against a dict that does one key at a time."""
    rng, keys = random.Random(411), range(12)
    schema = "k long, active boolean, generation long, revision long, bindings struct<v:string>"
    state = spark.createDataFrame([], schema)
    model: dict[int, list] = {}
    for _ in range(6):
        now = {k: str(rng.randrange(3)) if rng.random() < 0.9 else None for k in keys if rng.random() < 0.6}
        expected = set()
        for k in keys:
            active, generation, revision, value = model.get(k, [False, 0, 0, None])
            if k in now and not active:
                model[k] = [True, generation + 1, 0, now[k]]
                expected.add((k, "ACTIVATE", generation + 1, 0))
            elif k in now and now[k] != value:
                model[k] = [True, generation, revision + 1, now[k]]
                expected.add((k, "CHANGE", generation, revision + 1))
            elif k not in now and active:
                model[k] = [False, generation, revision, value]
                expected.add((k, "DEACTIVATE", generation, 0))
        done = lifecycle.advance(state, spark.createDataFrame(list(now.items()), "k long, v string"), ["k"])
        got = {tuple(r) for r in lifecycle.events(done, ["k"]).select("k", "kind", "generation", "revision").collect()}
        assert got == expected
        state = spark.createDataFrame(lifecycle.next_state(done, ["k"]).collect(), schema)
        assert {r["k"]: [r["active"], r["generation"], r["revision"], r["bindings"]["v"]] for r in state.collect()} == model


def test_keys_must_hold(spark):
    with pytest.raises(lifecycle.KeyViolation, match="KEY_NULL: 1.*KEY_DUPLICATE: 1|KEY_DUPLICATE: 1.*KEY_NULL: 1"):
        lifecycle.require_keys(spark.createDataFrame([(1,), (1,), (None,)], "k long"), ["k"])


def test_program_graph():
    rule = derive.Rule
    with pytest.raises(ValueError, match="PROGRAM_GRAPH_OPEN"):
        derive.Program((rule("r", "a", "s", ("nowhere",)),), ("k",))
    with pytest.raises(ValueError, match="PROGRAM_NEGATIVE_CYCLE"):
        derive.Program((rule("r", "a", "s", ("b",)), rule("q", "b", "s", (), ("a",))), ("k",))


def test_recursion_and_negation_golden(spark):
    """Seeds 1 and 2, a -> b -> c -> b, 2 blocked: eligible is 1."""
    rule = derive.Rule
    program = derive.Program((rule("1", "a", "seeds"), rule("2", "b", "seeds", ("a",)), rule("3", "b", "seeds", ("c",)), rule("4", "c", "seeds", ("b",)), rule("5", "x", "blocked"), rule("6", "e", "seeds", ("c",), ("x",))), ("id",))
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    facts = derive.evaluate(program, {"seeds": frame(1, 2), "blocked": frame(2)})
    assert [r[0] for r in facts["e"].collect()] == [1]
    loop = derive.Program((rule("2", "b", "seeds", ("c",)), rule("3", "c", "seeds", ("b",))), ("id",))
    assert derive.evaluate(loop, {"seeds": frame(1, 2)})["b"].count() == 0  # facts that only support one another


def test_aggregate_reorder_golden(spark):
    lines = spark.createDataFrame([(1, 101, 4), (2, 101, 7), (3, 102, 2)], "line long, id long, units int")
    groups = spark.createDataFrame([(101,), (102,), (103,)], "id long")
    found = derive.aggregate_truth(groups, lines, ["id"], derive.Aggregate("lines", "sum", "units", ">=", 10))
    assert [r["id"] for r in found.filter("truth").collect()] == [101]
    count = derive.aggregate_truth(groups, lines, ["id"], derive.Aggregate("lines", "count_star", None, "=", 0))
    assert [r["id"] for r in count.filter("truth").collect()] == [103]


def test_decision_golden(spark):
    rows = spark.createDataFrame([(1, 101, 20), (1, 102, 10), (2, 201, 5), (2, 202, 5), (3, 301, 1)], "subject long, candidate long, priority long")
    got = {r["subject"]: (r["state"], r["candidate"]) for r in decisions.winners(rows).collect()}
    assert got == {1: ("WINNER", 102), 2: ("AMBIGUOUS", None), 3: ("WINNER", 301)}


def test_deadline_equality_is_due(spark):
    rows = spark.createDataFrame([(11, 10), (12, 20)], "id long, deadline long")
    assert [r["id"] for r in temporal.due(rows, "deadline", 10).collect()] == [11]
    assert temporal.due(rows, "deadline", None).count() == 0
    assert temporal.advance_frontier(10, 5) == 10


def test_temporal_trace(spark):
    """Minutes 0, 5, 10, 20, 40: a duration of 10, a cooldown of 10."""
    minute = 60 * 10**6
    truths = {0: True, 5: True, 10: False, 20: True, 40: True}
    inputs = spark.createDataFrame([(1, m * minute, v) for m, v in truths.items()], "id long, at_frontier long, truth boolean")
    frontiers = [m * minute for m in truths]
    status = lambda step: [r["status"] for r in temporal.replay(inputs, ["id"], "at_frontier", frontiers, step).orderBy("at_frontier").collect()]
    assert status(temporal.duration(10 * minute)) == ["PENDING", "PENDING", "WAITING", "PENDING", "ACTIVE"]
    assert status(temporal.cooldown(10 * minute)) == ["ACTIVE", "ACTIVE", "COOLDOWN", "ACTIVE", "ACTIVE"]


def test_temporal_advance_equals_replay(spark):
    inputs = spark.createDataFrame([(k, f, (k * f) % 3 == 0) for k in range(5) for f in (10, 20, 30)], "id long, f long, truth boolean")
    replayed = {(r["id"], r["f"]): (r["status"], r["active"], r["generation"]) for r in temporal.replay(inputs, ["id"], "f", [10, 20, 30], temporal.duration(10)).collect()}
    state = spark.createDataFrame([], f"id long, state {temporal.STATE}")
    for f in (10, 20, 30):
        done = temporal.advance(state, inputs.filter(F.col("f") == f).select("id", "truth"), ["id"], f, temporal.duration(10))
        rows = done.collect()
        assert {r["id"]: (r["state"]["status"], r["state"]["active"], r["state"]["generation"]) for r in rows} == {k: v for (k, g), v in replayed.items() if g == f}
        state = spark.createDataFrame([(r["id"], r["state"]) for r in rows], f"id long, state {temporal.STATE}")


def test_watermark_never_falls(spark):
    rows = spark.createDataFrame([(1, 0)], "g long, window long")
    with pytest.raises(ValueError):
        windows.finalizations(rows, 10, 0, 20, 10)
    assert windows.finalizations(rows, 10, 0, None, 10).count() == 1


def test_state_table_versions(spark, tmp_path):
    rows = spark.range(3)
    table = StateTable(spark, str(tmp_path / "t"), rows.schema)
    assert table.read().count() == 0 and table.version() == 0
    assert table.write(rows) == 1 and table.write(rows.filter("id > 0")) == 2
    assert table.read().count() == 2 and table.read(1).count() == 3


def test_rule_runs_once(spark, tmp_path):
    facts = {"rows": [(1, 10.0), (2, 20.0)]}
    rule = Rule("big", lambda s: s.createDataFrame(facts["rows"], "id long, amount double").filter("amount > 5"), ("id",), conflict_key=("amount",))
    assert rule.validate(spark) == []
    assert Rule("1 bad", rule.condition, ("id", "nope")).validate(spark) == ["NAME_INVALID", "COLUMN_UNKNOWN:nope"]
    state = RuleState(spark, rule, str(tmp_path))
    state.run()
    state.run()
    assert state.ledger().count() == 2
    facts["rows"] = [(1, 11.0)]
    state.run()
    assert {(r["id"], r["kind"]) for r in state.ledger().collect()} == {(1, "ACTIVATE"), (2, "ACTIVATE"), (1, "CHANGE"), (2, "DEACTIVATE")}
    assert {r["conflict_key"] for r in state.work(0).collect()} == {'["10.0"]', '["20.0"]', '["11.0"]'}


def test_streaming_refresh(spark, tmp_path):
    from tidewright.streaming.refresh import keep_current

    source, facts = str(tmp_path / "in"), str(tmp_path / "facts")
    spark.createDataFrame([(1, 3.0), (2, 7.0)], "id long, amount double").write.parquet(source)
    read = lambda s: s.read.schema("id long, amount double, batch int").parquet(facts).groupBy("id").agg(F.sum("amount").alias("amount")).filter("amount > 5")
    spark.createDataFrame([], "id long, amount double").write.parquet(f"{facts}/batch=-1")
    state = RuleState(spark, Rule("sums", read, ("id",)), str(tmp_path / "state"))
    stream = spark.readStream.schema("id long, amount double").parquet(source)
    keep_current(stream, state, facts).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert [r["id"] for r in state.ledger().collect()] == [2]
