"""Named queries over the star-schema tables, and the SQL that must give the same rows.

Rules use orders and customers, decisions line items, time and windows events. Every query
reads whole tables; a limit stands only where an operator is a top-k, a claim or a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import identity, times
from tidewright.operators import agenda, compare, coverage, decisions, derive, effective, health, lifecycle, policy, provenance, retention, sharing, temporal
from tidewright.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VERSION = "11111111-2222-3333-4444-555555555555"
DAY, HOUR = times.DAY, times.HOUR
#: 2024-01-01 in microseconds.
START = 1_704_067_200 * times.SECOND


def query(sql: str | None):  # noqa: ANN201
    """Registers a function (spark, table) -> DataFrame under its name, with its SQL."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


# Conditions


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def match_filter(spark, t):  # noqa: ANN001, ANN201
    return t("orders").filter("o_totalprice > 300000 AND o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_acctbal < 0")
def match_join(spark, t):  # noqa: ANN001, ANN201
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).filter("o_totalprice > 200000 AND c_acctbal < 0").select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'VERY_HIGH' WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' WHEN c_acctbal < 0 THEN 'DEBT' ELSE 'NONE' END AS reason
FROM orders JOIN customer ON o_custkey = c_custkey""")
def match_case(spark, t):  # noqa: ANN001, ANN201
    reason = F.when(F.col("o_totalprice") > 400000, "VERY_HIGH").when(F.col("o_orderpriority") == "1-URGENT", "URGENT").when(F.col("c_acctbal") < 0, "DEBT").otherwise("NONE")
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", reason.alias("reason"))


@query("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def key_duplicates(spark, t):  # noqa: ANN001, ANN201
    return t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("""SELECT * FROM (
SELECT 'KEY_NULL' AS code, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id * 13 WHERE c_custkey IS NULL
UNION ALL SELECT 'KEY_DUPLICATE', count(*) FROM (SELECT c_custkey FROM events JOIN customer ON c_custkey = user_id * 13 GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""")
def key_nulls(spark, t):  # noqa: ANN001, ANN201
    return lifecycle.check_keys(t("events").join(t("customer"), F.col("c_custkey") == F.col("user_id") * 13, "left").select("c_custkey", "event_id"), ["c_custkey"])


# Identity

_UUID = "substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-8' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12)"
_V = VERSION.replace("-", "")


@query(f"""SELECT o_orderkey, d AS digest, {_UUID} AS activation_id FROM (
SELECT o_orderkey, sha256(unhex('{_V}') || unhex('010100000008') || unhex(printf('%016X', o_orderkey))) AS d FROM orders)""")
def identity_v1(spark, t):  # noqa: ANN001, ANN201
    d = identity.digest(VERSION, identity.canonical_bigint(F.col("o_orderkey")))
    return t("orders").select("o_orderkey", d.alias("digest"), identity.uuid_of(d).alias("activation_id"))


@query(f"""SELECT c_custkey, d AS digest, {_UUID} AS activation_id FROM (
SELECT c_custkey, sha256(unhex('{_V}') || unhex('02020100000008') || unhex(printf('%016X', c_custkey)) || unhex('03') || unhex(printf('%08X', strlen(c_mktsegment))) || encode(c_mktsegment)) AS d FROM customer)""")
def identity_v2_tuple(spark, t):  # noqa: ANN001, ANN201
    d = identity.digest(VERSION, identity.canonical_tuple([(F.col("c_custkey"), "bigint"), (F.col("c_mktsegment"), "text")]))
    return t("customer").select("c_custkey", d.alias("digest"), identity.uuid_of(d).alias("activation_id"))


@query("""SELECT c_custkey, lower(hex(unhex('020200000001') || unhex('0100000008') || unhex(printf('%016X', c_custkey)))) AS subject, sha256(unhex('02010100000008') || unhex(printf('%016X', c_custkey))) AS key_digest FROM customer""")
def identity_subject(spark, t):  # noqa: ANN001, ANN201
    key = [(F.col("c_custkey"), "bigint")]
    return t("customer").select("c_custkey", F.lower(F.hex(identity.canonical_subject(key))).alias("subject"), F.sha2(identity.canonical_tuple(key), 256).alias("key_digest"))


@query("""SELECT o_orderkey, sha256('v1:' || o_orderkey || ':' || 1 || ':ACTIVATE:' || 0) AS event_key FROM orders""")
def identity_event_key(spark, t):  # noqa: ANN001, ANN201
    return t("orders").select("o_orderkey", identity.event_key(F.lit("v1"), F.col("o_orderkey").cast("string"), F.lit(1), F.lit("ACTIVATE"), F.lit(0)).alias("event_key"))


# Lifecycle: yesterday's matches against today's. Orders up to 1998 are the state, up to 1999 the matches; finished ones leave.

_OLD = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_totalprice > 100000"
_NEW = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_totalprice > 100000 AND o_orderstatus <> 'F'"
_ADVANCED = f"""SELECT o_orderkey, CASE WHEN o.p IS NULL THEN 'ACTIVATE' WHEN n.p IS NULL THEN 'DEACTIVATE' WHEN o.price IS DISTINCT FROM n.price OR o.cust IS DISTINCT FROM n.cust THEN 'CHANGE' END AS kind,
n.p IS NOT NULL AS active, n.price AS new_price, o.price AS old_price
FROM (SELECT o_orderkey, o_custkey AS cust, o_totalprice AS price, 1 AS p FROM ({_OLD})) o FULL JOIN (SELECT o_orderkey, o_custkey AS cust, o_totalprice AS price, 1 AS p FROM ({_NEW})) n USING (o_orderkey)"""


def _snapshots(t) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    base = t("orders").filter("o_totalprice > 100000")
    old = base.filter("o_orderdate < TIMESTAMP_NTZ '1999-01-01'").select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = base.filter("o_orderdate < TIMESTAMP_NTZ '2000-01-01' AND o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", price.alias("o_totalprice"))
    return old, new


@query(f"SELECT o_orderkey, kind, CAST(1 AS BIGINT) AS generation, CAST(CASE WHEN kind = 'CHANGE' THEN 1 ELSE 0 END AS BIGINT) AS revision, coalesce(new_price, old_price) AS price FROM ({_ADVANCED}) WHERE kind IS NOT NULL")
def lifecycle_events(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    done = lifecycle.advance(lifecycle.seed(old, ["o_orderkey"]), new, ["o_orderkey"])
    return lifecycle.events(done, ["o_orderkey"]).select("o_orderkey", "kind", "generation", "revision", F.col("bindings.o_totalprice").alias("price"))


@query(f"SELECT o_orderkey, active, CAST(1 AS BIGINT) AS generation, CAST(CASE WHEN kind = 'CHANGE' THEN 1 ELSE 0 END AS BIGINT) AS revision, coalesce(new_price, old_price) AS price FROM ({_ADVANCED})")
def lifecycle_state(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    done = lifecycle.advance(lifecycle.seed(old, ["o_orderkey"]), new, ["o_orderkey"])
    return lifecycle.next_state(done, ["o_orderkey"]).select("o_orderkey", "active", "generation", "revision", F.col("bindings.o_totalprice").alias("price"))


@query(f"SELECT kind, count(*) AS n FROM ({_ADVANCED}) WHERE kind IN ('ACTIVATE', 'DEACTIVATE') GROUP BY kind")
def lifecycle_watched(spark, t):  # noqa: ANN001, ANN201
    """Only the customer is watched, and it never differs: no CHANGE."""
    old, new = _snapshots(t)
    done = lifecycle.advance(lifecycle.seed(old, ["o_orderkey"]), new, ["o_orderkey"], watched=["o_custkey"])
    return lifecycle.events(done, ["o_orderkey"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey, kind, CAST(2 AS BIGINT) AS generation FROM (SELECT o_orderkey, 'ACTIVATE' AS kind FROM ({_OLD}) ANTI JOIN ({_NEW}) USING (o_orderkey))""")
def lifecycle_reappear(spark, t):  # noqa: ANN001, ANN201
    """Back to the first snapshot: keys that had gone come as generation 2."""
    old, new = _snapshots(t)
    keys = ["o_orderkey"]
    gone = lifecycle.next_state(lifecycle.advance(lifecycle.seed(old, keys), new, keys), keys)
    return lifecycle.events(lifecycle.advance(gone, old, keys), keys).filter("kind = 'ACTIVATE'").select("o_orderkey", "kind", "generation")


@query(f"SELECT o_orderkey, kind FROM ({_ADVANCED}) WHERE kind = 'CHANGE' UNION ALL SELECT o_orderkey, kind FROM ({_ADVANCED}) WHERE kind = 'DEACTIVATE'")
def lifecycle_idempotent(spark, t):  # noqa: ANN001, ANN201
    """With the activations in the ledger already, a repeated pass adds the rest."""
    old, new = _snapshots(t)
    keys = ["o_orderkey"]
    emitted = lifecycle.events(lifecycle.advance(lifecycle.seed(old, keys), new, keys), keys)
    return lifecycle.unseen(emitted, emitted.filter("kind = 'ACTIVATE'"), keys).select("o_orderkey", "kind")


@query("""WITH p AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) - 19723 AS day FROM events WHERE event_type = 'error'),
g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM p WHERE day BETWEEN 0 AND 29),
r AS (SELECT user_id, min(day) AS a, max(day) AS b, row_number() OVER (PARTITION BY user_id ORDER BY min(day)) AS generation FROM g GROUP BY user_id, k)
SELECT user_id, generation, a AS day, 'ACTIVATE' AS kind FROM r UNION ALL SELECT user_id, generation, b + 1, 'DEACTIVATE' FROM r WHERE b + 1 <= 29""")
def lifecycle_multi_epoch(spark, t):  # noqa: ANN001, ANN201
    day = times.ordinal(times.epoch_micros(F.col("ts")), DAY) - 19723
    return lifecycle.epochs(t("events").filter("event_type = 'error'").select("user_id", day.alias("day")), ["user_id"], "day", 0, 29)


# Agenda: orders are episodes; priority is salience, the customer the conflict key.

_NOW = 946_684_800 * times.SECOND  # 2000-01-01
_EPISODES = f"""SELECT o_orderkey AS episode_id, o_custkey AS conflict_key, CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS salience, epoch_us(o_orderdate) AS available_at,
CASE WHEN o_orderkey % 97 = 0 THEN 'LEASED' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'P' THEN 'RETRY_WAIT' ELSE 'PENDING' END AS state, {_NOW} + 1 AS lease_until, o_orderkey % 5 AS rule_version, CASE WHEN o_orderkey % 2 = 0 THEN 'ACTIVATE' ELSE 'CHANGE' END AS kind FROM orders"""
_CLAIMABLE = f"""e AS ({_EPISODES}),
due AS (SELECT * FROM e WHERE state IN ('PENDING', 'RETRY_WAIT') AND available_at <= {_NOW} AND conflict_key NOT IN (SELECT conflict_key FROM e WHERE state = 'LEASED')),
c AS (SELECT *, CASE WHEN available_at <= {_NOW - agenda.FAIRNESS} THEN 0 ELSE 1 END AS fresh FROM due),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conflict_key ORDER BY fresh, available_at, salience DESC, episode_id) AS k FROM c) WHERE k = 1)"""


def _episodes(t) -> DataFrame:  # noqa: ANN001
    state = F.when(F.col("o_orderkey") % 97 == 0, "LEASED").when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "RETRY_WAIT").otherwise("PENDING")
    return t("orders").select(
        F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("conflict_key"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("salience"), times.epoch_micros(F.col("o_orderdate")).alias("available_at"),
        state.alias("state"), F.lit(_NOW + 1).alias("lease_until"), (F.col("o_orderkey") % 5).alias("rule_version"), F.when(F.col("o_orderkey") % 2 == 0, "ACTIVATE").otherwise("CHANGE").alias("kind"),
    )


@query(f"WITH {_CLAIMABLE} SELECT episode_id, conflict_key, salience, available_at FROM f ORDER BY fresh, available_at, salience DESC, episode_id LIMIT 100")
def agenda_claim_order(spark, t):  # noqa: ANN001, ANN201
    return agenda.claim(_episodes(t), _NOW, 100).select("episode_id", "conflict_key", "salience", "available_at")


@query(f"WITH {_CLAIMABLE} SELECT conflict_key, episode_id FROM f")
def agenda_conflict_first(spark, t):  # noqa: ANN001, ANN201
    return agenda.claimable(_episodes(t), _NOW).select("conflict_key", "episode_id")


@query(f"""WITH {_CLAIMABLE}, one AS (SELECT rule_version, kind FROM f ORDER BY fresh, available_at, salience DESC, episode_id LIMIT 1)
SELECT episode_id, rule_version, kind FROM f JOIN one USING (rule_version, kind) ORDER BY fresh, available_at, salience DESC, episode_id LIMIT 32""")
def agenda_batch_claim(spark, t):  # noqa: ANN001, ANN201
    return agenda.claim_batch(_episodes(t), _NOW, 32).select("episode_id", "rule_version", "kind")


@query(f"""WITH a AS ({_ADVANCED})
SELECT o_orderkey, kind, CASE kind WHEN 'ACTIVATE' THEN active WHEN 'CHANGE' THEN o_orderkey % 3 = 0 ELSE true END AS eligible FROM a WHERE kind IS NOT NULL""")
def agenda_recheck(spark, t):  # noqa: ANN001, ANN201
    """Changes of two in three orders have been followed by a further one."""
    old, new = _snapshots(t)
    keys = ["o_orderkey"]
    done = lifecycle.advance(lifecycle.seed(old, keys), new, keys)
    later = F.when((F.col("kind") == "CHANGE") & (F.col("o_orderkey") % 3 != 0), 1).otherwise(0)
    state = done.withColumn("revision", F.col("revision") + later).select(*keys, "active", "generation", "revision")
    return agenda.recheck(lifecycle.events(done, keys), state, keys).select("o_orderkey", "kind", "eligible")


@query("""SELECT o_orderkey, attempt, CAST(least(600, floor(5 * pow(2.0, attempt - 1) + 0.5)) AS INTEGER) AS wait FROM (SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS BIGINT) AS attempt FROM orders)""")
def retry_backoff(spark, t):  # noqa: ANN001, ANN201
    rows = t("orders").select("o_orderkey", (F.col("o_orderkey") % 12 + 1).alias("attempt"))
    return rows.select("o_orderkey", "attempt", times.backoff(F.col("attempt"), 5, 2.0, 600).alias("wait"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'SKIPPED' WHEN o_orderkey % 4 <> 0 THEN 'DONE' WHEN o_orderkey % 8 = 0 OR a >= 5 THEN 'FAILED' ELSE 'RETRY_WAIT' END AS next_state,
CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 AND a < 5 THEN {_NOW} + CAST(least(600, 5 * pow(2, a - 1)) AS BIGINT) * 1000000 END AS retry_at FROM (SELECT o_orderkey, o_orderkey % 6 + 1 AS a FROM orders)""")
def agenda_settle(spark, t):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    rows = t("orders").select(k, (k % 11 != 0).alias("eligible"), F.when(k % 8 == 0, "42P01").when(k % 4 == 0, "40001").alias("error"), (k % 6 + 1).alias("attempt"))
    return agenda.settle(rows, _NOW, 5, 2.0, 600, 5).select("o_orderkey", "next_state", "retry_at")


@query(f"WITH e AS ({_EPISODES}) SELECT episode_id, CASE WHEN state = 'LEASED' THEN 'RETRY_WAIT' ELSE state END AS state, CASE WHEN state = 'LEASED' THEN {_NOW} + 5 ELSE available_at END AS available_at FROM e")
def agenda_sweep(spark, t):  # noqa: ANN001, ANN201
    return agenda.sweep(_episodes(t), _NOW + 5).select("episode_id", "state", "available_at")


@query(f"WITH e AS ({_EPISODES}) SELECT state, count(*) AS n FROM (SELECT CASE WHEN rule_version = 3 AND state IN ('PENDING', 'RETRY_WAIT') THEN 'CANCELLED' ELSE state END AS state FROM e) GROUP BY state")
def rule_replace(spark, t):  # noqa: ANN001, ANN201
    return agenda.replace_version(_episodes(t), 3, "CANCEL_OLD").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH e AS ({_EPISODES}) SELECT rule_version, count(*) AS pending FROM e WHERE state IN ('PENDING', 'RETRY_WAIT') GROUP BY 1 HAVING count(*) >= 500")
def agenda_backpressure(spark, t):  # noqa: ANN001, ANN201
    return agenda.backpressure(_episodes(t), 500)


@query("SELECT * FROM (VALUES ('MIXED_VERSION'), ('MIXED_EVENT'), ('INCOMPATIBLE_CONFLICT'), ('INELIGIBLE_EPISODE'), ('OVERSIZED_OR_EMPTY')) v(code)")
def agenda_batch_rejections(spark, t):  # noqa: ANN001, ANN201
    """All episodes at once are no batch, for every reason there is."""
    return agenda.batch_rejections(_episodes(t))


# Sharing


@query("SELECT * FROM (SELECT 'large' AS condition, count(*) AS \"rows\" FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'), (SELECT count(DISTINCT n_regionkey) AS consumers, count(DISTINCT n_regionkey) > 3 AS over_limit FROM nation)")
def shared_condition_cost(spark, t):  # noqa: ANN001, ANN201
    shared = {"large": t("orders").filter("o_totalprice > 300000"), "open": t("orders").filter("o_orderstatus = 'O'")}
    consumers = t("nation").select(F.explode(F.array(F.lit("large"), F.lit("open"))).alias("condition"), F.col("n_regionkey").alias("consumer"))
    return sharing.cost(shared, consumers, 3)


@query(f"""SELECT sha256('orders:' || o_orderkey || ':1:' || kind || ':' || CASE WHEN kind = 'CHANGE' THEN 1 ELSE 0 END) AS idempotency_key,
'{{"envelope_version":1,"rule":"orders","o_orderkey":' || o_orderkey || ',"kind":"' || kind || '","generation":1,"revision":' || CASE WHEN kind = 'CHANGE' THEN 1 ELSE 0 END || '}}' AS body FROM ({_ADVANCED}) WHERE kind IS NOT NULL""")
def outbox_envelope(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    emitted = lifecycle.events(lifecycle.advance(lifecycle.seed(old, ["o_orderkey"]), new, ["o_orderkey"]), ["o_orderkey"])
    return sharing.envelopes(emitted, ["o_orderkey"], "orders")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def key_sync(spark, t):  # noqa: ANN001, ANN201
    """Surrogates of rich customers, back to their public keys."""
    parts = [("c_custkey", "bigint"), ("c_mktsegment", "text")]
    key = identity.surrogate(identity.canonical_tuple([(F.col(c), k) for c, k in parts]))
    return sharing.public_keys(t("customer").filter("c_acctbal > 9000").select(key.alias("surrogate")), t("customer"), parts).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 101")
def explanation_page(spark, t):  # noqa: ANN001, ANN201
    return sharing.page(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 100)


# Derivation


@query("SELECT l_partkey, count(*) AS support_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey")
def derived_support_count(spark, t):  # noqa: ANN001, ANN201
    rows = t("lineitem").filter("l_returnflag = 'R'").select("l_partkey", F.lit("RETURNED").alias("reason"))
    return derive.derived(rows, ["l_partkey"]).select("l_partkey", "support_count")


@query("SELECT l_partkey, count(*) AS support_count, min(l_linestatus) IS DISTINCT FROM max(l_linestatus) AS conflict FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey")
def derived_conflict(spark, t):  # noqa: ANN001, ANN201
    return derive.derived(t("lineitem").filter("l_quantity > 45").select("l_partkey", "l_linestatus"), ["l_partkey"])


def _program() -> derive.Program:
    """a -> b -> c -> b, seeded by two sources; eligible: c, and not blocked."""
    return derive.Program(
        (
            derive.Rule("a_seed", "a", "big_spenders"),
            derive.Rule("b_from_a", "b", "customers", ("a",)),
            derive.Rule("b_from_c", "b", "customers", ("c",)),
            derive.Rule("c_seed", "c", "large_orders"),
            derive.Rule("c_from_b", "c", "customers", ("b",)),
            derive.Rule("blocked", "blocked", "debtors"),
            derive.Rule("eligible", "eligible", "customers", ("c",), ("blocked",)),
        ),
        ("c_custkey",),
    )


def _program_sources(t) -> dict[str, DataFrame]:  # noqa: ANN001
    customers = t("customer")
    return {
        "customers": customers.select("c_custkey"),
        "big_spenders": customers.filter("c_acctbal > 9000").select("c_custkey"),
        "debtors": customers.filter("c_acctbal < 0").select("c_custkey"),
        "large_orders": t("orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).join(customers.select("c_custkey"), "c_custkey", "left_semi"),
    }


_REACHED = "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"


@query(f"SELECT 'a' AS relation, c_custkey FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'b', c_custkey FROM ({_REACHED}) UNION ALL SELECT 'c', c_custkey FROM ({_REACHED})")
def recursive_program(spark, t):  # noqa: ANN001, ANN201
    facts = derive.evaluate(_program(), _program_sources(t))
    rows = [facts[n].select(F.lit(n).alias("relation"), "c_custkey") for n in ("a", "b", "c")]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"SELECT c_custkey FROM ({_REACHED}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def stratified_negation(spark, t):  # noqa: ANN001, ANN201
    return derive.evaluate(_program(), _program_sources(t))["eligible"]


@query("SELECT * FROM (VALUES ('a', 0::BIGINT, 0::BIGINT), ('b', 2, 0), ('c', 2, 0), ('blocked', 1, 0), ('eligible', 3, 1)) v(relation, component, stratum)")
def program_components(spark, t):  # noqa: ANN001, ANN201
    p = _program()
    strata = p.strata()
    return spark.createDataFrame([(n, k, strata[n]) for k, part in enumerate(p.components()) for n in part], "relation string, component long, stratum long")


def _aggregate(fn: str, sql: str, op: str, threshold: float, column: str | None = "l_quantity") -> None:
    compared = f"coalesce(CAST({sql} AS DOUBLE) {op} {threshold}, false)"

    def run(spark, t):  # noqa: ANN001, ANN202
        groups = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
        found = derive.aggregate_truth(groups, t("lineitem").filter("l_discount > 0.02"), ["l_orderkey"], derive.Aggregate("lines", fn, column, op, threshold))
        return found.select("l_orderkey", F.col("value").cast("double").alias("value"), "truth")

    run.__name__ = f"aggregate_{fn}"
    value = f"coalesce({sql}, 0)" if fn.startswith("count") else sql
    query(f"SELECT g.o_orderkey AS l_orderkey, CAST({value} AS DOUBLE) AS value, {compared.replace(sql, value)} AS truth FROM orders g LEFT JOIN (SELECT * FROM lineitem WHERE l_discount > 0.02) i ON g.o_orderkey = i.l_orderkey WHERE o_orderstatus <> 'P' GROUP BY g.o_orderkey")(run)


_aggregate("count_star", "count(i.l_orderkey)", ">=", 3, None)
_aggregate("count", "count(i.l_quantity)", "=", 2)
_aggregate("sum", "sum(i.l_quantity)", ">", 100)
_aggregate("min", "min(i.l_quantity)", "<", 5)
_aggregate("max", "max(i.l_quantity)", "<=", 20)


@query("""WITH a AS (SELECT l_orderkey, count(*) AS v FROM lineitem WHERE l_quantity > 20 GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS v FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(b.v, 0) AS value, '>=' AS comparison, 2 AS threshold, coalesce(b.v, 0) >= 2 AS truth, CAST(CASE WHEN coalesce(a.v, 0) = coalesce(b.v, 0) AND o_orderkey % 3 <> 0 THEN 1 ELSE 2 END AS BIGINT) AS lower_frontier
FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def aggregate_evidence(spark, t):  # noqa: ANN001, ANN201
    groups, rule = t("orders").select(F.col("o_orderkey").alias("l_orderkey")), derive.Aggregate("lines", "count_star", None, ">=", 2)
    value = lambda where: derive.aggregate_truth(groups, t("lineitem").filter(where), ["l_orderkey"], rule)
    prior = value("l_quantity > 20").withColumn("lower_frontier", F.lit(1).cast("bigint"))
    # Every third order had another threshold, which its truth may not show.
    prior = prior.withColumn("threshold", F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("threshold")))
    return derive.evidence(prior, value("l_quantity > 30"), ["l_orderkey"], 2)


@query("""WITH a AS (SELECT l_orderkey, count(*) AS v FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING_AGGREGATE_EVIDENCE' WHEN o_orderkey % 5 = 1 THEN 'EXTRA_AGGREGATE_EVIDENCE' WHEN o_orderkey % 5 = 2 THEN 'WRONG_AGGREGATE_EVIDENCE' ELSE 'INVALID_AGGREGATE_FRONTIER' END AS problem
FROM orders WHERE o_orderkey % 5 < 4 UNION ALL SELECT o_orderkey, 'STALE_AGGREGATE_EVIDENCE' FROM orders JOIN a ON l_orderkey = o_orderkey WHERE o_orderkey % 5 = 4 AND v > 2""")
def reconcile_codes(spark, t):  # noqa: ANN001, ANN201
    """Evidence that is lost, left over, changed, of a pass to come, or older than what it says."""
    groups, rule, k = t("orders").select(F.col("o_orderkey").alias("l_orderkey")), derive.Aggregate("lines", "count_star", None, ">=", 2), F.col("l_orderkey") % 5
    now = derive.aggregate_truth(groups, t("lineitem").filter("l_quantity > 30"), ["l_orderkey"], rule)
    expected = now.withColumn("lower_frontier", F.when(F.col("value") > 2, 2).otherwise(1).cast("bigint"))
    stored = expected.withColumn("lower_frontier", F.when(k == 3, 9).when(k == 4, 1).otherwise(F.col("lower_frontier"))).withColumn("value", F.col("value") + F.when(k == 2, 1).otherwise(0))
    return derive.evidence_problems(stored.filter(k != 0), expected.filter(k != 1), ["l_orderkey"], 2)


@query("""SELECT c_custkey FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND n >= 1""")
def aggregate_derived(spark, t):  # noqa: ANN001, ANN201
    """A threshold over a relation that the program itself derives: big is derived, busy counts it, calm takes debtors away."""
    rules = (derive.Rule("big", "big", "large_orders"), derive.Rule("busy", "busy", "customers", aggregate=derive.Aggregate("big", "count_star", None, ">=", 1)), derive.Rule("owing", "owing", "debtors"), derive.Rule("calm", "calm", "customers", ("busy",), ("owing",)))
    customers = t("customer").select("c_custkey", "c_acctbal")
    large = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).join(customers.select("c_custkey"), "c_custkey", "left_semi")
    return derive.evaluate(derive.Program(rules, ("c_custkey",)), {"customers": customers.select("c_custkey"), "debtors": customers.filter("c_acctbal < 0").select("c_custkey"), "large_orders": large})["calm"]


@query(f"SELECT 'eligible' AS rule, 'blocked' AS relation, c_custkey, 0 AS stratum FROM ({_REACHED}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def negative_evidence(spark, t):  # noqa: ANN001, ANN201
    sources = _program_sources(t)
    return derive.negative_evidence(_program(), derive.evaluate(_program(), sources), sources)


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 1 THEN 'MISSING' ELSE 'EXTRA' END AS problem FROM customer WHERE (c_custkey % 2 = 1 AND c_custkey % 3 = 0) OR (c_custkey % 2 = 0 AND c_custkey % 3 <> 0)) GROUP BY problem")
def derived_reconcile(spark, t):  # noqa: ANN001, ANN201
    keys = t("customer").select("c_custkey")
    return derive.invalid(keys.filter("c_custkey % 2 = 0"), keys.filter("c_custkey % 3 = 0"), ["c_custkey"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# Event time

_HOURS = "SELECT user_id, CAST(floor(epoch_us(ts) / 21600000000.0) AS BIGINT) AS \"window\", CAST(value AS DECIMAL(18,2)) AS v FROM events"
WIDTH, LATENESS = 6 * HOUR, HOUR


def _staged(t, rows=None) -> DataFrame:  # noqa: ANN001
    events = (t("events") if rows is None else rows).withColumn("v", F.col("value").cast("decimal(18,2)"))
    return windows.stage(events, ["user_id"], "ts", WIDTH, ["v"])


@query(f'SELECT user_id, "window", count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM ({_HOURS}) GROUP BY ALL')
def tumbling_window(spark, t):  # noqa: ANN001, ANN201
    staged = _staged(t)
    return staged.groupBy("user_id", "window").agg(F.sum("occurrences").alias("n"), F.sum(F.col("v") * F.col("occurrences")).cast("double").alias("total"))


@query(f'SELECT user_id, "window", CAST(sum(v) AS DOUBLE) AS value FROM ({_HOURS}) GROUP BY ALL HAVING sum(v) >= 120')
def window_threshold(spark, t):  # noqa: ANN001, ANN201
    return windows.measure(_staged(t), ["user_id"], "sum", "v").filter("value >= 120").withColumn("value", F.col("value").cast("double"))


@query(f'SELECT user_id, "window", count(*) AS n, count(v) AS c, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM ({_HOURS}) GROUP BY ALL')
def window_measures(spark, t):  # noqa: ANN001, ANN201
    staged, out = _staged(t), None
    for fn, name in (("count_star", "n"), ("count", "c"), ("min", "low"), ("max", "high")):
        one = windows.measure(staged, ["user_id"], fn, None if fn == "count_star" else "v").withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["user_id", "window"])
    return out.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double")})


_BEFORE = _HOURS + " WHERE event_id % 10 <> 3"
_AFTER = _HOURS + " WHERE event_id % 10 <> 7"


def _passes(t) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Two passes: in between, one event in ten has come and one in ten has gone."""
    events = t("events")
    return _staged(t, events.filter("event_id % 10 <> 3")), _staged(t, events.filter("event_id % 10 <> 7"))


_CHANGED = f'SELECT DISTINCT user_id, "window" FROM (SELECT user_id, "window" FROM ({_HOURS} WHERE event_id % 10 IN (3, 7)))'


@query(f"""WITH c AS ({_CHANGED}), b AS (SELECT user_id, "window", count(*) AS n FROM ({_BEFORE}) GROUP BY ALL), a AS (SELECT user_id, "window", count(*) AS n FROM ({_AFTER}) GROUP BY ALL)
SELECT user_id, "window", b.n AS "before", a.n AS "after", coalesce(b.n >= 2, false) AS was_true, coalesce(a.n >= 2, false) AS is_true,
CASE WHEN coalesce(a.n >= 2, false) AND NOT coalesce(b.n >= 2, false) THEN 'ACTIVATE' WHEN coalesce(b.n >= 2, false) AND NOT coalesce(a.n >= 2, false) THEN 'DEACTIVATE' END AS event
FROM c LEFT JOIN b USING (user_id, "window") LEFT JOIN a USING (user_id, "window")""")
def window_corrections(spark, t):  # noqa: ANN001, ANN201
    before, after = _passes(t)
    count = lambda df: windows.measure(df, ["user_id"], "count_star")
    return windows.corrections(count(before), count(after), windows.affected(before, after, ["user_id"]), ["user_id"], lambda v: v >= 2)


@query(f'SELECT user_id, "window", ("window" + 1) * {WIDTH} + {LATENESS} AS boundary FROM (SELECT DISTINCT user_id, "window" FROM ({_HOURS})) WHERE ("window" + 1) * {WIDTH} + {LATENESS} > {START + 5 * DAY} AND ("window" + 1) * {WIDTH} + {LATENESS} <= {START + 12 * DAY}')
def window_finalize(spark, t):  # noqa: ANN001, ANN201
    return windows.finalizations(_staged(t).select("user_id", "window").distinct(), WIDTH, LATENESS, START + 5 * DAY, START + 12 * DAY)


@query(f'SELECT user_id, "window" FROM ({_CHANGED}) WHERE ("window" + 1) * {WIDTH} + {LATENESS} <= {START + 3 * DAY}')
def window_late(spark, t):  # noqa: ANN001, ANN201
    before, after = _passes(t)
    return windows.late(windows.affected(before, after, ["user_id"]), WIDTH, LATENESS, START + 3 * DAY)


_HISTORY = 'SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS "window", epoch_us(ts) AS frontier FROM events'


@query(f"""SELECT event_id, user_id, "window" FROM (SELECT *, max(frontier) OVER (PARTITION BY user_id, "window") AS newest FROM ({_HISTORY})) WHERE frontier < newest AND frontier < {START + 20 * DAY} AND "window" < 19723 + 10""")
def window_prune(spark, t):  # noqa: ANN001, ANN201
    us = times.epoch_micros(F.col("ts"))
    history = t("events").select("event_id", "user_id", times.ordinal(us, DAY).alias("window"), us.alias("frontier"))
    final = history.filter(F.col("window") < 19723 + 10).select("user_id", "window").distinct()
    return windows.prune(history, ["user_id", "window"], final, START + 20 * DAY).select("event_id", "user_id", "window")


# Deadlines and conditions over time

_DUE = 946_684_800 * times.SECOND
_DEADLINES = "SELECT o_orderkey, epoch_us(o_orderdate) + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 86400000000 AS deadline FROM orders"


def _deadlines(t) -> DataFrame:  # noqa: ANN001
    return t("orders").select("o_orderkey", (times.epoch_micros(F.col("o_orderdate")) + F.substring("o_orderpriority", 1, 1).cast("bigint") * DAY).alias("deadline"))


@query(f"SELECT o_orderkey, deadline FROM ({_DEADLINES}) WHERE deadline <= {_DUE}")
def deadline_due(spark, t):  # noqa: ANN001, ANN201
    return temporal.due(_deadlines(t), "deadline", _DUE)


@query(f"SELECT o_orderkey, deadline FROM ({_DEADLINES}) WHERE deadline > {_DUE - 7 * DAY} AND deadline <= {_DUE}")
def deadline_crossing(spark, t):  # noqa: ANN001, ANN201
    return temporal.crossing(_deadlines(t), "deadline", _DUE - 7 * DAY, _DUE)


#: Every day of the events table.
FRONTIERS = [START + d * DAY for d in range(30)]


def _inputs(t) -> DataFrame:  # noqa: ANN001
    """Per user and day: truth, an error that day; recovered, a signup; deadline, two days on."""
    day = times.ordinal(times.epoch_micros(F.col("ts")), DAY) * DAY
    return t("events").groupBy("user_id", day.alias("frontier")).agg(
        F.bool_or(F.col("event_type") == "error").alias("truth"), F.bool_or(F.col("event_type") == "signup").alias("recovered"), (F.max(day) + 2 * DAY).alias("deadline")
    )


def _replayed(step: str, status: str, active: str, at: str) -> str:
    """The fold as a chain of queries, one a frontier: given the prior p, the input g and the frontier f."""
    given = "SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) * 86400000000 AS frontier, bool_or(event_type = 'error') AS truth, bool_or(event_type = 'signup') AS recovered, max(CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) * 86400000000) + 172800000000 AS deadline FROM events GROUP BY ALL"
    parts = [f"g AS MATERIALIZED ({given})", f"k AS (SELECT DISTINCT user_id FROM g WHERE frontier IN ({', '.join(map(str, FRONTIERS))}))", "s0 AS (SELECT user_id, false AS active, NULL::BIGINT AS since, 0::BIGINT AS generation FROM k)"]
    for n, f in enumerate(FRONTIERS, 1):
        parts.append(f"i{n} AS (SELECT user_id, p.active AS was, p.since AS since, p.generation AS generation, coalesce(truth, false) AS truth, coalesce(recovered, false) AS recovered, deadline, {f}::BIGINT AS f FROM s{n - 1} p LEFT JOIN (SELECT * FROM g WHERE frontier = {f}) USING (user_id))")
        parts.append(f"j{n} AS (SELECT *, {at} AS upto FROM i{n})")
        parts.append(f"m{n} AS (SELECT *, coalesce({active}, false) AS now FROM j{n})")
        parts.append(f"s{n} AS MATERIALIZED (SELECT user_id, f AS frontier, {status} AS status, now AS active, upto AS since, generation + CASE WHEN now AND NOT was THEN 1 ELSE 0 END AS generation, CASE WHEN now AND NOT was THEN 'ACTIVATE' WHEN was AND NOT now THEN 'DEACTIVATE' END AS event FROM m{n})")
    union = " UNION ALL ".join(f'SELECT user_id, frontier, status, active, since AS "at", generation, event FROM s{n}' for n in range(1, len(FRONTIERS) + 1))
    return f"WITH {', '.join(parts)} {union}"


@query(_replayed("duration", "CASE WHEN now THEN 'ACTIVE' WHEN truth THEN 'PENDING' ELSE 'WAITING' END", "truth AND upto <= f", f"CASE WHEN truth THEN coalesce(since, f + {DAY}) END"))
def temporal_duration(spark, t):  # noqa: ANN001, ANN201
    return temporal.replay(_inputs(t), ["user_id"], "frontier", FRONTIERS, temporal.duration(DAY))


@query(_replayed("absence", "CASE WHEN truth OR upto IS NULL THEN 'WAITING' WHEN now THEN 'ACTIVE' ELSE 'PENDING' END", "NOT truth AND upto <= f", "CASE WHEN truth THEN deadline ELSE since END"))
def temporal_absence(spark, t):  # noqa: ANN001, ANN201
    return temporal.replay(_inputs(t), ["user_id"], "frontier", FRONTIERS, temporal.absence())


@query(_replayed("cooldown", "CASE WHEN now THEN 'ACTIVE' WHEN upto IS NOT NULL THEN 'COOLDOWN' ELSE 'WAITING' END", "truth AND (was OR NOT coalesce(since > f, false))", f"CASE WHEN NOT truth AND was THEN f + {2 * DAY} WHEN NOT was AND since > f THEN since END"))
def temporal_cooldown(spark, t):  # noqa: ANN001, ANN201
    return temporal.replay(_inputs(t), ["user_id"], "frontier", FRONTIERS, temporal.cooldown(2 * DAY))


@query(_replayed("hysteresis", "CASE WHEN was AND recovered THEN 'RECOVERED' WHEN now THEN 'ACTIVE' WHEN recovered THEN 'RECOVERED' ELSE 'ARMED' END", "(was AND NOT recovered) OR (NOT was AND truth)", "NULL::BIGINT"))
def temporal_hysteresis(spark, t):  # noqa: ANN001, ANN201
    return temporal.replay(_inputs(t), ["user_id"], "frontier", FRONTIERS, temporal.hysteresis())


# Effective dating and parameters: each market segment has three versions of a limit.

_VERSIONS = "SELECT c_mktsegment, v AS version, TIMESTAMP '1995-01-01' + to_years(CAST((v - 1) * 2 AS INTEGER)) AS valid_from, CASE WHEN v < 3 THEN TIMESTAMP '1995-01-01' + to_years(CAST(v * 2 AS INTEGER)) END AS valid_to, CAST(v * 100000 AS BIGINT) AS price_limit FROM (SELECT DISTINCT c_mktsegment FROM customer), (VALUES (1), (2), (3)) x(v)"


def _versions(spark, t) -> DataFrame:  # noqa: ANN001
    bounds = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(a).cast("timestamp_ntz").alias("valid_from"), F.lit(b).cast("timestamp_ntz").alias("valid_to"), F.lit(v * 100_000).cast("bigint").alias("price_limit")) for v, a, b in ((1, "1995-01-01", "1997-01-01"), (2, "1997-01-01", "1999-01-01"), (3, "1999-01-01", None))))
    return t("customer").select("c_mktsegment").distinct().select("c_mktsegment", F.explode(bounds).alias("v")).select("c_mktsegment", "v.*")


@query(f"""SELECT o_orderkey, version, price_limit FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({_VERSIONS}) USING (c_mktsegment)
WHERE o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to) AND o_totalprice > price_limit""")
def effective_version_asof(spark, t):  # noqa: ANN001, ANN201
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "o_orderdate", "c_mktsegment")
    return effective.as_of(rows, _versions(spark, t), ["c_mktsegment"], "o_orderdate").filter("o_totalprice > price_limit").select("o_orderkey", "version", "price_limit")


@query("SELECT c_custkey, version FROM (SELECT c_custkey, v AS version FROM customer, (VALUES (1), (2), (3)) x(v) WHERE v <= 1 + c_custkey % 3) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY version DESC) = 1")
def effective_authority(spark, t):  # noqa: ANN001, ANN201
    """Versions start at 10, 20 and 30; a customer has one to three of them; the frontier is 35."""
    rows = t("customer").select("c_custkey", F.explode(F.sequence(F.lit(1), (1 + F.col("c_custkey") % 3).cast("int"))).alias("version"))
    rows = rows.select("c_custkey", (F.col("version") * 10).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"), "version")
    return effective.authority(rows, ["c_custkey"], 35).select("c_custkey", "version")


@query("SELECT c_custkey, 2 AS version, CASE WHEN c_custkey % 3 = 0 THEN 'OVERLAP' ELSE 'EMPTY' END AS code FROM customer WHERE c_custkey % 3 < 2")
def effective_rejected(spark, t):  # noqa: ANN001, ANN201
    """Second versions that start inside the first, or end where they start."""
    k = F.col("c_custkey") % 3
    first = F.struct(F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("valid_from"), F.lit(10).cast("bigint").alias("valid_to"))
    second = F.struct(F.lit(2).alias("version"), F.when(k == 0, 5).otherwise(10).cast("bigint").alias("valid_from"), F.when(k == 1, 10).otherwise(20).cast("bigint").alias("valid_to"))
    rows = t("customer").select("c_custkey", F.explode(F.array(first, second)).alias("v")).select("c_custkey", "v.*")
    return effective.rejected(rows, ["c_custkey"])


@query("""SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'PAUSED' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'FUTURE' WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN 'EXPIRED' ELSE 'CURRENT' END AS state, count(*) AS n FROM orders GROUP BY ALL""")
def effective_state(spark, t):  # noqa: ANN001, ANN201
    """Orders as versions of a year less a day each, seen on the first day of 1998."""
    start = F.col("o_orderdate")
    state = effective.state_at(F.lit("1998-01-01").cast("timestamp_ntz"), start, start + F.expr("INTERVAL 365 DAYS"), F.when(F.col("o_orderkey") % 7 == 0, "PAUSED").otherwise("ACTIVE"))
    return t("orders").select("o_custkey", state.alias("state")).groupBy("o_custkey", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, 'DEACTIVATE' AS kind, 'OLD' AS side FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'ACTIVATE', 'NEW' FROM orders WHERE o_totalprice > 350000 AND o_orderstatus = 'O'")
def effective_switch(spark, t):  # noqa: ANN001, ANN201
    old = lifecycle.seed(t("orders").filter("o_totalprice > 400000").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return effective.switch(old, t("orders").filter("o_totalprice > 350000 AND o_orderstatus = 'O'"), ["o_orderkey"])


@query("SELECT o_orderkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= (n_nationkey + 1) * 15000")
def parameter_family_join(spark, t):  # noqa: ANN001, ANN201
    family = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", ((F.col("n_nationkey") + 1) * 15000).alias("least"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return effective.parameters(rows, family, ["c_nationkey"]).filter("o_totalprice >= least").select("o_orderkey", "n_name", "o_totalprice")


# Decisions: the order is the subject, the supplier the candidate, the discount its priority.

_CANDIDATES = "SELECT l_orderkey AS subject, l_suppkey AS candidate, CAST(min(round(l_discount * 100)) AS BIGINT) AS priority, CAST(max(l_quantity) AS BIGINT) AS quantity FROM lineitem {where} GROUP BY ALL"
_ALL, _SOME = _CANDIDATES.format(where=""), _CANDIDATES.format(where="WHERE l_linestatus = 'O' OR l_partkey % 2 = 0")
_OUTCOME = """SELECT subject, CASE WHEN count(*) = 1 THEN 'WINNER' ELSE 'AMBIGUOUS' END AS state, CASE WHEN count(*) = 1 THEN min(candidate) END AS candidate, any_value(priority) AS priority, CASE WHEN count(*) = 1 THEN min(quantity) END AS quantity
FROM (SELECT *, min(priority) OVER (PARTITION BY subject) AS best FROM ({c})) WHERE priority = best GROUP BY subject"""


def _candidates(t, where: str | None = None) -> DataFrame:  # noqa: ANN001
    lines = t("lineitem").filter(where) if where else t("lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("subject"), F.col("l_suppkey").alias("candidate")).agg(F.min(F.round(F.col("l_discount") * 100)).cast("bigint").alias("priority"), F.max("l_quantity").cast("bigint").alias("quantity"))


_PART = "l_linestatus = 'O' OR l_partkey % 2 = 0"


@query(f"SELECT o_orderkey AS subject, coalesce(state, 'NO_CANDIDATE') AS state, candidate, priority, quantity FROM orders LEFT JOIN ({_OUTCOME.format(c=_SOME)}) ON o_orderkey = subject")
def decision_winner(spark, t):  # noqa: ANN001, ANN201
    return decisions.winners(_candidates(t, _PART), t("orders").select(F.col("o_orderkey").alias("subject")), ["quantity"])


@query(f"""SELECT subject, candidate, priority, rank, truncated FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY priority, candidate) AS rank, count(*) OVER (PARTITION BY subject) > 3 AS truncated FROM ({_ALL})) WHERE rank <= 3""")
def decision_competitors(spark, t):  # noqa: ANN001, ANN201
    return decisions.competitors(_candidates(t), 3).select("subject", "candidate", "priority", F.col("rank").cast("bigint").alias("rank"), "truncated")


@query(f"""WITH a AS (SELECT *, 1::BIGINT AS generation, 0::BIGINT AS revision FROM ({_OUTCOME.format(c=_ALL)})), b AS ({_OUTCOME.format(c=_SOME)}),
j AS (SELECT subject, coalesce(a.state, 'NO_CANDIDATE') AS s0, coalesce(b.state, 'NO_CANDIDATE') AS s1, a.candidate AS c0, b.candidate AS c1, a.quantity AS q0, b.quantity AS q1, coalesce(generation, 0) AS g, coalesce(revision, 0) AS r FROM a FULL JOIN b USING (subject)),
s AS (SELECT *, coalesce(s0 = 'WINNER' AND s1 = 'WINNER' AND c0 = c1, false) AS same FROM j)
SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY place) - 1 AS INTEGER) AS step, kind, candidate, generation, revision FROM (
SELECT subject, 'WINNER_OUT' AS kind, c0 AS candidate, g AS generation, r AS revision, 1 AS place FROM s WHERE s0 = 'WINNER' AND NOT same
UNION ALL SELECT subject, 'AMBIGUITY_EXIT', c0, g, r, 2 FROM s WHERE s0 = 'AMBIGUOUS' AND s1 <> 'AMBIGUOUS'
UNION ALL SELECT subject, 'AMBIGUITY_ENTER', c1, g, r, 3 FROM s WHERE s1 = 'AMBIGUOUS' AND s0 <> 'AMBIGUOUS'
UNION ALL SELECT subject, 'WINNER_IN', c1, g + 1, 0, 4 FROM s WHERE s1 = 'WINNER' AND NOT same
UNION ALL SELECT subject, 'WINNER_REVISION', c1, g, r + 1, 5 FROM s WHERE same AND q0 IS DISTINCT FROM q1
UNION ALL SELECT subject, 'NO_CANDIDATE', c1, g, r, 6 FROM s WHERE s1 = 'NO_CANDIDATE' AND s0 <> 'NO_CANDIDATE')""")
def decision_lifecycle(spark, t):  # noqa: ANN001, ANN201
    before = decisions.winners(_candidates(t), results=["quantity"]).withColumns({"generation": F.lit(1).cast("bigint"), "revision": F.lit(0).cast("bigint")})
    return decisions.lifecycle(before, decisions.winners(_candidates(t, _PART), results=["quantity"]), ["quantity"])


@query("""SELECT 'DUPLICATE_CANDIDATE' AS code, l_orderkey AS subject, l_suppkey AS candidate FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def decision_violations(spark, t):  # noqa: ANN001, ANN201
    return decisions.violations(t("lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_suppkey").alias("candidate"), F.col("l_discount").alias("priority")))


# Coverage: orders are the population, suppliers the catalog.


@query(f"SELECT o_orderkey AS subject FROM orders WHERE o_orderkey NOT IN (SELECT subject FROM ({_SOME}))")
def coverage_uncovered(spark, t):  # noqa: ANN001, ANN201
    return coverage.uncovered(t("orders").select(F.col("o_orderkey").alias("subject")), _candidates(t, _PART))


@query("SELECT s_suppkey AS candidate FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
def coverage_unreachable(spark, t):  # noqa: ANN001, ANN201
    return coverage.unreachable(t("supplier").select(F.col("s_suppkey").alias("candidate")), _candidates(t, "l_quantity > 49 AND l_discount > 0.09"))


@query(f"SELECT subject, count(*) AS candidates FROM ({_ALL}) GROUP BY subject HAVING count(*) > 1")
def coverage_overlap(spark, t):  # noqa: ANN001, ANN201
    return coverage.overlaps(_candidates(t))


@query(f"SELECT subject, priority, count(*) AS tied FROM (SELECT *, min(priority) OVER (PARTITION BY subject) AS best FROM ({_ALL})) WHERE priority = best GROUP BY ALL HAVING count(*) > 1")
def coverage_tied(spark, t):  # noqa: ANN001, ANN201
    return coverage.ties(_candidates(t))


@query("SELECT 'MISSING_REQUIRED_DEFAULT' AS code FROM (SELECT count(*) AS n FROM supplier WHERE s_acctbal > 1e9) WHERE n = 0")
def coverage_default(spark, t):  # noqa: ANN001, ANN201
    return coverage.missing_default(t("supplier").select(F.col("s_suppkey").alias("candidate"), (F.col("s_acctbal") > 1e9).alias("required_default")))


_WON = "SELECT candidate, count(*) AS {n} FROM ({o}) WHERE state = 'WINNER' GROUP BY candidate"


@query(f"""SELECT candidate, "current", proposed, proposed - "current" AS delta,
abs(proposed - "current") > 40 OR CASE WHEN "current" = 0 THEN proposed > 0 ELSE abs(proposed - "current") / "current" > 0.25 END AS breach
FROM (SELECT candidate, coalesce(a, 0) AS "current", coalesce(b, 0) AS proposed
FROM (SELECT s_suppkey AS candidate FROM supplier UNION SELECT candidate FROM ({_ALL}) UNION SELECT candidate FROM ({_SOME}))
LEFT JOIN ({_WON.format(n='a', o=_OUTCOME.format(c=_ALL))}) USING (candidate) LEFT JOIN ({_WON.format(n='b', o=_OUTCOME.format(c=_SOME))}) USING (candidate))""")
def winner_distribution(spark, t):  # noqa: ANN001, ANN201
    return coverage.distribution(_candidates(t), _candidates(t, _PART), t("supplier").select(F.col("s_suppkey").alias("candidate")), 40, 0.25)


@query(f"""SELECT code, findings, CASE WHEN findings > 0 THEN 'BLOCKED' ELSE 'PASS' END AS state FROM (
SELECT 'UNCOVERED_POPULATION' AS code, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT subject FROM ({_SOME}))) AS findings
UNION ALL SELECT 'TIED_BEST_CANDIDATE', (SELECT count(*) FROM ({_OUTCOME.format(c=_SOME)}) WHERE state = 'AMBIGUOUS'))""")
def coverage_report(spark, t):  # noqa: ANN001, ANN201
    candidates = _candidates(t, _PART)
    return coverage.report({"UNCOVERED_POPULATION": coverage.uncovered(t("orders").select(F.col("o_orderkey").alias("subject")), candidates), "TIED_BEST_CANDIDATE": coverage.ties(candidates)})


# Comparison


@query(f"""SELECT o_orderkey, CASE WHEN kind = 'ACTIVATE' THEN 'ADDED' WHEN kind = 'DEACTIVATE' THEN 'REMOVED' WHEN kind = 'CHANGE' THEN 'CHANGED' ELSE 'UNCHANGED' END AS change, old_price, new_price FROM ({_ADVANCED})""")
def compare_delta(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    return compare.delta(old, new, ["o_orderkey"]).select("o_orderkey", "change", F.col("before.o_totalprice").alias("old_price"), F.col("after.o_totalprice").alias("new_price"))


@query(f"""SELECT CASE WHEN kind = 'ACTIVATE' THEN 'ADDED' WHEN kind = 'DEACTIVATE' THEN 'REMOVED' WHEN kind = 'CHANGE' THEN 'CHANGED' ELSE 'UNCHANGED' END AS change, count(*) AS "rows" FROM ({_ADVANCED}) GROUP BY 1""")
def compare_counts(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    return compare.counts(compare.delta(old, new, ["o_orderkey"]))


@query(f"""SELECT 'current' AS result_set, o_orderkey, o_totalprice FROM ({_OLD}) UNION ALL SELECT 'proposed', o_orderkey, o_totalprice FROM ({_NEW})
UNION ALL SELECT 'delta', o_orderkey, coalesce(new_price, old_price) FROM ({_ADVANCED}) WHERE kind IS NOT NULL""")
def compare_results(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    return compare.results(old, new, ["o_orderkey"]).select("result_set", "o_orderkey", "o_totalprice")


@query("SELECT count(*) AS \"rows\", CAST(sum(CAST('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM orders")
def checksum(spark, t):  # noqa: ANN001, ANN201
    return compare.checksum(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


# Policy sets: customers of two market segments are eligible.

_GATED = "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000"
_GATE = "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"
_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"


def _gates(t) -> dict[str, DataFrame]:  # noqa: ANN001
    who = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    return {"segments": who.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("o_custkey"), "rich": who.filter("c_acctbal > 5000").select("o_custkey")}


@query(f"SELECT o_orderkey, o_custkey, count(*) AS supports FROM ({_GATED}) JOIN (SELECT 's' AS g, c_custkey FROM ({_GATE}) UNION ALL SELECT 'r', c_custkey FROM ({_RICH})) ON o_custkey = c_custkey GROUP BY ALL")
def policy_scope_active(spark, t):  # noqa: ANN001, ANN201
    return policy.scoped(t("orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey"), _gates(t), ["o_custkey"]).select("o_orderkey", "o_custkey", "supports")


@query(f"SELECT c_custkey AS o_custkey, 'REMOVED' AS change FROM ({_GATE}) WHERE c_custkey NOT IN ({_RICH}) UNION ALL SELECT c_custkey, 'ADDED' FROM ({_RICH}) WHERE c_custkey NOT IN ({_GATE})")
def policy_scope_transition(spark, t):  # noqa: ANN001, ANN201
    gates = _gates(t)
    return policy.transitions(gates["segments"], gates["rich"], ["o_custkey"])


@query(f"SELECT subject, state, candidate, state = 'WINNER' AND subject IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS claimable FROM ({_OUTCOME.format(c=_ALL)})")
def policy_decision_claimable(spark, t):  # noqa: ANN001, ANN201
    gate = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("subject"))
    return policy.claimable(decisions.winners(_candidates(t)), gate, ["subject"]).select("subject", "state", "candidate", "claimable")


@query("SELECT 'DUPLICATE_SUBJECT' AS code, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'OVER_LIMIT', count(*) - 10000 FROM orders HAVING count(*) > 10000")
def policy_eligibility(spark, t):  # noqa: ANN001, ANN201
    return policy.eligibility_findings(t("orders").select("o_custkey"), ["o_custkey"], 10_000)


@query(f"""SELECT o_orderkey, o_custkey IN ({_RICH}) AS active, CAST(1 AS BIGINT) AS support_generation,
CASE WHEN o_custkey IN ({_RICH}) AND o_custkey NOT IN ({_GATE}) THEN 'ADDED' WHEN o_custkey NOT IN ({_RICH}) THEN 'REMOVED' END AS change FROM ({_GATED}) WHERE o_custkey IN ({_RICH}) OR o_custkey IN ({_GATE})""")
def policy_supports(spark, t):  # noqa: ANN001, ANN201
    """Supports by segment, then by wealth: what is gone, what has come and what stays."""
    gates, matches = _gates(t), t("orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    before = policy.scoped(matches, {"segments": gates["segments"]}, ["o_custkey"]).select("o_orderkey", F.struct("o_custkey").alias("subject"), F.lit(True).alias("active"), F.lit(1).cast("bigint").alias("support_generation"))
    return policy.upsert_supports(before, matches, ["o_orderkey"], ["o_custkey"], gates["rich"]).select("o_orderkey", "active", "support_generation", "change")


@query(f"""WITH a AS (SELECT o_orderkey FROM ({_GATED}) WHERE o_custkey IN ({_GATE})), b AS (SELECT o_orderkey FROM ({_GATED}) WHERE o_custkey IN ({_RICH}))
SELECT o_orderkey, 'DEACTIVATE' AS kind FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT o_orderkey, 'ACTIVATE' FROM b ANTI JOIN a USING (o_orderkey)""")
def policy_reconcile(spark, t):  # noqa: ANN001, ANN201
    """A rule's events when its gate changes: active is what matches and has a support."""
    gates, matches = _gates(t), t("orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    of = lambda gate: policy.scoped(matches, {"g": gate}, ["o_custkey"]).select("o_orderkey", "o_custkey")
    done = lifecycle.advance(lifecycle.seed(of(gates["segments"]), ["o_orderkey"]), of(gates["rich"]), ["o_orderkey"])
    return lifecycle.events(done, ["o_orderkey"]).select("o_orderkey", "kind")


# Provenance


@query("""SELECT o_orderkey, 'orders' AS source, 1000001 AS position, 'o_custkey' AS name, CAST(o_custkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT o_orderkey, 'orders', 1000002, 'o_orderstatus', o_orderstatus FROM orders""")
def provenance_bindings(spark, t):  # noqa: ANN001, ANN201
    return provenance.bindings(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], "orders")


@query("""WITH RECURSIVE i AS (SELECT p_partkey AS fact, p_partkey // 3 AS input FROM part WHERE p_partkey > 0 UNION SELECT 0, 1 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0),
r AS (SELECT p_partkey AS root, p_partkey AS fact, 0 AS depth, [p_partkey] AS path, false AS cycle FROM part
UNION ALL SELECT root, input, depth + 1, list_append(path, input), list_contains(path, input) FROM r JOIN i USING (fact) WHERE NOT cycle AND depth < 5),
g AS (SELECT root, fact, min(depth) AS depth, bool_or(cycle) AS cycle, max(depth) AS deepest FROM r GROUP BY root, fact),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, fact) AS nth, count(*) OVER (PARTITION BY root) AS total_nodes FROM g)
SELECT root, fact, CAST(depth AS BIGINT) AS depth, CASE WHEN cycle THEN 'CYCLE' WHEN fact NOT IN (SELECT fact FROM i) THEN 'GROUNDED' WHEN deepest >= 5 THEN 'TRUNCATED' ELSE 'DERIVED' END AS state,
total_nodes, greatest(total_nodes - 8, 0) AS omitted_nodes FROM n WHERE nth <= 8""")
def provenance_proof(spark, t):  # noqa: ANN001, ANN201
    """Every part is derived from those with a third and half of its number, and the first two from each other."""
    key = F.col("p_partkey")
    inputs = t("part").filter(key > 0).select(key.alias("fact"), F.explode(F.expr("array(p_partkey div 3, p_partkey div 2)")).alias("input"))
    inputs = inputs.union(spark.range(1).select(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    return provenance.proof(t("part").select(key.alias("fact")), inputs, 5, 8)


# Retention and operations

_OLD_EVENTS = f"epoch_us(ts) < {START + 15 * DAY}"
_PROTECTED = "SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) > 12"


def _retention(t):  # noqa: ANN001, ANN202
    events = t("events")
    protected = events.filter("event_type = 'signup'").groupBy("user_id").count().filter("count > 12").select("user_id")
    return events, times.epoch_micros(F.col("ts")) < START + 15 * DAY, protected


@query(f"SELECT 'events' AS family, count(*) FILTER (WHERE user_id NOT IN ({_PROTECTED})) AS eligible, count(*) FILTER (WHERE user_id IN ({_PROTECTED})) AS protected FROM events WHERE {_OLD_EVENTS}")
def retention_preview(spark, t):  # noqa: ANN001, ANN201
    events, old, protected = _retention(t)
    return retention.preview(events, old, protected, ["user_id"], "events")


@query(f"SELECT 'events' AS family, CAST(event_id AS VARCHAR) AS identity, CAST({START} AS BIGINT) AS removed_at FROM events WHERE {_OLD_EVENTS} AND user_id NOT IN ({_PROTECTED}) ORDER BY event_id LIMIT 500")
def retention_batch(spark, t):  # noqa: ANN001, ANN201
    events, old, protected = _retention(t)
    return retention.tombstones(retention.batch(events, old, protected, ["user_id"], "event_id", 500), "event_id", "events", START)


@query(f"SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE {_OLD_EVENTS} AND user_id NOT IN ({_PROTECTED}) ORDER BY event_id LIMIT 500)")
def retention_remaining(spark, t):  # noqa: ANN001, ANN201
    events, old, protected = _retention(t)
    return retention.remaining(events, retention.batch(events, old, protected, ["user_id"], "event_id", 500), "event_id").select("event_id", "user_id")


@query(f"""WITH e AS ({_EPISODES})
SELECT 'BARRIER' AS code, rule_version AS rule, count(*) AS n FROM e WHERE kind = 'CHANGE' AND rule_version = 2 GROUP BY 2
UNION ALL SELECT 'STALE_LEASE', rule_version, count(*) FROM e WHERE state = 'LEASED' GROUP BY 2
UNION ALL SELECT 'AGENDA_BACKLOG', rule_version, count(*) FROM e WHERE state IN ('PENDING', 'RETRY_WAIT', 'LEASED') GROUP BY 2 HAVING count(*) * 5 >= 1000 * 4""")
def health_findings(spark, t):  # noqa: ANN001, ANN201
    episodes = _episodes(t).withColumnRenamed("rule_version", "rule")
    return health.findings(episodes, episodes.filter("kind = 'CHANGE' AND rule = 2"), _NOW + 2, 1000)


@query(f"""SELECT 'rule' AS origin, o_orderkey AS subject, kind FROM ({_ADVANCED}) WHERE kind IS NOT NULL UNION ALL SELECT 'decision', subject, state FROM ({_OUTCOME.format(c=_ALL)}) WHERE state = 'WINNER'""")
def work_union(spark, t):  # noqa: ANN001, ANN201
    old, new = _snapshots(t)
    rules = lifecycle.events(lifecycle.advance(lifecycle.seed(old, ["o_orderkey"]), new, ["o_orderkey"]), ["o_orderkey"]).select(F.lit("rule").alias("origin"), F.col("o_orderkey").alias("subject"), "kind")
    won = decisions.winners(_candidates(t)).filter("state = 'WINNER'").select(F.lit("decision").alias("origin"), "subject", F.col("state").alias("kind"))
    return rules.unionByName(won)


# Passes and declarations: what earlier sections leave to a later pass


@query(f"""SELECT 'BARRIER' AS state, count(*) AS affected, count(*) FILTER (WHERE ("window" + 1) * {WIDTH} + {LATENESS} <= {START + 3 * DAY}) AS late FROM ({_CHANGED})""")
def window_barrier(spark, t):  # noqa: ANN001, ANN201
    before, after = _passes(t)
    return windows.admit(windows.affected(before, after, ["user_id"]), WIDTH, LATENESS, START + 3 * DAY)


@query(f"""WITH w AS (SELECT DISTINCT user_id, "window", ("window" + 1) * {WIDTH} + {LATENESS} AS boundary FROM ({_HOURS}))
SELECT user_id, "window", boundary, user_id || '@' || boundary AS identity FROM w WHERE boundary > {START + 5 * DAY} AND boundary <= {START + 12 * DAY}""")
def window_ledger(spark, t):  # noqa: ANN001, ANN201
    """Two requests, the second from before where the first ended: no window is finalized twice."""
    known, none = _staged(t).select("user_id", "window").distinct(), spark.createDataFrame([], "identity string")
    first = windows.ledger(windows.finalizations(known, WIDTH, LATENESS, START + 5 * DAY, START + 9 * DAY), ["user_id"], none)
    second = windows.ledger(windows.finalizations(known, WIDTH, LATENESS, START + 8 * DAY, START + 12 * DAY), ["user_id"], first)
    return first.unionByName(second).select("user_id", "window", "boundary", "identity")


_TOLD = f"""WITH c AS ({_CHANGED}), b AS (SELECT user_id, "window", count(*) AS n FROM ({_BEFORE}) GROUP BY ALL), a AS (SELECT user_id, "window", count(*) AS n FROM ({_AFTER}) GROUP BY ALL)
SELECT user_id, "window", 'sums@1/' || user_id || '/' || "window" || '/F2' AS identity, CAST(coalesce(b.n >= 2, false) OR coalesce(a.n >= 2, false) AS INTEGER) + CAST(coalesce(a.n >= 2, false) AND NOT coalesce(b.n >= 2, false) AND user_id % 2 = 0 AS INTEGER) AS support_generation
FROM c LEFT JOIN b USING (user_id, "window") LEFT JOIN a USING (user_id, "window")"""


def _told(t) -> DataFrame:  # noqa: ANN001
    """The second pass's corrections; windows of even users had a support once before."""
    before, after = _passes(t)
    count = lambda df: windows.measure(df, ["user_id"], "count_star")
    made = windows.corrections(count(before), count(after), windows.affected(before, after, ["user_id"]), ["user_id"], lambda v: v >= 2)
    history = made.select("user_id", "window", F.when(F.col("was_true"), 1).when((F.col("user_id") % 2 == 0) & (F.col("event") == "ACTIVATE"), 1).otherwise(0).cast("bigint").alias("support_generation"))
    return windows.identified(made, history, ["user_id"], "sums@1", 2)


@query(f"SELECT user_id, \"window\", identity, CAST(support_generation AS BIGINT) AS support_generation FROM ({_TOLD})")
def correction_identities(spark, t):  # noqa: ANN001, ANN201
    return _told(t).select("user_id", "window", "identity", "support_generation")


@query(f"SELECT identity FROM ({_TOLD}) WHERE identity > 'sums@1/2' ORDER BY identity LIMIT 101")
def corrections_page(spark, t):  # noqa: ANN001, ANN201
    return sharing.page(_told(t).select("identity"), "identity", "sums@1/2", 100)


@query(f"SELECT subject, CAST(0 AS INTEGER) AS step, CASE WHEN state = 'WINNER' THEN 'WINNER_OUT' ELSE 'AMBIGUITY_EXIT' END AS kind FROM ({_OUTCOME.format(c=_ALL)}) UNION ALL SELECT subject, 1, 'NO_CANDIDATE' FROM ({_OUTCOME.format(c=_ALL)})")
def decision_gap(spark, t):  # noqa: ANN001, ANN201
    before = decisions.winners(_candidates(t)).withColumns({"generation": F.lit(1).cast("bigint"), "revision": F.lit(0).cast("bigint")})
    return decisions.gap(before).select("subject", "step", "kind")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY priority, candidate) AS k, count(*) OVER (PARTITION BY subject) AS n FROM ({_ALL})),
l AS (SELECT subject, string_agg(candidate || ':' || priority, ',' ORDER BY k) FILTER (WHERE k <= 3) AS competitors, any_value(n) > 3 AS truncated FROM r GROUP BY subject)
SELECT o_orderkey AS subject, coalesce(state, 'NO_CANDIDATE') AS state, candidate, coalesce(competitors, '') AS competitors, coalesce(truncated, false) AS truncated
FROM orders LEFT JOIN ({_OUTCOME.format(c=_ALL)}) o ON o.subject = o_orderkey LEFT JOIN l ON l.subject = o_orderkey""")
def compare_decision_rows(spark, t):  # noqa: ANN001, ANN201
    return decisions.rows_model(_candidates(t), t("orders").select(F.col("o_orderkey").alias("subject")), 3).select("subject", "state", "candidate", "competitors", "truncated")


@query("SELECT 'MEMBER' AS state, 'member:RULE:' || n_name || ':' || n_regionkey AS key FROM nation UNION ALL SELECT 'ELIGIBLE', 'subject:' || lower(hex(CAST(c_custkey AS VARCHAR))) FROM customer WHERE c_acctbal > 5000")
def compare_policy_rows(spark, t):  # noqa: ANN001, ANN201
    members = t("nation").select(F.lit("RULE").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("version"))
    return compare.policy_rows(members, t("customer").filter("c_acctbal > 5000").select("c_custkey"), ["c_custkey"])


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000), b AS (SELECT o_orderkey, round(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus = 'O'), j AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y, a.o_totalprice AS p, b.o_totalprice AS q FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT 'READY' AS state, (SELECT count(*) FROM a) AS current_rows, (SELECT count(*) FROM b) AS proposed_rows, count(*) FILTER (WHERE x IS NULL) AS added, count(*) FILTER (WHERE y IS NULL) AS removed, count(*) FILTER (WHERE x = y AND p <> q) AS changed, count(*) FILTER (WHERE x = y AND p = q) AS unchanged FROM j""")
def compare_report(spark, t):  # noqa: ANN001, ANN201
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    seen = tuple(compare.checksum(orders).first())
    current, proposed = orders.filter("o_totalprice > 300000").drop("o_orderstatus"), orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.round("o_totalprice").alias("o_totalprice"))
    return compare.report(current, proposed, ["o_orderkey"], 10_000_000_000, seen, tuple(compare.checksum(orders).first()))


@query(f"""WITH e AS ({_EPISODES}), l AS (SELECT *, rule_version % 2 AS agenda_group FROM e WHERE rule_version IN (0, 1, 3)), f AS (SELECT agenda_group FROM l WHERE state = 'LEASED' GROUP BY 1 HAVING count(*) >= CASE WHEN agenda_group = 0 THEN 1 ELSE 1000000 END)
SELECT episode_id, rule_version, agenda_group FROM l WHERE agenda_group NOT IN (SELECT agenda_group FROM f)""")
def agenda_admissible(spark, t):  # noqa: ANN001, ANN201
    """Versions 2 and 4 are paused or behind a barrier; group 0 has one lease, group 1 a million."""
    versions = spark.createDataFrame([(v, "PAUSED" if v == 2 else "DRAINING" if v == 3 else "ACTIVE", v % 2) for v in range(5)], "rule_version long, state string, agenda_group long")
    groups = spark.createDataFrame([(0, 1), (1, 1_000_000)], "agenda_group long, most_leased long")
    return agenda.admissible(_episodes(t), versions, spark.createDataFrame([(4,)], "rule_version long"), groups, _NOW).select("episode_id", "rule_version", "agenda_group")


@query(f"""WITH e AS ({_EPISODES}) SELECT episode_id, CASE WHEN conflict_key IN ({_RICH}) THEN 'KEPT' WHEN state IN ('PENDING', 'RETRY_WAIT') THEN 'WITHDRAWN' WHEN state = 'LEASED' THEN 'SKIPPED' ELSE 'KEPT' END AS scope_state FROM e""")
def agenda_scope_recheck(spark, t):  # noqa: ANN001, ANN201
    supports = t("customer").select(F.col("c_custkey").alias("conflict_key"), (F.col("c_acctbal") > 5000).alias("active"))
    return agenda.scope_recheck(_episodes(t), supports, ["conflict_key"]).select("episode_id", "scope_state")


_VALID = "SELECT c_custkey, c_mktsegment AS policy_set, c_acctbal > 0 AS active, CAST(c_custkey % 50 AS BIGINT) AS valid_from, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 50 + 10 AS BIGINT) END AS valid_to FROM customer"


def _valid(t) -> DataFrame:  # noqa: ANN001
    start = (F.col("c_custkey") % 50).cast("bigint")
    return t("customer").select("c_custkey", F.col("c_mktsegment").alias("policy_set"), (F.col("c_acctbal") > 0).alias("active"), start.alias("valid_from"), F.when(F.col("c_custkey") % 3 > 0, start + 10).alias("valid_to"))


@query(f"SELECT c_custkey, policy_set FROM ({_VALID}) WHERE active AND valid_from <= 30 AND (valid_to IS NULL OR valid_to > 30) AND policy_set <> 'BUILDING'")
def policy_effective(spark, t):  # noqa: ANN001, ANN201
    return policy.effective(_valid(t), 30, spark.createDataFrame([("BUILDING",)], "policy_set string")).select("c_custkey", "policy_set")


@query(f"SELECT c_custkey, valid_to FROM ({_VALID}) WHERE active AND valid_to > 20 AND valid_to <= 30")
def policy_expired(spark, t):  # noqa: ANN001, ANN201
    return policy.expired(_valid(t), 20, 30).select("c_custkey", "valid_to")


@query(f"SELECT c_custkey, policy_set, 'BLOCKED' AS state FROM ({_VALID}) WHERE active AND policy_set = 'BUILDING' UNION ALL SELECT c_custkey, policy_set, 'REFRESHED' FROM ({_VALID}) WHERE valid_to IS NULL AND policy_set <> 'BUILDING'")
def policy_blocked(spark, t):  # noqa: ANN001, ANN201
    rows = _valid(t)
    return policy.blocked(rows.filter("active"), rows.filter("valid_to IS NULL"), spark.createDataFrame([("BUILDING",)], "policy_set string")).select("c_custkey", "policy_set", "state")


@query("SELECT 'MEMBERS_OVER_LIMIT' AS code, count(*) - 64 AS n FROM supplier HAVING count(*) > 64 UNION ALL SELECT 'MEMBER_KIND', count(*) FILTER (WHERE s_nationkey > 20) FROM supplier HAVING count(*) FILTER (WHERE s_nationkey > 20) > 0 UNION ALL SELECT 'MEMBER_DUPLICATE', count(*) - count(DISTINCT (s_nationkey > 20, s_suppkey % 7)) FROM supplier HAVING count(*) > count(DISTINCT (s_nationkey > 20, s_suppkey % 7)) UNION ALL SELECT 'EVIDENCE_LIMIT', 1")
def policy_declaration(spark, t):  # noqa: ANN001, ANN201
    members = t("supplier").select(F.when(F.col("s_nationkey") > 20, "TABLE").otherwise("RULE").alias("kind"), (F.col("s_suppkey") % 7).cast("string").alias("name"), F.lit(1).alias("version"))
    return policy.declaration_findings(members, 1_001)


@query("SELECT c_custkey, kind, version FROM (SELECT c_custkey, 'EXPIRED' AS kind, 1 AS version FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'EFFECTIVE', 2 FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey, 'GAP', NULL FROM customer WHERE c_custkey % 3 = 1)")
def effective_history(spark, t):  # noqa: ANN001, ANN201
    """One version for ever, one that ends, or one that ends where the next begins; the frontier moves over the end."""
    k, version = F.col("c_custkey") % 3, lambda n, a, b: F.struct(F.lit(n).alias("version"), F.lit(a).cast("bigint").alias("valid_from"), F.lit(b).cast("bigint").alias("valid_to"))
    listed = F.when(k == 0, F.array(version(1, 0, None))).when(k == 1, F.array(version(1, 0, 10))).otherwise(F.array(version(1, 0, 10), version(2, 10, None)))
    rows = t("customer").select("c_custkey", F.explode(listed).alias("v")).select("c_custkey", "v.*")
    return effective.history(rows, ["c_custkey"], 5, 15)


@query("SELECT c_custkey, 2 AS version, 'RETROACTIVE' AS code FROM customer WHERE c_custkey % 4 <= 2")
def effective_retroactive(spark, t):  # noqa: ANN001, ANN201
    rows = t("customer").select("c_custkey", F.lit(2).alias("version"), (F.col("c_custkey") % 4).cast("bigint").alias("valid_from"), F.lit(False).alias("admitted"))
    return effective.retroactive(rows, ["c_custkey"], 2)


@query(f"WITH e AS ({_EPISODES}) SELECT episode_id, CASE WHEN state IN ('PENDING', 'RETRY_WAIT') AND rule_version = 2 AND conflict_key % 2 = 0 THEN 'SUPERSEDED' ELSE state END AS state FROM e")
def effective_superseded(spark, t):  # noqa: ANN001, ANN201
    gone = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("conflict_key"), F.lit(2).cast("bigint").alias("rule_version"))
    return effective.superseded(_episodes(t), ["conflict_key"], gone).select("episode_id", "state")


@query("SELECT 0 AS ordinal, 'lines' AS family, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) AS eligible, count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) AS protected FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 1, 'orders', count(*), 0 FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT 2, 'customers', count(*), 0 FROM customer WHERE c_acctbal < 0")
def retention_families(spark, t):  # noqa: ANN001, ANN201
    tables = {"customers": (t("customer"), F.col("c_acctbal") < 0, "c_custkey"), "orders": (t("orders"), F.col("o_totalprice") < 50000, "o_orderkey"), "lines": (t("lineitem"), F.col("l_discount") > 0.05, "l_orderkey")}
    return retention.families(tables, {"orders": "customers", "lines": "orders"}, {"lines": t("orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))})


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount <= 0.05)")
def retention_parents(spark, t):  # noqa: ANN001, ANN201
    """Old orders whose lines have all gone."""
    left = t("lineitem").filter("l_discount <= 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return retention.childless(t("orders").filter("o_totalprice < 50000").select("o_orderkey"), left, "o_orderkey")


@query(f"SELECT event_id, CASE WHEN {_OLD_EVENTS} THEN NULL ELSE props END AS props FROM events")
def retention_payloads(spark, t):  # noqa: ANN001, ANN201
    return retention.without_payloads(t("events").select("event_id", "ts", "props"), times.epoch_micros(F.col("ts")) < START + 15 * DAY, ["props"]).select("event_id", "props")


@query(f"SELECT o_orderkey, 'ACTIVATE' AS kind, deadline AS declared_deadline, CAST({_DUE} AS BIGINT) AS observed_frontier FROM ({_DEADLINES}) WHERE deadline > {_DUE - 7 * DAY} AND deadline <= {_DUE}")
def deadline_lifecycle(spark, t):  # noqa: ANN001, ANN201
    return temporal.deadline_events(_deadlines(t), ["o_orderkey"], "deadline", _DUE - 7 * DAY, _DUE)


@query("SELECT 'TEMPORAL_LIMIT' AS code, count(DISTINCT user_id) AS n FROM events HAVING count(DISTINCT user_id) > 50")
def temporal_limit(spark, t):  # noqa: ANN001, ANN201
    return temporal.over_limit(t("events").select("user_id"), 50)


@query("""SELECT 'DERIVED_FACT_INVALID' AS code, c_mktsegment AS rule, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_custkey % 2 = 1 GROUP BY 2 UNION ALL SELECT 'DERIVED_FACT_MISSING', c_mktsegment, count(*) FROM customer WHERE c_acctbal <= 0 AND c_custkey % 2 = 0 GROUP BY 2
UNION ALL SELECT 'SOURCE_DRIFT', n_name, 1 FROM nation WHERE n_regionkey = 2""")
def health_drift(spark, t):  # noqa: ANN001, ANN201
    facts = t("customer").select(F.col("c_mktsegment").alias("relation"), "c_custkey", "c_acctbal")
    known = t("nation").select(F.col("n_name").alias("rule"), F.lit("a").alias("fingerprint"))
    present = t("nation").select(F.col("n_name").alias("rule"), F.when(F.col("n_regionkey") == 2, "b").otherwise("a").alias("fingerprint"))
    return health.derived_findings(facts.filter("c_acctbal > 0"), facts.filter("c_custkey % 2 = 0"), ["c_custkey"]).unionByName(health.drift(known, present))


@query("SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS listed, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def ordered_list(spark, t):  # noqa: ANN001, ANN201
    return sharing.listed(t("lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber")


@query(f"""WITH r AS ({_REACHED}), e AS (SELECT c_custkey FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
v AS (SELECT c_custkey, count(*) AS n FROM e JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) >= 12),
s(relation, depth, rule, kind, name, cycle) AS (VALUES ('vip', 0, 'vip', 'SOURCE', 'customers', false), ('vip', 0, 'vip', 'INPUT', 'eligible', false), ('vip', 0, 'vip', 'AGGREGATE', 'count_star(*) of orders >= 12', false),
  ('eligible', 1, 'eligible', 'SOURCE', 'customers', false), ('eligible', 1, 'eligible', 'INPUT', 'c', false), ('eligible', 1, 'eligible', 'NEGATIVE', 'blocked', false),
  ('c', 2, 'c_seed', 'SOURCE', 'large_orders', false), ('c', 2, 'c_from_b', 'SOURCE', 'customers', false), ('c', 2, 'c_from_b', 'INPUT', 'b', false),
  ('b', 3, 'b_from_c', 'SOURCE', 'customers', false), ('b', 3, 'b_from_c', 'INPUT', 'c', true), ('b', 3, 'b_from_a', 'SOURCE', 'customers', false), ('b', 3, 'b_from_a', 'INPUT', 'a', false), ('a', 4, 'a_seed', 'SOURCE', 'big_spenders', false))
SELECT relation, c_custkey, depth, rule, kind, name, CASE WHEN kind = 'AGGREGATE' THEN CAST(n AS VARCHAR) END AS value, cycle FROM v, s
WHERE (rule NOT IN ('b_from_a', 'a_seed') OR c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)) AND (rule <> 'c_seed' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))""")
def fact_proof(spark, t):  # noqa: ANN001, ANN201
    """What every eligible customer with a dozen orders rests on."""
    vip = derive.Rule("vip", "vip", "customers", ("eligible",), aggregate=derive.Aggregate("orders", "count_star", None, ">=", 12))
    program, sources = derive.Program((*_program().rules, vip), ("c_custkey",)), {**_program_sources(t), "orders": t("orders").select(F.col("o_custkey").alias("c_custkey"))}
    facts = derive.evaluate(program, sources)
    return derive.fact_proof(program, sources, facts, facts["vip"].withColumn("relation", F.lit("vip")))


@query("""SELECT CASE WHEN missing + extra > 0 THEN 'STALE' ELSE 'CURRENT' END AS state, missing, extra FROM
(SELECT count(*) AS missing FROM (SELECT l_orderkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_orderkey, l_linestatus FROM lineitem)), (SELECT count(*) AS extra FROM (SELECT l_orderkey, l_linestatus FROM lineitem EXCEPT ALL SELECT l_orderkey, l_returnflag FROM lineitem))""")
def source_current(spark, t):  # noqa: ANN001, ANN201
    """Two flags of line items, of which one takes the other's place; orders have several alike."""
    return compare.source_current(t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag")), t("lineitem").select("l_orderkey", F.col("l_linestatus").alias("flag")))


@query(f"""WITH e AS ({_EPISODES}) SELECT rule_version AS rule, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'RETRY_WAIT') AS retry_wait, count(*) FILTER (WHERE state = 'LEASED') AS leased,
count(*) FILTER (WHERE state = 'DONE') AS done, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state = 'LEASED' AND lease_until <= {_NOW + 2}) AS expired_leases,
coalesce(({_NOW + 2} - min(available_at) FILTER (WHERE state IN ('PENDING', 'RETRY_WAIT') AND available_at <= {_NOW + 2}))::DOUBLE / 1000000, 0) AS oldest_due_seconds FROM e GROUP BY rule_version""")
def health_metrics(spark, t):  # noqa: ANN001, ANN201
    return health.metrics(_episodes(t).withColumnRenamed("rule_version", "rule"), _NOW + 2)


_SHAPED = " UNION ALL ".join("SELECT '{}' AS code, '{}' AS severity, {} AS blocking, '{}' AS message, '{}' AS hint".format(code, *(str(x).replace("'", "''") for x in m)) for code, m in health.MEANING.items())


@query(f"""WITH m AS ({_SHAPED}), f AS ({ORACLE_SQL['health_findings']}) SELECT code, severity, blocking, CAST(rule AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS field, message, hint, '{{"n":' || n || '}}' AS details FROM f JOIN m USING (code)""")
def finding_shape(spark, t):  # noqa: ANN001, ANN201
    episodes = _episodes(t).withColumnRenamed("rule_version", "rule")
    return health.shaped(health.findings(episodes, episodes.filter("kind = 'CHANGE' AND rule = 2"), _NOW + 2, 1000))


@query(f"""WITH i AS (SELECT c_custkey, {_UUID} AS id FROM (SELECT o_custkey AS c_custkey, sha256(unhex('{_V}') || unhex('010100000008') || unhex(printf('%016X', o_orderkey))) AS d FROM orders))
SELECT c_custkey, min(id) AS value, coalesce(min(id) < '20000000', false) AS truth FROM customer LEFT JOIN i USING (c_custkey) GROUP BY c_custkey""")
def aggregate_uuid(spark, t):  # noqa: ANN001, ANN201
    """The least activation id of each customer's orders; ids are compared as canonical text."""
    ids = t("orders").select(F.col("o_custkey").alias("c_custkey"), identity.activation_id(VERSION, identity.canonical_bigint(F.col("o_orderkey"))).alias("id"))
    return derive.aggregate_truth(t("customer"), ids, ["c_custkey"], derive.Aggregate("orders", "min", "id", "<", "20000000")).select("c_custkey", "value", "truth")
