"""Mixing sources to target weights (operator 9): temperature mixing, in DataFrame functions.

A source's weight is its token share to a power between 0 (all equal) and 1 (as they
are), normalised. The exponent is bisected to the largest that reaches a target entropy,
and raised, if need be, to the least at which no source repeats beyond a limit. Weights
become token quotas of a budget: whole passes over a source and the start of one more,
each in an order of its own, dealt over blocks so that every block has the weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WHITE, materialize, words_of

#: Sources that are collected to fit the exponent; more raise an error.
MAX_SOURCES = 100_000
STEPS = 50
#: Tokens of a part of a source within which running sums are made, and most parts.
PART_TOKENS, MOST_PARTS = 100_000, 100_000


def weights_at(shares: list[float], exponent: float) -> list[float]:
    powers = [s**exponent for s in shares]
    total = sum(powers)
    return [p / total for p in powers]


def _entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def fit_exponent(tokens: list[int], budget: int, entropy_share: float, max_repeats: float) -> float:
    """The exponent for sources of so many tokens; entropy_share is of the greatest entropy.

    Sources repeat least in their own shares; a budget that repeats them beyond the limit even then is an error.
    """
    total = sum(tokens)
    if budget > max_repeats * total:
        raise ValueError(f"a budget of {budget} repeats {total} tokens more than {max_repeats} times in any mix")
    shares = [t / total for t in tokens]
    target = entropy_share * math.log(len(tokens))

    def bisect(holds_low: bool, holds) -> float:  # noqa: ANN001
        """The end of [0, 1] at which holds() is true, as far towards the other as it stays so."""
        good, bad = (0.0, 1.0) if holds_low else (1.0, 0.0)
        if holds(bad):
            return bad
        for _ in range(STEPS):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if holds(mid) else (good, mid)
        return good

    mixed = bisect(True, lambda a: _entropy(weights_at(shares, a)) >= target)
    spared = bisect(False, lambda a: max(w * budget / t for w, t in zip(weights_at(shares, a), tokens, strict=True)) <= max_repeats)
    return max(mixed, spared)


def mix(
    docs: DataFrame,
    budget: int | None = None,
    entropy_share: float = 0.95,
    max_repeats: float = 4.0,
    block_tokens: int = 100_000,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each time a document is used: id, source, epoch, block, place, tokens.

    tokens: words between ASCII white space, and one for the document's end, so that an
    empty or null text has one (what a vocabulary file makes of it is not for SQL functions). budget: the corpus's tokens unless given; a source with
    quota q and t tokens is used q div t times, and then as many documents of one more
    pass as fit into the rest. Orders are by MD5 of seed, epoch and id, and of the text's
    hash and a number where rows share an id or have none. block: which of
    the budget's parts of block_tokens; place: the order in the block, from 1. Null
    sources are one source, the empty string. Repeated rows are documents of their own,
    each with its draws. An empty table gives an empty result; extra columns are not read.
    A budget that no mix can meet within max_repeats is an error.
    """
    return _mixed(docs, budget, entropy_share, max_repeats, block_tokens, seed, id_col, text_col, source_col).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", "block", "place", "tokens")


#: Rows that one task makes of a repeated row.
NUMBERED = 100_000


def _drawn(items: DataFrame) -> DataFrame:
    """items with `of`, what a row's draws are made of: its id, or for shared and null ids the id, the text's hash and a number."""
    own = F.coalesce(F.col("id").cast("string"), F.lit(""))
    shared = materialize(items.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("id IS NULL OR rows > 1").select(F.col("id").alias("s_id")), "shared")
    if not shared.limit(1).count():
        return items.withColumn("of", own)
    same = F.col("id").eqNullSafe(F.col("s_id"))
    # Alike rows are counted, not collected; what comes of one is numbered in parts by several tasks.
    counted = items.join(shared, same, "left_semi").groupBy("id", "key", "source", "tokens").agg(F.count(F.lit(1)).alias("rows"))
    parts = counted.withColumn("part", F.explode(F.expr(f"sequence(0L, (rows - 1) div {NUMBERED})"))).repartition("id", "key", "part")
    numbered = parts.withColumn("number", F.explode(F.expr(f"sequence(part * {NUMBERED}L + 1, least((part + 1) * {NUMBERED}L, rows))")))
    several = numbered.select("id", "key", "source", "tokens", F.concat_ws(":", own, "key", "number").alias("of"))
    return materialize(items.join(shared, same, "left_anti").withColumn("of", own).union(several), "items")


def _mixed(docs: DataFrame, budget: int | None, entropy_share: float, max_repeats: float, block_tokens: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """mix() with the text's xxhash64, key."""
    items = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), (F.size(words_of(F.col(text_col), WHITE)) + 1).cast("long").alias("tokens")
        ),
        "items",
    )
    sources = sorted(tuple(r) for r in items.groupBy("source").agg(F.sum("tokens")).limit(MAX_SOURCES + 1).collect())
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = docs.sparkSession
    total = sum(t for _, t in sources)
    budget = total if budget is None else budget
    rows = []
    if sources:
        exponent = fit_exponent([t for _, t in sources], budget, entropy_share, max_repeats)
        rows = [(s, t, math.floor(round(w, 9) * budget)) for (s, t), w in zip(sources, weights_at([t / total for _, t in sources], exponent), strict=True)]
    quotas = spark.createDataFrame(rows, "source string, t long, quota long")
    blocks = max(1, -(-budget // block_tokens))

    used = (
        _drawn(items).join(F.broadcast(quotas), "source")  # MAX_SOURCES rows at most
        .withColumn("epoch", F.explode(F.expr("sequence(0L, quota div t)")))
        .withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col("of"))))
        .withColumn("part", F.expr(f"CAST(conv(substr(draw, 1, 8), 16, 10) AS BIGINT) * least({MOST_PARTS}L, t div {PART_TOKENS}L + 1) div 4294967296L"))
    )
    # The order of a pass is by draw, and parts are ranges of draws: sums of the parts
    # before and a running sum inside one part give a place without a window over a source.
    parts = used.groupBy("source", "epoch", "part").agg(F.sum("tokens").alias("part_tokens"))
    before = parts.select(
        "source", "epoch", "part", (F.sum("part_tokens").over(Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_tokens")).alias("ahead")
    )
    needed = used.join(before, ["source", "epoch", "part"]).filter("epoch * t + ahead < quota")
    inside = Window.partitionBy("source", "epoch", "part").orderBy("draw", "of").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        needed.withColumn("upto", F.col("epoch") * F.col("t") + F.col("ahead") + F.sum("tokens").over(inside))
        .filter("upto <= quota")
        .withColumn("block", F.expr(f"CAST(least({blocks} - 1, floor(CAST(upto - tokens AS DOUBLE) / quota * {blocks})) AS BIGINT)"))
    )
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("draw", "source", "of")).cast("long")).select("id", "key", "source", "epoch", "block", "place", "tokens")


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = ("lang",)) -> DataFrame:
    """mix() with the texts and the extra columns of the documents used: id, text, *extra, source, epoch, block, place, tokens.

    Each use has the text of its own row, whatever other rows have its id. Rows alike in id
    and text count as often as they are there; their extra columns are those of one of them.
    Extra columns may have any name but those of the result's other columns.
    """
    mixed = _mixed(docs, None, 0.95, 4.0, 100_000, 1, id_col, text_col, source_col).withColumnsRenamed({"id": "u_id", "key": "u_key", "source": "u_source"})
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.struct(F.col(text_col), *extra).alias("row"))
    ids = docs.groupBy(id_col, F.xxhash64(F.col(text_col)).alias("key")).count()
    if ids.filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["id", "key"])
    joined = mixed.join(texts, F.col("u_id").eqNullSafe(F.col("id")) & (F.col("u_key") == F.col("key")))
    return joined.select(F.col("id").alias(id_col), *(F.col("row")[c].alias(c) for c in (text_col, *extra)), F.col("u_source").alias(source_col), "epoch", "block", "place", "tokens")


ORACLE_SQL = r"""
WITH RECURSIVE items AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS tokens FROM documents),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM items GROUP BY source),
b AS (SELECT CAST(sum(t) AS BIGINT) AS budget, 0.95::DOUBLE * ln(count(*)::DOUBLE) AS target FROM s),
l AS (SELECT list(t::DOUBLE / budget ORDER BY source) AS p, list(t::DOUBLE ORDER BY source) AS ts, any_value(budget)::DOUBLE AS budget, any_value(target) AS target FROM s, b),
mixed AS (
  SELECT 0 AS k, 0.0::DOUBLE AS good, 1.0::DOUBLE AS bad
  UNION ALL
  SELECT k + 1, CASE WHEN h >= target THEN mid ELSE good END, CASE WHEN h >= target THEN bad ELSE mid END
  FROM (SELECT k, good, bad, (good + bad) / 2 AS mid, target,
               ln(list_sum(list_transform(p, lambda x: pow(x, (good + bad) / 2)))) - list_sum(list_transform(p, lambda x: pow(x, (good + bad) / 2) * (good + bad) / 2 * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (good + bad) / 2))) AS h
        FROM mixed, l WHERE k < 50)),
spared AS (
  SELECT 0 AS k, 1.0::DOUBLE AS good, 0.0::DOUBLE AS bad
  UNION ALL
  SELECT k + 1, CASE WHEN r <= 4 THEN mid ELSE good END, CASE WHEN r <= 4 THEN bad ELSE mid END
  FROM (SELECT k, good, bad, (good + bad) / 2 AS mid,
               list_max(list_transform(p, lambda x: pow(x, (good + bad) / 2 - 1))) / list_sum(list_transform(p, lambda x: pow(x, (good + bad) / 2))) AS r
        FROM spared, l WHERE k < 50)),
a AS (SELECT greatest(
  CASE WHEN list_sum(list_transform(p, lambda x: -x * ln(x))) >= target THEN 1.0 ELSE (SELECT good FROM mixed WHERE k = 50) END,
  CASE WHEN list_max(list_transform(p, lambda x: 1 / x)) / len(p) <= 4 THEN 0.0 ELSE (SELECT good FROM spared WHERE k = 50) END) AS e FROM l),
q AS (SELECT source, t, CAST(floor(round(pow(t::DOUBLE / budget, e) / list_sum(list_transform(p, lambda x: pow(x, e))), 9) * budget) AS BIGINT) AS quota FROM s, a, l),
used AS (SELECT doc_id, source, tokens, t, quota, epoch, md5('1:' || epoch || ':' || doc_id) AS draw
         FROM (SELECT i.*, t, quota, unnest(generate_series(0, quota // t)) AS epoch FROM items i JOIN q USING (source))),
placed AS (SELECT *, epoch * t + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM used),
blocked AS (SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, tokens, draw,
                   CAST(least(ceil(budget / 100000.0) - 1, floor((upto - tokens)::DOUBLE / quota * ceil(budget / 100000.0))) AS BIGINT) AS block
            FROM placed, b WHERE upto <= quota)
SELECT doc_id, source, epoch, block, row_number() OVER (PARTITION BY block ORDER BY draw, source, doc_id) AS place, tokens FROM blocked
"""
