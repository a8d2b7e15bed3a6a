"""Benchmark decontamination (operator 4): winnowing, in DataFrame functions alone.

Both sides hash their k-word grams and keep the least hash of every w consecutive grams.
Any span of k + w - 1 words that a document shares with an item then has a kept hash at
the same place on both sides. Kept hashes of documents that the benchmark has are hits;
a hit is extended to the benchmark windows around it that the document really has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import NOT_ALNUM, NOT_ALNUM_ANY_CASE, ascii_lower, keep_rows, materialize, words_of

#: Words of a window, and of a gram where the shortest item allows it.
WINDOW, GRAM = 13, 5
#: Hashes of the benchmark up to which they are broadcast (16 MB at most); beyond, the
#: join shuffles.
BROADCAST_ROWS = 1_000_000


#: Bits of a winnowing value that hold the place; the others are of the hash. No text has more words.
PLACE_BITS = 28


def _hashed(text: Column, separators: str) -> Column:
    """A hash of each word."""
    return F.transform(words_of(text, separators), lambda w: F.xxhash64(w))


def _grams(words: str, k: int) -> Column:
    """Hashes of all k consecutive words, from the words' hashes."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return F.expr(f"IF(size({words}) < {k}, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})))")


def _valued(grams: str) -> Column:
    """What winnowing compares: the hash's first bits and the place after them, so that of equal ones the first is least."""
    return F.expr(f"transform({grams}, (g, i) -> (g & {-(1 << PLACE_BITS)}L) | i)")


def _kept(values: str, w: int) -> Column:
    """Places of the least value of every w consecutive ones."""
    least = f"least({', '.join(f'{values}[i + {j}]' for j in range(w))})" if w > 1 else f"{values}[i]"
    return F.expr(f"IF(size({values}) < {w}, CAST(array() AS ARRAY<INT>), array_distinct(transform(sequence(0, size({values}) - {w}), i -> CAST({least} & {(1 << PLACE_BITS) - 1}L AS INT))))")


def _places(n: int, k: int) -> list[int]:
    """Gram places in a window of n words that cover it."""
    return sorted({*range(0, n - k, k), n - k})


def _windows(grams: str, first: str, low: str, n: int, k: int) -> str:
    """SQL for the n-word windows at starts `first`..: their start, length and gram hashes."""
    signature = ", ".join(f"{grams}[s - {low} + {p}]" for p in _places(n, k))
    return f"transform({first}, s -> named_struct('at', s, 'n', {n}, 'signature', array({signature})))"


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of a-z, 0-9 and non-ASCII characters once A-Z is lower case. A window is
    `window` consecutive words of an item, or all words of a shorter one. n_hit counts the
    document's words inside any occurrence of a window, n_items the items that have such
    windows; items_sha256 is of their ids, sorted as strings and joined by commas.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words
    and are clean; so is every document when the benchmark is empty. Items with null ids
    count for hits and not for n_items. Repeated rows and null document ids get rows of
    their own; extra columns are not read.
    """
    return _contamination(docs, benchmark, window, id_col, text_col, item_col, item_text_col).select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The same rows with id and key, the text's xxhash64."""
    items = materialize(benchmark.select(F.col(item_col).alias("item"), _hashed(ascii_lower(F.col(item_text_col)), NOT_ALNUM).alias("words")), "words").filter("size(words) > 0")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]  # `window` values at most
    shortest = min(lengths, default=window)
    k = min(GRAM, shortest)
    w, reach = shortest - k + 1, window - k

    item_grams = items.select("item", F.size("words").alias("size"), _grams("words", k).alias("grams"))
    known = materialize(item_grams.select("grams", _valued("grams").alias("valued")).select(F.explode(_kept("valued", w)).alias("p"), "grams").select(F.expr("grams[p]").alias("hash")).distinct(), "known")
    of_items = [
        item_grams.filter(F.col("size") >= window if n == window else F.col("size") == n).select("item", F.explode(F.expr(_windows("grams", f"sequence(0, size - {n})", "0", n, k))).alias("x"))
        for n in lengths
    ]
    windows = None
    for part in of_items:
        windows = part if windows is None else windows.union(part)

    counted = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.size(words_of(F.col(text_col), NOT_ALNUM_ANY_CASE)).cast("long").alias("n_words"))
    if windows is None:
        return _result(counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}))
    windows = materialize(windows.select("item", "x.n", "x.signature").distinct(), "windows")

    grams = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), _hashed(ascii_lower(F.col(text_col)), NOT_ALNUM).alias("words")).select(
        "id", "key", _grams("words", k).alias("grams")
    )
    around = grams.select("id", "key", "grams", _valued("grams").alias("valued")).select("id", "key", "grams", _kept("valued", w).alias("kept")).select(
        "id",
        "key",
        F.explode(
            F.expr(f"transform(kept, p -> named_struct('hash', grams[p], 'p', p, 'low', greatest(p - {reach}, 0), 'near', slice(grams, greatest(p - {reach}, 0) + 1, p + {reach} + 1 - greatest(p - {reach}, 0))))")
        ).alias("x"),
    ).select("id", "key", "x.*")
    hits = around.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "hash", "left_semi")
    tried = [_windows("near", f"filter(sequence(greatest(p - {n - k}, 0), p), s -> s - low + {n - k} < size(near))", "low", n, k) for n in lengths]
    found = hits.select("id", "key", F.explode(F.expr(f"concat({', '.join(tried)})")).alias("x")).select("id", "key", "x.*").distinct()
    found = materialize(found.join(windows.select("n", "signature").distinct(), ["n", "signature"]), "found")
    # Both lists are of one document: its places, and the items that it has.
    hit = found.groupBy("id", "key").agg(
        F.expr(
            "aggregate(array_sort(collect_set(struct(at, n))), named_struct('hit', 0L, 'upto', 0), (a, x) -> named_struct('hit', a.hit + greatest(0, x.at + x.n - greatest(x.at, a.upto)), 'upto', greatest(a.upto, x.at + x.n)), a -> a.hit)"
        ).alias("n_hit")
    )
    of_doc = found.select("id", "key", "n", "signature").distinct().join(windows, ["n", "signature"]).groupBy("id", "key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    both = hit.join(of_doc, hit["id"].eqNullSafe(of_doc["id"]) & (hit["key"] == of_doc["key"])).select(hit["id"].alias("h_id"), hit["key"].alias("h_key"), "n_hit", "items")
    joined = counted.join(both, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left")
    return _result(joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}))


def _result(marked: DataFrame) -> DataFrame:
    return marked.select(
        "id",
        "key",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with their columns as they were.

    Each row goes by its own text, whatever other rows have its id.
    """
    marked = _contamination(docs, benchmark, WINDOW, id_col, text_col, "item_id", "text").select("id", "key", (~F.col("contaminated")).alias("stays"))
    return keep_rows(docs, materialize(marked, "contaminated"), id_col, text_col)


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 13) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM i, sizes WHERE n = least(len(w), 13))),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE n <= len(w))),
m AS (SELECT doc_id, s, dw.n AS n, item_id FROM dw JOIN iw ON dw.x = iw.x AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
