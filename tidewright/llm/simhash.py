"""SimHash near-dedup (operator 6): meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less have a common fingerprint within distance 1 of
both. So every distinct fingerprint emits its ball of radius 1 (itself and the 64 with
one bit flipped), the variants are shuffled, and a variant reached twice gives links.
A variant is reached by 65 fingerprints at most, and which they are fits in one long
and a flag; no group can grow, however many documents share a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import keep_rows, materialize
from tidewright.llm.components import components

BITS = 64
#: Shingle hashes whose bits are spread out at once.
SPREAD = 1 << 18
#: Fingerprints whose balls one task makes.
BALLS = 20_000


def _fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [hash_of(joined, seed)]
    else:
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        hashes = [hash_of(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), SPREAD):
        ones += np.unpackbits(h[i : i + SPREAD].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of each whole text, as a signed long."""

    return _fingerprinted(docs, shingle, seed, id_col, text_col).select(F.col("id").alias(id_col), "fp")


def _fingerprinted(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, fp): key is the text's xxhash64, and tells rows that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col)).mapInArrow(run, f"id {kind}, key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at 2 or fewer differing bits.

    The members of a variant's ball are all within 2 of one another, so linking its
    least member to the others loses no connection and emits no pairs beyond those.
    """
    ball = fps.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // BALLS)), "fp").select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("bit")).select(
        F.expr("IF(bit < 0, fp, fp ^ shiftleft(1L, bit))").alias("variant"), F.expr("IF(bit < 0, 0L, shiftleft(1L, bit))").alias("flipped"), (F.col("bit") < 0).alias("own")
    )
    met = (
        ball.groupBy("variant")
        .agg(F.bit_or("flipped").alias("flipped"), F.max("own").alias("own"))
        .filter(F.expr("bit_count(flipped) + CAST(own AS INT) > 1"))
    )
    members = met.select(
        F.expr(
            f"concat(IF(own, array(variant), array()), transform(filter(sequence(0, {BITS - 1}), b -> shiftright(flipped, b) & 1L = 1L), b -> variant ^ shiftleft(1L, b)))"
        ).alias("near")
    )
    star = members.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b AND bit_count(a ^ b) <= 2")
    return star.distinct()


def _linked(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, key, fp), key the text's xxhash64; (fp, least, row), the least id and row of each fingerprint; (fp, root) of the linked ones."""
    own = materialize(_fingerprinted(docs, shingle, seed, id_col, text_col), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "key")
    distinct = materialize(own.groupBy("fp").agg(F.min("id").alias("least"), F.min(row).alias("row")), "distinct")
    return own, distinct, components(links(distinct)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, fingerprint (16 hex digits) and component_id.

    component_id is the least id reachable over links, the document's own included.
    Null, empty and blank texts have fingerprint 0 and are linked like any other.
    Repeated rows stay rows. A null id never names a component unless all of it is null.
    Other columns are not read; an empty table gives an empty result.
    """
    own, distinct, roots = _linked(docs, shingle, seed, id_col, text_col)
    of_root = roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("joined"))
    linked = roots.join(of_root, "root").select("fp", "joined")
    named = materialize(distinct.select("fp", "least").join(linked, "fp", "left").select("fp", F.coalesce("joined", "least").alias("component_id")), "components")
    # The fingerprint of a third of all documents is one key here: a sort-merge join's
    # large partitions are split at run time, and nothing above it needs a key together.
    return own.join(named, "fp").select(F.col("id").alias(id_col), F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, a row with its least id; columns as they were.

    Each row goes by its own fingerprint's component, whatever other rows have its id. Null
    ids are the greatest ones, and of rows with one id the least fingerprint and text hash
    stay. Of rows alike in id and text one stays. Null, empty and blank texts have the same
    fingerprint and are one component. An empty table gives an empty result; no column of
    docs is read but the two named.
    """
    own, distinct, roots = _linked(docs, 3, 42, id_col, text_col)
    of_fp = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "row")
    first = of_fp.groupBy("root").agg(F.min("row").alias("first"))
    named = materialize(of_fp.join(first, "root").select("fp", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "survivors")
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    return keep_rows(docs, materialize(own.join(named, "fp").select("id", "key", stays.alias("stays")), "marked"), id_col, text_col, once=True)
