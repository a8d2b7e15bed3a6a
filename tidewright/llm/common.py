"""What the training-data operators share: word rules, tables and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Separators of alphanumeric words once A-Z is lower case: every other ASCII character.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same separators where A-Z has not been lowered.
NOT_ALNUM_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Separators of plain words: ASCII white space. bytes.split() splits at exactly these.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces between separators; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset, a
    local session gets a temporary folder and any other one a folder in the warehouse,
    which must not be on the machines' own disks then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        named = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if ":" not in named or named.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is on a local disk, which executors do not share")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back.

    It cuts the lineage at files that outlive any executor. They go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it for as long as df has such a column; case does not tell columns apart."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def keep_rows(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, once: bool = False) -> DataFrame:
    """The rows of docs that stay; with `once`, one of each id and text.

    marked(id, key, stays) is a table with a row for each row of docs; key is the text's xxhash64.
    Ids may be null or shared. Where all rows of an id have one verdict, the id is enough
    and no text moves while few go; the other ids' rows go by id and key.
    """
    by_id = materialize(marked.groupBy("id").agg(F.count_if("stays").alias("stay"), F.count_if(~F.col("stays")).alias("go")), "verdicts")
    gone, mixed = by_id.filter("stay = 0").select(F.col("id").alias("_gone")), by_id.filter(f"stay > 0 AND go > 0{' OR stay > 1' if once else ''}").select(F.col("id").alias("_mixed"))
    gone, mixed = materialize(gone, "gone"), materialize(mixed, "mixed")  # of known sizes
    kept = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
    if mixed.limit(1).count() == 0:
        return kept
    shared, own = docs[id_col].eqNullSafe(mixed["_mixed"]), unused(docs, "own_key")
    stay = materialize(marked.filter("stays").join(mixed, F.col("id").eqNullSafe(F.col("_mixed")), "left_semi").select(F.col("id").alias("_id"), F.col("key").alias("_stay")).distinct(), "stay")
    some = kept.join(mixed, shared, "left_semi").withColumn(own, F.xxhash64(F.col(text_col)))
    some = some.join(stay, some[id_col].eqNullSafe(stay["_id"]) & (some[own] == stay["_stay"]), "left_semi")
    some = some.dropDuplicates([id_col, own]) if once else some
    return kept.join(mixed, shared, "left_anti").union(some.drop(own))


def least_hashes(df: DataFrame, hashed: str, rows: int) -> DataFrame:
    """About the rows of df with the least values of the 64-bit hash column: `rows` of them at most.

    A bound on the hash that twice as many rows should be under comes first. Each task
    would send its own `rows` least to the driver otherwise, however many tasks there are.
    """
    n = df.count()
    if n > 2 * rows:
        df = df.filter(F.col(hashed) <= -(2**63) + int(2**64 * (2 * rows / n)))
    return df.orderBy(hashed, *(c for c in df.columns if c != hashed)).limit(rows)
