"""Two-pass external shuffle into training shards.

Pass one scatters whole records into memory-sized buckets by a seeded hash. Pass two applies a
seeded Fisher-Yates shuffle to each bucket in memory. Buckets are laid end to end, and the
record at global place p goes to shard p mod n, slot p div n: row counts of shards differ by at
most one, and neighbours in a shard come from all over the input.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import file_row

SHARDS, SEED = 16, 20_240
#: Aim for the text bytes of a bucket: it is shuffled in the memory of one Python worker.
BUCKET_BYTES = 4 << 20
#: Buckets whose counts one task sums up.
STRETCH = 4096
_LAW = "rows"


def _fisher_yates(seed: int, shards: int):
    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        # a fixed order first: an exchange delivers rows in any order
        bucket = bucket.sort_by([(c, "ascending") for c in ("doc_id", "text", "file", "at")])
        order = np.arange(len(bucket))
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)  # Fisher-Yates
        place = bucket["offset"][0].as_py() + np.arange(len(bucket), dtype=np.int64)
        return pa.table({"doc": bucket["doc"].take(pa.array(order)), "shard": pa.array((place % shards).astype(np.int32)), "slot": pa.array(place // shards)})

    return shuffle


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, row: Column | None = None) -> DataFrame:
    """doc (the whole row), shard and slot (gapless from 0 in each shard).

    The name of a row decides its bucket and its place in it, so both passes and every retry
    agree: ``row`` (see ``common.file_row``), or else its id and text, so that the same rows go
    to the same places however they are stored; rows equal in both then share a bucket. Null ids
    and texts are ordinary values, very long texts are moved whole, column names clash with nothing,
    an empty table gives no rows.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    doc, none = F.struct("*").alias("doc"), F.lit(None)
    if row is None:
        named = docs.select(doc, "doc_id", "text", none.cast("binary").alias("file"), none.cast("long").alias("at"))
    else:
        named = docs.select(doc, none.cast("long").alias("doc_id"), none.cast("string").alias("text"), row["file"].alias("file"), row["at"].alias("at"))
    bucket = F.pmod(F.xxhash64("doc_id", "text", "file", "at", F.lit(seed)), F.lit(buckets)).cast("int")
    placed = named.withColumn("bucket", bucket)
    # offsets by running sums over stretches of buckets, then over the stretches
    stretch = F.floor(F.col("bucket") / STRETCH).alias("stretch")
    counts = placed.groupBy(stretch, "bucket").agg(F.count("*").alias("n"))
    before = [Window.orderBy("stretch"), Window.partitionBy("stretch").orderBy("bucket")]
    earlier, inside = (F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for w in before)
    starts = counts.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", earlier.alias("start"))
    offsets = counts.withColumn("inside", inside).join(starts, "stretch").select("bucket", (F.col("start") + F.col("inside")).alias("offset"))
    fields = [T.StructField("doc", docs.schema), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    # joined before the grouping: both need rows dealt by bucket, so the texts move once
    return placed.join(offsets, "bucket").groupBy("bucket").applyInArrow(_fisher_yates(seed, shards), T.StructType(fields))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard (``shard=0``...), rows in slot order; several files a shard where it is
    large. The rows keep their columns in ``doc``, beside ``slot``."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharded = shuffle_into_shards(docs, row=file_row(docs))
    text = F.coalesce("doc.text", F.lit(""))
    return sharded.select(
        "doc.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(_LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
