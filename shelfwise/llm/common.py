"""What several corpus operators share: scratch tables, row ids and connected components."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of star contraction before giving up; it needs about the logarithm of the diameter.
MAX_ROUNDS = 60
#: Lookup tables up to this measured size are broadcast.
BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``; without it nothing is written."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a lookup table and mark it for broadcast if its measured size allows; a larger
    one is joined by shuffle."""
    table = materialise(df, name)
    return F.broadcast(table) if (table.agg(F.sum(row_bytes)).first()[0] or 0) <= limit else table


def file_row(scan: DataFrame) -> Column:
    """A name for each row of a table read straight from Parquet files: its file and its place
    there, so the same in every scan, however files are packed into tasks. Rows that a join or
    an explode has repeated share their name: give those none (see ``packed``)."""
    place = scan.metadataColumn("_metadata")
    return F.struct(F.unhex(F.md5(place["file_path"])).alias("file"), place["row_index"].alias("at"))


def packed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc, row): whole rows as structs, so that their columns clash with nothing, and a name for
    each that every later scan agrees on. ``row`` is such a name, as ``file_row`` gives; without
    it the rows are written once, together with an id drawn on the way."""
    doc = F.struct("*").alias("doc")
    if row is not None:
        return docs.select(doc, row.alias("row"))
    return materialise(docs.select(doc, F.monotonically_increasing_id().alias("row")), "rows")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of packed ``rows`` whose ``row`` is not among the dropped ones. They are not
    shuffled if the names of the dropped are measured to be small enough for a broadcast."""
    size = F.octet_length(F.to_json(F.struct("row")))
    return rows.join(broadcast_if_small(dropped.select("row"), size, "dropped"), "row", "left_anti").select("doc.*")


def least_row(doc_id: str = "doc_id", row: str = "row"):
    """Sort key of the row that stays: smallest id, nulls last, then the first row."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(row).alias("row"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it can reach.

    Alternates large-star and small-star contraction on (larger, smaller) edges. Minima are
    pre-aggregated and joined back, so a hub's edges are never gathered into one group; each
    round is written to the shared folder.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = materialise(ends.distinct(), "stars")

    def signature(df: DataFrame):
        # sums of both halves of the hash: equal for two different states by chance only
        h = F.xxhash64("u", "v")
        return df.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()

    before = signature(stars)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # a node's larger neighbours, and itself by the row of its least, if that is smaller; one join and
        # no union, here and below, as each use of a branch would repeat its whole plan in the driver
        large = both.join(least, F.col("u") == F.col("k")).where("v > u OR v = m").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        hung = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = materialise(small.select(F.inline(hung)).where("u <> v").distinct(), "stars")
        now = signature(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
