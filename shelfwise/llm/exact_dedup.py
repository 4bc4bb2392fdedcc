"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. A batch
is reduced to one row per digest, anti-joined with the index by sort-merge (the index side is
not shuffled, as it is bucketed on the join key) and what is new is appended under the name of
the batch. Digests that stand there under its own name are new to a batch, so a job that failed
after the append is repeated under the same name and keeps the same rows. A load is dealt over
several batches in the order of the ids, each of which meets the digests of those before it.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import file_row, least_row, materialise, packed, scratch_root, without

#: Buckets of an index; one file each per batch. Size for 128 MB or more in each at full scale.
BUCKETS = 64
#: Batches that a load is dealt over.
PARTS = 2
_BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """Digests seen so far, the id of the document that was kept for each, and the batch it came in.

    The number of buckets is written beside the data when the index is made, and holds from then
    on: with another one, digests would be looked for in the wrong buckets and not be found.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        """Opens the index at a shared location, or makes it there with so many buckets (BUCKETS
        unless given). Opened with a number that is not its own it raises; see ``rebuild``."""
        self.spark, self.buckets = spark, _layout(spark, location, buckets)
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
        quoted = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def new_digests(self, firsts: DataFrame, batch: str) -> DataFrame:
        """Rows of a batch whose digest no other batch holds, dealt like the index's buckets."""
        others = self.read().where(F.col("batch") != batch)
        return firsts.repartition(self.buckets, "digest").hint("merge").join(others, "digest", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Add the batch's new digests, but for those that it has appended in an earlier attempt."""
        own = self.read().where(F.col("batch") == batch)
        rows = new.select("digest", "keep_id", F.lit(batch).alias("batch")).join(own, "digest", "left_anti")
        # a task for each bucket, so that it writes one file of it: buckets are told by this hash
        dealt = rows.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
        dealt.sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _rows_at(spark: SparkSession, path: str, schema: str) -> list | None:
    """The rows of a small table, or None if there is nothing at its place."""
    try:
        return spark.read.schema(schema).parquet(path).take(2)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _layout(spark: SparkSession, location: str, buckets: int | None) -> int:
    """The number of buckets of the index at a location, written there if it is new. The name of
    the file begins with a line, so that readers of the table pass it over."""
    path = f"{location}/_layout"
    kept = _rows_at(spark, path, "buckets int")
    if not kept:  # none, or nothing in it yet
        if _rows_at(spark, location, "digest string"):
            raise ValueError(f"the digests at {location} don't say in how many buckets they are; rebuild the index")
        spark.range(0, 1, 1, 1).select(F.lit(buckets or BUCKETS).cast("int").alias("buckets")).write.mode("overwrite").parquet(path)
        return buckets or BUCKETS
    if buckets not in (None, kept[0].buckets):
        raise ValueError(f"the index at {location} has {kept[0].buckets} buckets, not {buckets}; rebuild it for another number")
    return kept[0].buckets


def rebuild(spark: SparkSession, location: str, new_location: str, buckets: int) -> DigestIndex:
    """The same digests in an index of another number of buckets, at a new location."""
    index = DigestIndex(spark, new_location, buckets)
    old = spark.read.schema("digest string, keep_id long, batch string").parquet(location)
    dealt = old.repartitionById(buckets, F.pmod(F.hash("digest"), F.lit(buckets)))
    dealt.sortWithinPartitions("digest").write.insertInto(index.table)
    spark.catalog.refreshTable(index.table)
    return index


def firsts_of(digests: DataFrame) -> DataFrame:
    """One row per digest: its least row, by partial aggregates."""
    groups = digests.groupBy("digest").agg(F.min(least_row()).alias("first"))
    return groups.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))


def _part(digests: DataFrame, parts: int) -> Column:
    """0 to parts - 1 by equal ranges of doc_id, in its order; null ids last. The same for the same rows."""
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(parts - 1)
    share = (F.col("doc_id").cast("double") - float(low)) / (float(high) - float(low) + 1)
    return F.coalesce(F.least(F.floor(share * parts).cast("int"), F.lit(parts - 1)), F.lit(parts - 1))


def decide(digests: DataFrame, index: DigestIndex, batch: str, parts: int) -> DataFrame:
    """(digest, keep_id, keep_row) for each digest of the rows (doc_id, row, digest), which are
    appended to the index; keep_row is null if an earlier batch holds the text."""
    part, kept = _part(digests, parts), None
    for p in range(parts):  # in the order of the ids, so the first to come has the smallest
        name = f"{batch}/{p}"
        new = materialise(index.new_digests(firsts_of(digests.where(part == p)), name), "new-digests")
        index.append(new, name)
        kept = new if kept is None else kept.unionByName(new)
    held = digests.select("digest").distinct().join(index.read(), "digest").select("digest", "keep_id")
    return held.join(kept.select("digest", "keep_row"), "digest", "left")


def _digests(rows: DataFrame) -> DataFrame:
    return materialise(rows.select("doc.doc_id", "row", digest(F.col("doc.text")).alias("digest")), "digests")


def _decided(digests: DataFrame, index: DigestIndex | None, batch: str | None, parts: int) -> DataFrame:
    if (index is None) != (batch is None):
        raise ValueError("an index needs the name of the batch, which a repeated job gives again")
    spark = digests.sparkSession
    used = index or DigestIndex(spark, f"{scratch_root(spark)}/digest-index-{uuid.uuid4().hex}")
    out = materialise(decide(digests, used, batch or "load", parts), "decided")
    if index is None:
        used.close()
    return out


def group_report(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, parts: int = PARTS, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (among these rows), kept, text_sha256.

    Null texts count as empty. Of equal texts exactly one row stays: the smallest doc_id, null
    ids last, and of rows with the same id the first in the order of ``row``. An empty table gives
    no rows; extra columns are ignored. Very long texts are hashed whole. Without an index a new
    one is used. A digest that fills a large share of the rows is left to adaptive execution, which
    splits the rows of such joins.
    """
    digests = _digests(packed(docs, row))
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    decided = _decided(digests, index, batch, parts).join(sizes, "digest")
    return digests.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, parts: int = PARTS, row: Column | None = None) -> DataFrame:
    """The documents that stay, whole, with their own columns, whatever their names. Cases as in
    ``group_report``; only digests are shuffled, and texts too if a great many rows go."""
    rows = packed(docs, row)
    digests = _digests(rows)
    kept = _decided(digests, index, batch, parts).where("keep_row IS NOT NULL").select(F.col("keep_row").alias("row"))
    return without(rows, digests.join(kept, "row", "left_anti"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_report(docs, row=file_row(docs))


OP9_SQL = r"""WITH n AS (SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)"""
