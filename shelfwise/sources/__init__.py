"""Readers and writers, and the catalogue inputs derived from the supplied tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """Range-partitioned by position, so a reader can prune by ``pos`` and list order is file order."""
    catalogue.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("host"), F.col("p_size").cast("int").alias("duration"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = seq % 10
    duration = (
        F.when(kind == 0, "abc").when(kind == 1, "0").when(kind == 2, "1001")
        .when(kind == 3, F.concat(size, F.lit("min"))).when(kind == 4, F.concat(F.lit("  "), size))
        .when(kind == 5, F.concat(size, F.lit(".7"))).when(kind == 6, "99999999999")
        .when(kind == 7, "  ").otherwise(size)
    )
    return read_table(spark, sf_dir, "part").select(
        seq.alias("seq"),
        F.when(seq % 11 == 0, "").when(seq % 11 == 1, " ").otherwise(F.col("p_name")).alias("raw_title"),
        F.when(seq % 13 == 0, "").otherwise(F.col("p_brand")).alias("raw_host"),
        duration.alias("raw_duration"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    number = (F.floor("value").cast("int") - 20).cast("string")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entry_id"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "abc").when(kind == "view", "  ").otherwise(number).alias("raw"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles of every third record, and three terms that match nothing."""
    part = read_table(spark, sf_dir, "part")
    named = part.where(F.col("p_partkey") % 3 == 0).groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("probe_id"))
    misses = spark.createDataFrame([(-1, "no such title"), (-2, "Red Widget"), (-3, "red widget ")], "probe_id long, term string")
    return named.select("probe_id", "term").unionByName(misses)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").where((pos % 17).isin(0, 1, 2, 3)).select(
        pos.alias("pos"), pos.alias("seq"), F.when(pos % 17 == 0, "").alias("new_title"),
        F.when(pos % 17 == 2, F.concat(F.lit("guest of "), F.col("p_brand"))).when(pos % 17 == 3, "").alias("new_host"), F.when(pos % 17 == 1, 5000).alias("new_duration"),
    )


def correction_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections in the order they came, many for a position: some set two fields, some none."""
    kind, seq = F.col("event_type"), F.col("event_id")
    named = F.when(seq % 11 == 0, "").otherwise(F.concat(F.lit("title "), (seq % 97).cast("string")))
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pos"), seq.alias("seq"), F.when(kind.isin("click", "signup"), named).alias("new_title"),
        F.when(kind.isin("view", "signup"), F.concat(F.lit("host "), (seq % 89).cast("string"))).alias("new_host"),
        F.when(kind == "purchase", (F.floor("value") * 10 - 100).cast("int")).alias("new_duration"),
    )


def incomplete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with some of each field missing, alone and together."""
    pos = F.col("pos")
    return catalogue(spark, sf_dir).select(
        "pos", F.when(pos % 5 != 0, F.col("title")).alias("title"), F.when(pos % 7 != 0, F.col("host")).alias("host"),
        F.when(pos % 4 != 0, F.col("duration")).alias("duration"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, event = F.col("event_type"), F.col("event_id")
    choice = (
        F.when(kind == "signup", 1).when(kind == "view", 2).when(kind == "click", 3).when(kind == "purchase", 4)
        .when((kind == "error") & (event % 50 == 0), 5).otherwise(9)
    )
    number = F.when(kind == "click", event % 9).otherwise(event % 7).cast("string")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), event.alias("seq"), choice.alias("choice"),
        F.concat(F.lit("t"), number).alias("title"), F.col("user_id").cast("string").alias("host"),
        (1 + F.floor("value")).cast("int").alias("duration"),
    )
