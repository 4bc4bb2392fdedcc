"""Validation of raw records, stateless, so the same code serves batches and streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import MAX_DURATION, MIN_DURATION, in_range, is_blank, non_empty, parse_int
from shelfwise.operators.numbering import by_position

OK = "ok"


def classify(raw: DataFrame) -> DataFrame:
    """Add ``duration`` and ``status``: ``ok`` or the first failing field in entry order."""
    parsed = parse_int(F.col("raw_duration"))
    status = (
        F.when(~non_empty(F.col("raw_title")), "title_empty")
        .when(~non_empty(F.col("raw_host")), "host_empty")
        .when(is_blank(F.col("raw_duration")), "duration_missing")
        .when(parsed.isNull(), "duration_not_integer")
        .when(~in_range(parsed, MIN_DURATION, MAX_DURATION), "duration_out_of_range")
        .otherwise(OK)
    )
    return raw.withColumns({"duration": parsed, "status": status})


def accepted(raw: DataFrame) -> DataFrame:
    kept = classify(raw).where(F.col("status") == OK)
    return kept.select("seq", F.col("raw_title").alias("title"), F.col("raw_host").alias("host"), "duration")


def rejected(raw: DataFrame) -> DataFrame:
    """Quarantine: the raw fields as they came, and why."""
    bad = classify(raw).where(F.col("status") != OK)
    return bad.select("seq", "raw_title", "raw_host", "raw_duration", F.col("status").alias("reason"))


def collapse_retries(attempts: DataFrame, low: int = MIN_DURATION, high: int = MAX_DURATION) -> DataFrame:
    """First valid attempt of each entry; blank and invalid ones before it are passed over.

    Entries without a valid attempt are absent, as their prompt is still open. One partial
    aggregate per entry, whatever the number of attempts, and one parse per attempt.
    """
    parsed = attempts.select("entry_id", "seq", parse_int(F.col("raw")).alias("value"))
    valid_at = F.when(in_range(F.col("value"), low, high), F.col("seq"))
    return parsed.groupBy("entry_id").agg(F.min_by("value", valid_at).alias("value")).where(F.col("value").isNotNull())


def append(catalogue: DataFrame, batch: DataFrame) -> DataFrame:
    """Add accepted records (seq, title, host, duration) at the end, in ``seq`` order; duplicates stay."""
    last = catalogue.select(F.max("pos")).scalar()
    new = by_position(batch, "seq", "__n")
    placed = new.withColumn("pos", F.coalesce(last, F.lit(-1)) + F.col("__n"))
    columns = ("pos", "title", "host", "duration")
    return catalogue.select(*columns).unionByName(placed.select(*columns))
