"""One entry per catalogue operator, over the derived inputs of ``shelfwise.sources``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import sources as src
from shelfwise.functions import MAX_DURATION, MIN_DURATION, found_line, in_range, non_empty, parse_int
from shelfwise.operators import catalogue as cat
from shelfwise.operators import commands as cmd
from shelfwise.operators import intake

Query = Callable[[SparkSession, str], DataFrame]
#: The title that the single-term searches look for, and where the append query cuts the catalogue.
TERM, APPEND_FROM = "red widget", 1500


def parse_int_query(spark, d):
    return src.raw_records(spark, d).select("seq", "raw_duration", parse_int(F.col("raw_duration")).alias("parsed"))


def range_check(spark, d):
    ok = in_range(F.col("parsed"), MIN_DURATION, MAX_DURATION)
    return parse_int_query(spark, d).select("seq", "parsed", ok.alias("in_range"))


def nonempty_check(spark, d):
    raw = src.raw_records(spark, d)
    return raw.select("seq", non_empty(F.col("raw_title")).alias("title_ok"), non_empty(F.col("raw_host")).alias("host_ok"))


def intake_classify(spark, d):
    return intake.classify(src.raw_records(spark, d)).select("seq", "duration", "status")


def append_batch(spark, d):
    whole = src.catalogue(spark, d)
    batch = whole.where(F.col("pos") >= APPEND_FROM).withColumnRenamed("pos", "seq")
    return intake.append(whole.where(F.col("pos") < APPEND_FROM), batch)


def title_lookup_line(spark, d):
    hit = cat.find_title(src.catalogue(spark, d), TERM)
    return hit.select("pos", found_line(F.col("title"), F.col("host"), F.col("duration")).alias("line"))


def queries() -> dict[str, Query]:
    return {
        "parse_int": parse_int_query,
        "range_check": range_check,
        "nonempty_check": nonempty_check,
        "intake_classify": intake_classify,
        "intake_accepted": lambda s, d: intake.accepted(src.raw_records(s, d)),
        "intake_rejected": lambda s, d: intake.rejected(src.raw_records(s, d)),
        "retry_collapse": lambda s, d: intake.collapse_retries(src.attempts(s, d)),
        "append_batch": append_batch,
        "project_columns": lambda s, d: cat.project(src.catalogue(s, d)),
        "listing_ordinal": lambda s, d: cat.listing(src.catalogue(s, d)),
        "listing_lines": lambda s, d: cat.listing_lines(src.catalogue(s, d)),
        "title_lookup": lambda s, d: cat.find_title(src.catalogue(s, d), TERM),
        "title_lookup_line": title_lookup_line,
        "title_lookup_batch": lambda s, d: cat.find_titles(src.catalogue(s, d), src.probes(s, d)),
        "sort_by_duration": lambda s, d: cat.sort_by_duration(src.catalogue(s, d)),
        "resequence_by_duration": lambda s, d: cat.resequence_by_duration(src.catalogue(s, d)),
        "title_lookup_after_sort": lambda s, d: cat.find_title_after_sort(src.catalogue(s, d), TERM),
        "apply_corrections": lambda s, d: cat.correct(src.catalogue(s, d), src.corrections(s, d)),
        "apply_correction_feed": lambda s, d: cat.correct(src.catalogue(s, d), src.correction_feed(s, d)),
        "record_defaults": lambda s, d: cat.fill_defaults(src.incomplete_records(s, d)),
        "commands_effective": lambda s, d: cmd.effective(src.commands(s, d)),
        "replay_search": lambda s, d: cmd.replay_search(src.commands(s, d)),
        "replay_view": lambda s, d: cmd.replay_view(src.commands(s, d)),
        "command_outcomes": lambda s, d: cmd.outcomes(src.commands(s, d)),
    }
