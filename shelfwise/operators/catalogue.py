"""Queries over a catalogue (pos, title, host, duration), an ordered bag of records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import listing_line, non_empty
from shelfwise.operators.numbering import by_duration, by_position

COLUMNS = ("pos", "title", "host", "duration")
#: Hashes that tell titles apart before a batch search: at most so many numbers are broadcast.
TITLE_HASHES = 1 << 20


def project(catalogue: DataFrame, *columns: str) -> DataFrame:
    return catalogue.select(*(columns or COLUMNS[1:]))


def listing(catalogue: DataFrame) -> DataFrame:
    """Every record with its 1-based place in the list."""
    return by_position(catalogue, "pos", "ordinal").select("ordinal", "title", "host", "duration")


def listing_lines(catalogue: DataFrame) -> DataFrame:
    line = listing_line(*(F.col(c) for c in ("ordinal", "title", "host", "duration")))
    return listing(catalogue).select("ordinal", line.alias("line"))


def find_title(catalogue: DataFrame, term: str) -> DataFrame:
    """First record whose title equals the term exactly; no row if there is none."""
    return catalogue.where(F.col("title") == term).orderBy("pos").limit(1).select(*COLUMNS)


def _asked_for(catalogue: DataFrame, asked: DataFrame) -> DataFrame:
    """The records whose title may be a term, by a hash of it: a filter of fixed size, so it can be
    sent to every task. It lets some others through, nearly all once terms are many millions."""
    def place(text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(TITLE_HASHES))

    terms = asked.select(place(F.col("term")).alias("__place")).distinct()
    return catalogue.join(F.broadcast(terms), place(F.col("title")) == F.col("__place"), "left_semi")


def find_titles(catalogue: DataFrame, probes: DataFrame) -> DataFrame:
    """Outcome of many searches. A probe with an empty term is no search and is left out, unless
    the catalogue is empty, which is told before a term is asked for.

    Records that no probe can ask for are left out first. The rest is reduced to the first record
    of each title before the join, so a title that fills much of the catalogue costs one partial
    aggregate and never a skewed join.
    """
    size = catalogue.select(F.count("*")).scalar()
    asked = probes.where(non_empty(F.col("term")) | (size == 0))
    first = _asked_for(catalogue, asked).groupBy("title").agg(F.min(F.struct("pos", "host", "duration")).alias("hit"))
    outcome = F.when(size == 0, "empty").when(F.col("hit").isNull(), "not_found").otherwise("found")
    return asked.join(first, asked.term == first.title, "left").select(
        "probe_id", "term", outcome.alias("outcome"), "hit.pos", "hit.host", "hit.duration"
    )


def sort_by_duration(catalogue: DataFrame) -> DataFrame:
    """Ascending; equal durations keep their order."""
    return catalogue.select(*COLUMNS).orderBy("duration", "pos")


def resequence_by_duration(catalogue: DataFrame) -> DataFrame:
    """The stored form of a sort: positions are rewritten, so later queries see the new order."""
    return by_duration(catalogue, "__n").select(F.col("__n").alias("pos"), "title", "host", "duration")


def _before(column: str, value, then: Column) -> Column:
    """Whether a row stands before one with this value, nulls first; ``then`` decides for equal ones."""
    c = F.col(column)
    return c.isNull() & then if value is None else c.isNull() | (c < value) | ((c == value) & then)


def find_title_after_sort(catalogue: DataFrame, term: str) -> DataFrame:
    """What a search finds once the list is sorted by duration, with its place there; no row if
    there is none. Same as searching the re-sequenced list, without numbering it: the record is
    found by its title, and its place is the number of records before it, a count that reads two
    columns."""
    hit = catalogue.where(F.col("title") == term).orderBy("duration", "pos").limit(1).select(*COLUMNS).first()
    if hit is None:
        return catalogue.where(F.lit(False)).select(F.lit(0).cast("long").alias("pos"), *COLUMNS[1:])
    earlier = catalogue.where(_before("duration", hit.duration, _before("pos", hit.pos, F.lit(False))))
    kinds = {f.name: f.dataType for f in catalogue.schema}
    found = [F.lit(hit[c]).cast(kinds[c]).alias(c) for c in COLUMNS[1:]]
    return earlier.agg((F.count("*") + 1).alias("pos")).select("pos", *found)


def last_corrections(corrections: DataFrame) -> DataFrame:
    """One row per position of a feed: the value that was written last to each field, by ``seq``.
    Fields are on their own, as each correction may set any of them; null sets nothing. Of
    corrections with the same seq the greatest value counts. Partial aggregates, so a position
    that is corrected very often is no burden."""
    written = {c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))) for c in (f"new_{x}" for x in COLUMNS[1:])}
    return corrections.groupBy("pos").agg(*[last[c].alias(c) for c, last in written.items()])


def correct(catalogue: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overwrite single attributes by position, unvalidated; null leaves the old value. Of several
    corrections of a field the last one stands. Every record stays one record; corrections of
    positions that don't exist have no effect."""
    fixes = last_corrections(corrections).withColumnRenamed("pos", "fix_pos")
    joined = catalogue.join(fixes, F.col("pos") == F.col("fix_pos"), "left")
    new = [F.coalesce(f"new_{c}", c).alias(c) for c in COLUMNS[1:]]
    return joined.select("pos", *new)


def fill_defaults(records: DataFrame) -> DataFrame:
    return records.fillna({"title": "", "host": "", "duration": 0})
