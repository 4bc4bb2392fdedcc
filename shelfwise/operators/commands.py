"""Replay of command logs (1 add, 2 view, 3 search, 4 sort, 5 exit) from many sessions.

A list changes only by adds and sorts, and only the last sort before a command matters: records
added before it stand first by (duration, add order), later ones follow in add order. So each
command's outcome follows from running aggregates; nothing is replayed row by row.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import (
    FIRST_CHOICE, LAST_CHOICE, MAX_DURATION, MIN_DURATION, in_range, non_empty, parse_int,
)
from shelfwise.operators.numbering import least_of_key, number_rows, position_bucket, running

ADD, VIEW, SEARCH, SORT, EXIT = 1, 2, 3, 4, 5
#: Commands of a session that one task replays; sessions with more are split.
_ROWS_PER_TASK = 5_000_000
#: Lines of a list that a view joins at a time, and records of a list that are ranked together.
_LINES_PER_BLOCK = 10_000
#: Records of a list that a view meets at once, within its session, instead of block by block.
_SHORT_LIST = 1_000


def _by_heat(commands: DataFrame, replay: Callable[[DataFrame, bool, int], DataFrame]) -> DataFrame:
    """Replays sessions of usual length in one window each, and only those measured to be longer
    than one task takes in two levels. Reads the session column first; the ids of hot sessions are
    at most one for every _ROWS_PER_TASK commands. ``replay`` is told the longest session's length."""
    sizes = commands.groupBy("session_id").count()
    hot = F.when(F.col("count") > _ROWS_PER_TASK, F.struct("session_id"))
    longest, ids = sizes.agg(F.max("count"), F.collect_list(hot)).first()
    if not ids:
        return replay(commands, False, longest or 0)
    ids = F.broadcast(commands.sparkSession.createDataFrame(ids, commands.select("session_id").schema))
    match = commands["session_id"].eqNullSafe(ids["session_id"])
    cold, long = commands.join(ids, match, "left_anti"), commands.join(ids, match, "left_semi")
    return replay(cold, False, longest).unionByName(replay(long, True, longest))


def _bucket(rows: DataFrame, order: str, split: bool):
    bucket = position_bucket(rows, order) if split else None
    return F.lit(0) if bucket is None else bucket


def _written_once(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that ``spark.checkpoint.dir`` names, where one is set."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None and folder:
        context.setCheckpointDir(folder)
    return df if context.getCheckpointDir() is None else df.checkpoint()


def _with_state(commands: DataFrame, split: bool) -> DataFrame:
    """Effective commands, the exit included, with ``s_last`` (seq of the last sort before it)
    and ``n_before`` (records in the list before it)."""
    fields_ok = non_empty(F.col("title")) & non_empty(F.col("host"))
    fields_ok &= in_range(F.col("duration"), MIN_DURATION, MAX_DURATION)
    live = commands.where(in_range(F.col("choice"), FIRST_CHOICE, LAST_CHOICE) & ((F.col("choice") != ADD) | fields_ok))
    ended = least_of_key(live, ["session_id"], "first_exit", F.when(F.col("choice") == EXIT, F.col("seq")), split)
    before_exit = ended.where(F.col("first_exit").isNull() | (F.col("seq") <= F.col("first_exit"))).drop("first_exit")
    state = running(
        before_exit, ["session_id"], _bucket(before_exit, "seq", split), ["seq"],
        {"s_last": ("max", F.when(F.col("choice") == SORT, F.col("seq"))), "n_before": ("count", F.when(F.col("choice") == ADD, 1))}, split,
    )
    # an empty term is asked for again, but an empty list answers before any term
    state = state.where((F.col("choice") != SEARCH) | non_empty(F.col("title")) | (F.col("n_before") == 0))
    return _written_once(state) if split else state  # values in two levels read it again and again


def parse_choices(commands: DataFrame) -> DataFrame:
    """A log whose choices are still text, as they were typed: each is read as a leading integer.
    What is no integer becomes null and has no effect."""
    return commands.withColumn("choice", parse_int(F.col("choice")))


def effective(commands: DataFrame) -> DataFrame:
    kept = _by_heat(commands, lambda log, split, _: _with_state(log, split)).where(F.col("choice") != EXIT)
    return kept.select("session_id", "seq", "choice", "title", "host", "duration")


def _answered(state: DataFrame, split: bool) -> DataFrame:
    """Adds ``hit`` (duration, add_seq, host), what a search finds; null for a miss and for others.

    Adds and searches of a title meet in one order: a search stands at the moment of its last
    sort and takes the least (duration, seq) added by then, or else the first record of that
    title if it was added before the search itself. Other commands stand among them without
    effect, so that all rows stay in one table, dealt by session once.
    """
    is_add, is_search = F.col("choice") == ADD, F.col("choice") == SEARCH
    placed = state.withColumn("at", F.when(is_search, F.coalesce("s_last", F.lit(-1))).otherwise(F.col("seq")))
    by_sort = F.struct("duration", F.col("seq").alias("add_seq"), "host")
    by_entry = F.struct(F.col("seq").alias("add_seq"), "duration", "host")
    key = ["session_id", "title"]
    measures = {"sorted": ("min", F.when(is_add, by_sort))}
    sorted_in = running(placed, key, _bucket(placed, "at", split), ["at", "choice"], measures, split)
    found = least_of_key(sorted_in, key, "entered", F.when(is_add, by_entry), split)
    late = F.when(F.col("entered.add_seq") < F.col("seq"), F.struct("entered.duration", "entered.add_seq", "entered.host"))
    return found.withColumn("hit", F.when(is_search, F.coalesce("sorted", late)))


def _search_outcome():
    return F.when(F.col("n_before") == 0, "empty").when(F.col("hit").isNull(), "not_found").otherwise("found")


def replay_search(commands: DataFrame) -> DataFrame:
    """What each search would have shown at that moment."""
    def replay(log: DataFrame, split: bool, _: int) -> DataFrame:
        asked = _with_state(log, split).where(F.col("choice").isin(ADD, SEARCH))
        return _answered(asked, split).where(F.col("choice") == SEARCH)

    return _by_heat(commands, replay).select(
        "session_id", "seq", F.col("title").alias("term"), _search_outcome().alias("outcome"),
        F.col("hit.host").alias("host"), F.col("hit.duration").alias("duration"),
    )


_RECORD = ("title", "host", "duration")


def _epochs(state: DataFrame, views: DataFrame) -> DataFrame:
    """(of_session, epoch, records) of each sort that a view shows, with the number of records it
    has sorted."""
    seen = views.where("s_last IS NOT NULL").select("session_id", F.col("s_last").alias("seq")).distinct()
    sorts = state.where((F.col("choice") == SORT) & (F.col("n_before") > 0)).join(seen, ["session_id", "seq"], "left_semi")
    return sorts.select(F.col("session_id").alias("of_session"), F.col("seq").alias("epoch"), F.col("n_before").alias("records"))


def _sorted_lines(epochs: DataFrame, adds: DataFrame, split: bool, max_lines: int | None) -> DataFrame:
    """(session_id, epoch, ordinal, add_seq, record) of the lists as each sort that a view shows
    has left them: ranked once a sort, whatever the number of views.

    A sort meets the records in blocks by their place in the log, so a long session is many keys.
    """
    block = F.floor(F.col("add_index") / _LINES_PER_BLOCK)
    last = F.floor((F.col("records") - 1) / _LINES_PER_BLOCK)
    epochs = epochs.withColumn("of_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    records = adds.withColumn("block", block)
    met = records.join(epochs, (F.col("session_id") == F.col("of_session")) & (F.col("block") == F.col("of_block")) & (F.col("add_index") < F.col("records")))
    buckets = [F.col("duration"), F.col("block")] if split else []
    ranked = number_rows(met, buckets, ["duration", "add_index"], "ordinal", ["session_id", "epoch"])
    if max_lines is not None:
        ranked = ranked.where(F.col("ordinal") <= max_lines)
    return ranked.select("session_id", "epoch", "ordinal", "add_seq", *_RECORD)


def _short_lines(log: DataFrame) -> DataFrame:
    """The views of lists of up to _SHORT_LIST records. A view meets the records of its session and
    numbers them by itself: all stays where the log was dealt by session."""
    state = _with_state(log, False)
    n = F.col("n_before")
    views = state.where((F.col("choice") == VIEW) & n.between(1, _SHORT_LIST)).select("session_id", "seq", "s_last")
    adds = state.where((F.col("choice") == ADD) & (n < _SHORT_LIST))
    adds = adds.select(F.col("session_id").alias("of_session"), F.col("seq").alias("add_seq"), *_RECORD)
    met = views.join(adds, (F.col("session_id") == F.col("of_session")) & (F.col("add_seq") < F.col("seq")))
    in_sort = F.coalesce(F.col("add_seq") < F.col("s_last"), F.lit(False))
    place = Window.partitionBy("session_id", "seq").orderBy(~in_sort, F.when(in_sort, F.col("duration")), "add_seq")
    return met.withColumn("ordinal", F.row_number().over(place).cast("long"))


def _lines(log: DataFrame, split: bool, max_lines: int | None, longer_than: int = 0) -> DataFrame:
    state = _with_state(log, split)
    views = state.where((F.col("choice") == VIEW) & (F.col("n_before") > longer_than))
    adds = state.where(F.col("choice") == ADD).select("session_id", "s_last", F.col("seq").alias("add_seq"), F.col("n_before").alias("add_index"), *_RECORD)
    shown = F.col("n_before") if max_lines is None else F.least("n_before", F.lit(max_lines).cast("long"))
    # records added after the last sort follow in the order they came: their place never changes
    late = adds.select("session_id", F.coalesce("s_last", F.lit(-1)).alias("epoch"), (F.col("add_index") + 1).alias("ordinal"), "add_seq", *_RECORD)
    late = late if max_lines is None else late.where(F.col("ordinal") <= max_lines)
    lines = late.unionByName(_sorted_lines(_epochs(state, views), adds, split, max_lines))
    lines = lines.withColumn("block", F.floor((F.col("ordinal") - 1) / _LINES_PER_BLOCK)).withColumnRenamed("session_id", "of_session").withColumnRenamed("epoch", "of_epoch")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((shown - 1) / _LINES_PER_BLOCK)))
    asked = views.where(shown > 0).select("session_id", "seq", F.coalesce("s_last", F.lit(-1)).alias("epoch"), blocks.alias("asked_block"))
    match = (F.col("session_id") == F.col("of_session")) & (F.col("epoch") == F.col("of_epoch")) & (F.col("asked_block") == F.col("block"))
    return asked.join(lines, match & (F.col("add_seq") < F.col("seq")))


def replay_view(commands: DataFrame, max_lines: int | None = None) -> DataFrame:
    """The numbered list that each view would have shown; the output is as long as those lists.

    Short lists are numbered view by view. Views of longer ones share the ranks of a sort; records
    added since then have the place at which they were added. Views meet their lines by session, sort and block of lines, so neither a long list
    nor a session with many views is one key. ``max_lines`` shows only the head of each list, and
    cuts the lists before views meet them.
    """
    columns = ("session_id", "seq", "ordinal", *_RECORD)

    def replay(log: DataFrame, split: bool, longest: int) -> DataFrame:
        if split or max_lines is not None:
            return _lines(log, split, max_lines).select(*columns)
        short = _short_lines(log).select(*columns)
        if longest <= _SHORT_LIST:
            return short
        return short.unionByName(_lines(log, split, None, _SHORT_LIST).select(*columns))

    return _by_heat(commands, replay)


def outcomes(commands: DataFrame) -> DataFrame:
    """One row per effective command, with what it led to."""
    told = (
        F.when(F.col("choice") == ADD, "added")
        .when(F.col("choice") == EXIT, "exiting")
        .when(F.col("choice") == SEARCH, _search_outcome())
        .when(F.col("n_before") == 0, "empty")
        .when(F.col("choice") == VIEW, "listed")
        .otherwise("sorted")
    )
    done = _by_heat(commands, lambda log, split, _: _answered(_with_state(log, split), split))
    return done.select("session_id", "seq", "choice", told.alias("outcome"))
