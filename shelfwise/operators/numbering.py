"""Gapless ordinals and running aggregates without sending a table, or a hot key, through one task."""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering task takes, about.
ROWS_PER_BUCKET = 1_000_000
#: Ranges that quantiles cut the positions into, and the most buckets, as their counts meet in one task.
RANGES, MAX_BUCKETS = 64, 1 << 20


def position_bucket(df: DataFrame, pos: str) -> Column | None:
    """A number that grows with ``pos``, for buckets of about ROWS_PER_BUCKET rows; None if one task
    can take them all. Reads the column twice.

    Ranges between approximate quantiles hold about equal shares of the rows, however sparse or
    uneven the positions are, and each is cut evenly, so the number of buckets follows the rows.
    """
    n, low, high = df.agg(F.count("*"), F.min(pos), F.max(pos)).first()
    if n <= ROWS_PER_BUCKET or low is None:
        return None
    cuts = df.agg(F.percentile_approx(pos, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    edges = sorted({low, *cuts})
    per = min(math.ceil(n / (ROWS_PER_BUCKET * len(edges))), MAX_BUCKETS // RANGES)
    at = sum(((F.col(pos) >= F.lit(e)).cast("int") for e in edges[1:]), F.when(F.col(pos).isNotNull(), 0))
    start, end = (F.element_at(F.array(*map(F.lit, map(float, x))), at + 1) for x in (edges, [*edges[1:], high + 1]))
    inside = F.floor((F.col(pos).cast("double") - start) / (end - start) * per)
    return at * per + F.least(inside, F.lit(per - 1))


def _offsets(counts: DataFrame, within: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows before each bucket (``within``, ``keys``), from its count ``__n``: sums over the buckets
    of one parent, then over the parents, level by level. Only the counts of the first key meet."""
    out, total = None, counts
    for level in range(len(keys), 0, -1):
        own, parent = [*within, *keys[:level]], [*within, *keys[: level - 1]]
        before = Window.partitionBy(*parent).orderBy(keys[level - 1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = total.select(*own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__before{level}"))
        out = sums if out is None else out.join(sums, own)
        total = total.groupBy(*parent).agg(F.sum("__n").alias("__n")) if parent else total
    added = sum((F.col(f"__before{level}") for level in range(2, len(keys) + 1)), F.col("__before1"))
    return out.select(*[F.col(k).alias(f"{k}o") for k in (*within, *keys)], added.alias("__offset"))


def number_rows(df: DataFrame, buckets: Sequence[Column], order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Add a 1-based ordinal ``name`` over the order (``buckets``, ``order``), for each value of the
    columns ``within`` on its own.

    The buckets must be a prefix of the order, without nulls. Rows are numbered inside their bucket
    and an offset is added, worked out from the buckets' row counts level by level: one row for each
    value of the first bucket meets in one task, however many buckets there are below. Without
    buckets all rows (``within``) are numbered in one task.
    """
    if not buckets:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)).cast("long"))
    keys = [f"__b{i}" for i in range(len(buckets))]
    keyed = df.withColumns(dict(zip(keys, buckets, strict=True)))
    offsets = _offsets(keyed.groupBy(*within, *keys).agg(F.count("*").alias("__n")), within, keys)
    inside = F.row_number().over(Window.partitionBy(*within, *keys).orderBy(*order)).cast("long")
    # no nulls, so plain equality: the rows stay where the window has put them
    match = [F.col(k) == F.col(f"{k}o") for k in (*within, *keys)]
    return (
        keyed.withColumn("__inside", inside)
        .join(offsets, match)
        .withColumn(name, F.col("__offset") + F.col("__inside"))
        .drop(*keys, *[f"{k}o" for k in (*within, *keys)], "__inside", "__offset")
    )


def _position_buckets(df: DataFrame, pos: str) -> list[Column]:
    bucket = position_bucket(df, pos)
    return [] if bucket is None else [F.coalesce(bucket, F.lit(-1))]  # null positions come first


def by_position(df: DataFrame, pos: str, name: str) -> DataFrame:
    return number_rows(df, _position_buckets(df, pos), [pos], name)


def by_duration(df: DataFrame, name: str) -> DataFrame:
    """Ordinal by (duration, pos), nulls first. A hot duration is cut further by position; stretches
    of durations, a single one if all are valid, bound what meets in one task should corrections
    have left any whole number."""
    bucket = _position_buckets(df, "pos")
    duration = F.coalesce(F.col("duration").cast("long"), F.lit(-(1 << 31) - 1))
    return number_rows(df, [F.floor(duration / 4096), duration, *bucket] if bucket else [], ["duration", "pos"], name)


#: How a running measure is summed up over a bucket, and how two stretches of it combine.
_KINDS = {
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
}


def running(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], measures: Mapping[str, tuple[str, Column]], split: bool
) -> DataFrame:
    """Add measures (name -> (min | max | count, column)) over the rows of the key before each row.

    Without ``split`` a key is one window: one shuffle. With it each ``bucket``, which must be a
    prefix of the order, is scanned on its own, and one row per bucket carries the sums of those
    before it: a hot key is spread over tasks, at the price of reading the input once more.
    """
    if not split:
        past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: _KINDS[k][0](c).over(past) for n, (k, c) in measures.items()})
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("__b", bucket)
    totals = cut.groupBy(*keys, "__b").agg(*[_KINDS[k][0](c).alias(f"__t_{n}") for n, (k, c) in measures.items()])
    past = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"),
        *[_KINDS[k][1](f"__t_{n}").over(before).alias(f"__p_{n}") for n, (k, _) in measures.items()],
    )
    own = cut.withColumns({f"__i_{n}": _KINDS[k][0](c).over(inside) for n, (k, c) in measures.items()})
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__b").eqNullSafe(F.col("__kb"))]
    out = own.join(past, match)
    out = out.withColumns({n: _KINDS[k][2](F.col(f"__p_{n}"), F.col(f"__i_{n}")) for n, (k, _) in measures.items()})
    return out.select(*df.columns, *measures)


def least_of_key(df: DataFrame, keys: Sequence[str], name: str, column: Column, split: bool) -> DataFrame:
    """Add the least value of the column over all rows of the key; ``split`` as in running()."""
    if not split:
        return df.withColumn(name, F.min(column).over(Window.partitionBy(*keys)))
    least = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min(column).alias(name))
    return df.join(least, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]).select(*df.columns, name)
