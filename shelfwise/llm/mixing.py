"""Mixing sources to target weights by proportionate-fair scheduling.

Rows of a source are cut into blocks. With weight w, block k of a source is released at slot
floor(k / w) and due by slot ceil((k + 1) / w); at each slot the released block with the
earliest deadline goes out. After any number of slots each source is then less than one block
away from its share. Weights are exact fractions, never rounded, and the order repeats after as
many slots as their least common period has. The driver deals one period, over the sources' row
counts only; blocks find their turn and their slot in it by joins, so what the driver holds does
not grow with the rows. When a source runs out, the weights of the others are scaled up and a new
phase begins, so that all rows are placed; the bound holds within each phase.
"""

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import BROADCAST_BYTES, broadcast_if_small, file_row, materialise

BLOCK_ROWS = 32
#: Slots of a period that weights are rounded to; None: they are not rounded.
PERIOD: int | None = None
#: Without given weights, a source weighs its row count to this power, in whole numbers that sum to
#: about SHARES: small ones gain, and the order repeats after about SHARES blocks.
TEMPERATURE, SHARES = 0.7, 1 << 14
#: Sources a mixture may name, as the schedule is planned over one row for each.
MAX_SOURCES = 1000
#: Rows of a bucket that one task numbers, more if there would be more buckets than this otherwise.
BUCKET_ROWS, MAX_BUCKETS = 8192, 1 << 14
#: Blocks of a source whose slots are one row of the schedule.
CHUNK = 4096
#: Rows of a mixed file at most, and at least while there are fewer files than shuffle partitions.
PART_ROWS, LEAST_PART_ROWS = 1 << 17, 1024


def quotas(weights: Mapping[str, float], period: int | None = None) -> dict[str, int]:
    """Blocks of each source in a period: its share, rounded by largest remainder, at least one.
    Without a period, the least whole numbers in exact proportion to the weights, a float being
    the decimal that it is written as."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if period is None:
        unit = lcm(*(x.denominator for x in exact.values()))
        whole = {s: int(x * unit) for s, x in exact.items()}
        common = gcd(*whole.values())
        return {s: n // common for s, n in whole.items()}
    total, period = sum(exact.values()), max(period, len(weights))
    exact = {s: period * x / total for s, x in exact.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (rest := period - sum(out.values())) != 0:  # to whom most is owed, or from whom has most beyond its share
        step = 1 if rest > 0 else -1
        able = [s for s in out if rest > 0 or out[s] > 1]
        for s in sorted(able, key=lambda s: (step * (out[s] - exact[s]), s))[: abs(rest)]:
            out[s] += step
    return out


def _deal(quota: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot, without end: earliest deadline first among released blocks."""
    period = sum(quota.values())
    ready = [(-(-period // n), s, 0) for s, n in quota.items()]  # deadline, source, its block
    heapify(ready)
    waiting: list[tuple[int, int, str, int]] = []  # release, then the same
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            heappush(ready, heappop(waiting)[1:])
        deadline, s, k = heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        yield s
        t, k, n = t + 1, k + 1, quota[s]
        release, due = k * period // n, -(-(k + 1) * period // n)
        if release <= t:
            heappush(ready, (due, s, k))
        else:
            heappush(waiting, (release, due, s, k))


def one_period(quota: Mapping[str, int]) -> list[str]:
    """The source of each slot of a period."""
    return list(islice(_deal(quota), sum(quota.values())))


def default_weights(rows: Mapping[str, int]) -> dict[str, int]:
    """Whole numbers in proportion to the row counts to the power TEMPERATURE, at least one."""
    total = sum(n**TEMPERATURE for n in rows.values())
    return {s: max(1, round(SHARES * n**TEMPERATURE / total)) for s, n in rows.items()}


@dataclass(frozen=True)
class Slots(Sequence):
    """The slot of each of a source's blocks in a phase: those dealt for one period, over and over."""

    dealt: array
    period: int
    blocks: int

    def __len__(self) -> int:
        return self.blocks

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.blocks:
            raise IndexError(k)
        turn, at = divmod(k, len(self.dealt))
        return turn * self.period + self.dealt[at]


def plan(rows: Mapping[str, int], weights: Mapping[str, float], block: int, period: int | None = None) -> list[tuple]:
    """(source, phase, first_block, end_block, start_row, slots) of each source in each phase it
    takes part in; slots[k] is the slot of its k-th block in the phase."""
    left = {s: -(-n // block) for s, n in rows.items() if n}
    done = dict.fromkeys(left, 0)
    short = {s: -(-n // block) * block - n for s, n in rows.items()}
    phases, start, phase = [], 0, 0
    while left:
        quota = quotas({s: weights[s] for s in left}, period)
        length, dealt = sum(quota.values()), {s: array("q") for s in left}
        slot = -1
        for s in _deal(quota):  # a period may be longer than the data, and than any machine word
            slot += 1
            dealt[s].append(slot)
            if len(dealt[s]) == left[s]:
                break
            if slot + 1 == length:  # the period repeats until the first source runs out
                slot, s = min((Slots(dealt[s], length, n)[n - 1], s) for s, n in left.items())
                break
        turns, at = divmod(slot + 1, length)
        taken = {s: Slots(of, length, turns * len(of) + bisect_left(of, at)) for s, of in dealt.items()}
        phases += [(s, phase, done[s], done[s] + len(taken[s]), start, taken[s]) for s in left]
        done = {s: done[s] + len(taken[s]) for s in left}
        left = {s: n - len(taken[s]) for s, n in left.items()}
        # only a source's last block can be short, and it ends a phase
        start += (slot + 1) * block - short[s]
        left = {s: n for s, n in left.items() if n}
        phase += 1
    return phases


def _tables(phases: list[tuple]) -> tuple[pa.Table, pa.Table, pa.Table]:
    """The plan as tables: the width of each source's cells; a row for each source, phase and cell
    of blocks that the phase reaches into; and the slots of a period in rows of at most CHUNK.

    All are found by equality. A source has as many cells, of equal width, as phases, so its blocks
    meet two phases each on average, however uneven the phases are.
    """
    used = [p for p in phases if p[2] < p[3]]
    blocks, turns = Counter(), Counter()
    for s, _, first, end, _, _ in used:
        blocks[s] += end - first
        turns[s] += 1
    width = {s: -(-n // turns[s]) for s, n in blocks.items()}
    spans = [
        # a period that is not over when the phase ends never repeats: its length plays no part
        (s, cell, phase, first, end, start, len(slots.dealt), slots.period if len(slots) > len(slots.dealt) else 0)
        for s, phase, first, end, start, slots in used for cell in range(first // width[s], (end - 1) // width[s] + 1)
    ]
    cut = [(s, phase, low // CHUNK, slots.dealt[low : low + CHUNK]) for s, phase, *_, slots in used for low in range(0, len(slots.dealt), CHUNK)]
    return _table(list(width.items()), _WIDTH), _table(spans, _SPAN), _table(cut, _SLOTS)


_WIDTH = pa.schema([("w_source", pa.string()), ("width", pa.int64())])
_SPAN = pa.schema([("p_source", pa.string()), ("cell", pa.int64()), ("phase", pa.int32()), *((c, pa.int64()) for c in ("first", "end", "start_row", "quota", "period"))])
_SLOTS = pa.schema([("s_source", pa.string()), ("s_phase", pa.int32()), ("chunk", pa.int64()), ("slots", pa.list_(pa.int64()))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _bucketed(rows: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """Add ``bucket``: a large source is numbered in many buckets of keys, so none meets in one task."""
    rows_of_bucket = max(BUCKET_ROWS, -(-sum(counts.values()) // MAX_BUCKETS))
    sizes = [(s, max(1, -(-n // rows_of_bucket))) for s, n in counts.items()]  # at most MAX_SOURCES rows
    sizes = F.broadcast(rows.sparkSession.createDataFrame(sizes, "b_source string, buckets long"))
    found = rows.join(sizes, F.col("source") == F.col("b_source")).withColumn("bucket", F.pmod("key", "buckets"))
    return found.drop("b_source", "buckets")


def _number(rows: DataFrame) -> DataFrame:
    """Add ``idx``, the row's place within its source in the order of bucket and key, and
    ``before``, the number of rows of the source that come before it by that order (less than
    ``idx`` for the second of two rows with the same key)."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key")
    numbered = rows.withColumn("place", F.row_number().over(in_bucket)).withColumn("rank", F.rank().over(in_bucket))
    numbered = numbered.join(offsets, ["source", "bucket"])
    return numbered.withColumn("idx", F.col("offset") + F.col("place") - 1).withColumn("before", F.col("offset") + F.col("rank") - 1)


def random_key(scan: DataFrame) -> Column:
    """A key for tables read straight from Parquet files, in which copies of a row differ too, so
    that they are numbered in many buckets."""
    return F.xxhash64("doc_id", "text", file_row(scan))


def _rows(docs: DataFrame, source: Column | None, key: Column | None) -> DataFrame:
    """(doc, source, key), packed, so that no column of the documents can clash with the ones added here."""
    source = F.coalesce("source", F.lit("")) if source is None else source
    key = F.xxhash64("doc_id", "text") if key is None else key
    return docs.select(F.struct("*").alias("doc"), source.cast("string").alias("source"), key.alias("key"))


def _planned(rows: DataFrame, weights: Mapping[str, float] | None, block: int, period: int | None) -> tuple[dict[str, int], tuple[DataFrame, ...]]:
    """Row counts of the sources, and the tables of the plan, each broadcast if it is small enough."""
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give them a coarser key")
    weights = weights or default_weights(counts)
    if missing := sorted(s for s in counts if weights.get(s, 0) <= 0):
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    tables = [(t, rows.sparkSession.createDataFrame(t)) for t in _tables(plan(counts, weights, block, period))]
    widths, spans, slots = (F.broadcast(df) if t.nbytes <= BROADCAST_BYTES else materialise(df, "slots") for t, df in tables)
    return counts, (widths, spans, slots)


def _placed(numbered: DataFrame, planned: tuple[DataFrame, ...], block: int) -> DataFrame:
    """Add block, slot, phase and position to rows that have their ``idx``."""
    widths, spans, slots = planned
    numbered = numbered.withColumn("block", F.floor(F.col("idx") / block)).join(widths, F.col("source") == F.col("w_source"))
    of_cell = (F.col("source") == F.col("p_source")) & (F.floor(F.col("block") / F.col("width")) == F.col("cell"))
    in_phase = of_cell & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end"))
    nth = F.col("block") - F.col("first")
    found = numbered.join(spans, in_phase).withColumn("turn", F.floor(nth / F.col("quota"))).withColumn("at", F.pmod(nth, F.col("quota")))
    of_chunk = (F.col("source") == F.col("s_source")) & (F.col("phase") == F.col("s_phase")) & (F.floor(F.col("at") / CHUNK) == F.col("chunk"))
    in_turn = F.element_at("slots", (F.pmod("at", F.lit(CHUNK)) + 1).cast("int"))
    found = found.join(slots, of_chunk).withColumn("slot", F.col("turn") * F.col("period") + in_turn)
    return found.withColumn("position", F.col("start_row") + F.col("slot") * block + F.pmod("idx", F.lit(block)))


def schedule(
    docs: DataFrame, weights: Mapping[str, float] | None = None, source: Column | None = None,
    key: Column | None = None, block: int = BLOCK_ROWS, period: int | None = PERIOD,
) -> DataFrame:
    """doc (the whole row), source, block, slot (of the block, within its phase), phase, position.

    ``position`` counts from 0 without gaps over all rows. Rows of a source go in the order of
    ``key`` (long; a hash of id and text unless given; rows with the same key are numbered in one
    task), so blocks are random. A null source is the source "".
    Sources without a given weight are an error, as are more than MAX_SOURCES sources. Repeated
    rows are placed one after the other; an empty table gives no rows.
    """
    rows = _rows(docs, source, key)
    counts, planned = _planned(rows, weights, block, period)
    placed = _placed(_number(_bucketed(rows, counts)), planned, block)
    return placed.select("doc", "source", "block", "slot", "phase", "position")


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, source: Column | None = None,
    key: Column | None = None, block: int = BLOCK_ROWS, period: int | None = PERIOD,
) -> DataFrame:
    """The documents, whole, in the order of the mixture, as ``schedule`` places them. Written, the
    files follow that order; rows with the same key go into one file.

    The order is cut into parts. A first pass numbers keys alone and finds the key at which each
    part begins in each source and bucket; with those a second pass sends every document straight
    to its part, where the places are counted on from there. Texts are shuffled once, as long as
    both these keys and the schedule are small enough to be broadcast.
    """
    rows = _rows(docs, source, key)
    slim = rows.drop("doc")
    counts, planned = _planned(slim, weights, block, period)
    total = sum(counts.values())
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // PART_ROWS), min(tasks, -(-total // LEAST_PART_ROWS)))
    part = F.floor(F.col("position") / max(1, -(-total // parts))).cast("int")
    placed = _placed(_number(_bucketed(slim, counts)), planned, block).withColumn("part", part)
    begins = placed.groupBy("source", "bucket", "part").agg(F.min("key").alias("low"), F.min("before").alias("before"))
    # as many as a bucket has parts, of which there are no more than tasks
    begins = begins.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct("low", "part", "before"))).alias("begins"))
    begins = broadcast_if_small(begins, 32 + F.octet_length("source") + 24 * F.size("begins"), "begins")
    whole = _bucketed(rows, counts).join(begins, ["source", "bucket"])
    begin = F.element_at(F.filter("begins", lambda b: b["low"] <= F.col("key")), -1)
    whole = whole.withColumn("begin", begin).select("doc", "source", "bucket", "key", "begin.part", "begin.before")
    dealt = whole.repartitionById(parts, "part")  # the window below finds its rows together
    place = F.row_number().over(Window.partitionBy("part", "source", "bucket").orderBy("key"))
    dealt = dealt.withColumn("idx", F.col("before") + place - 1)
    return _placed(dealt, planned, block).sortWithinPartitions("position").select("doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the texts only make the keys: they stay behind before the rows are shuffled
    slim = docs.select("doc_id", "source", random_key(docs).alias("key"))
    placed = schedule(slim, key=F.col("key"))
    return placed.select("doc.doc_id", "source", "phase", "block", "slot", "position")
