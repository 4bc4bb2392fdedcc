"""Best-fit packing of documents into training sequences by exact-complement hashing.

Documents become token ids and an end id; long ones are cut. How many pieces there are of each
length is all that a packing depends on, and there are no more lengths than tokens in a sequence:
so the counts are packed, whatever the number of pieces. Longest first, the gap that a length
leaves is looked up among the sums of one, two and three lengths, and the combination that fills
it exactly is consumed as often as there are pieces for it. What is left goes best-fit. Pieces
then find their place by their rank among those of the same length.
"""

import array
import json
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm.common import materialise
from shelfwise.llm.pieces import model_path

TOKENIZER, END, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Fixed value: the pattern of pre-tokens that byte-level models of this kind share.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write a byte: visible characters of Latin-1 as they are, the
    others as the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Encoder:
    """Token ids of whole texts, as bytes of 32-bit little-endian numbers, equal to the library's.

    A plain byte-level model is rebuilt from its own file for a faster reader of such models: their
    ids are in the order of the merges, which decides alike in both (checked on opening). Texts
    that hold a special string, and all texts of other models, go through the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.fast = _byte_level(told)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()


def _byte_level(told: dict) -> tiktoken.Encoding | None:
    """The model for the faster reader, or None if it is of another kind."""
    pre, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told.get("normalizer") is None
    marks = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if not plain or model["type"] != "BPE" or any(model.get(m) for m in marks):
        return None
    vocab, byte = model["vocab"], {name: b for b, name in _byte_names().items()}
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if set(byte) - set(vocab) or None in merged or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    added = {t["content"] for t in told.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    return tiktoken.Encoding("byte-level", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all full but the first, which may be shorter."""
    first = (tokens - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, tokens, capacity)]


_PIECE = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())]
_PIECES = "piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary"


def pieces_of(docs: DataFrame, path: str, capacity: int, end: int | None, with_ids: bool) -> DataFrame:
    """One row per piece. ``part`` is the task and ``nth`` the place among its pieces of that
    length: no more than names, so the table must be written once before it is used."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ending = b"" if end is None else end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + ending)
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity) if ids else []):
                    own = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((piece, start, length, zlib.crc32(own), part, seen[length], bytes(own) if with_ids else None))
                    seen[length] += 1
            columns = zip(*rows) if rows else [[]] * len(_PIECE)
            made = [pa.array(list(c), t) for c, (_, t) in zip(columns, _PIECE)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *made], names=["doc_id", *(n for n, _ in _PIECE)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECES}")


class _Sums:
    """For each gap, the combinations of the lengths left that have its sum, listed when it is
    first asked for. Counts only fall, so what could not be had once is passed for good.

    ``sizes``: how many lengths a combination may have. ``even``: those of like lengths first, or
    else those with the longest piece. Below ``least`` lengths are kept for the residuals.
    """

    def __init__(self, left: Counter[int], sizes: frozenset[int], even: bool, least: int):
        self.left, self.sizes, self.least, self.of = left, sizes, least, {}
        self.lengths = sorted(+left, reverse=not even)

    def _pairs(self, gap: int, most: int) -> Iterator[tuple[int, ...]]:
        for a in self.lengths:
            if self.least <= gap - a <= a <= most and self.left[a] and self.left[gap - a]:
                yield a, gap - a

    def _listed(self, gap: int) -> Iterator[tuple[int, ...]]:
        if 1 in self.sizes and self.left[gap]:
            yield (gap,)
        if 2 in self.sizes:
            yield from self._pairs(gap, gap)
        for a in self.lengths if 3 in self.sizes else ():
            if 3 * a >= gap > a and self.left[a]:
                yield from ((a, *p) for p in self._pairs(gap - a, a))

    def fill(self, first: int, gap: int) -> tuple[tuple[int, ...], int] | None:
        """The next combination for the gap beside ``first``, and how often it can be had."""
        found = self.of.setdefault(gap, [self._listed(gap), None])
        while True:
            found[1] = found[1] or next(found[0], None)
            if found[1] is None:
                return None
            need = Counter((first, *found[1]))
            times = min(self.left[length] // n for length, n in need.items())
            if times:
                return (first, *found[1]), times
            found[1] = None


#: Passes of exact filling (sizes of the combinations allowed in each).
_PASSES = [[{1}], [{1}, {2}], [{1}, {2}, {3}], [{1, 2, 3}]]


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) for so many pieces of each length.

    Which short pieces are spent on exact fills decides what is left for the residuals, so a few
    orders of filling are tried; the one with the fewest sequences counts, the first of equals.
    """
    tried = (
        _plan(counts, capacity, [frozenset(p) for p in passes], even, least)
        for passes in _PASSES for even in (True, False) for least in (1, capacity // 16, capacity // 8)
    )
    return min(tried, key=lambda made: sum(times for _, times in made))


def _plan(counts: Mapping[int, int], capacity: int, passes: list[frozenset[int]], even: bool, least: int) -> list[tuple[tuple[int, ...], int]]:
    left, made = Counter({k: n for k, n in counts.items() if n}), []
    for sizes in passes:
        sums = _Sums(left, sizes, even, max(1, least))
        for first in sorted(+left, reverse=True):
            while left[first] > 0:
                found = ((first,), left[first]) if first == capacity else sums.fill(first, capacity - first)
                if found is None:
                    break
                lengths, times = found
                for length in lengths:
                    left[length] -= times
                made.append((lengths, times))
    # the rest best-fit, longest first: open sequences by their gap
    gaps: dict[int, Counter[tuple[int, ...]]] = {capacity: Counter()}
    for length in sorted(+left, reverse=True):
        n = left[length]
        for gap in sorted(g for g in gaps if length <= g < capacity):
            while n and gap in gaps:
                lengths, times = next(iter(gaps[gap].items()))
                per = min(gap // length, n)  # a sequence stays the tightest one until it is full
                took = min(times, n // per)
                _move(gaps, gap, lengths, took, length, per)
                n -= took * per
        per = capacity // length
        for size, times in ((per, n // per), (n % per, 1)):
            if size and times:
                rest = capacity - size * length
                gaps.setdefault(rest, Counter())[(length,) * size] += times
    return made + [(lengths, times) for group in gaps.values() for lengths, times in group.items()]


def _move(gaps: dict[int, Counter], gap: int, lengths: tuple[int, ...], times: int, length: int, per: int) -> None:
    gaps[gap][lengths] -= times
    if not gaps[gap][lengths]:
        del gaps[gap][lengths]
    if not gaps[gap]:
        del gaps[gap]
    gaps.setdefault(gap - per * length, Counter())[lengths + (length,) * per] += times


def _segments(patterns: list[tuple[tuple[int, ...], int]], counts: Mapping[int, int]) -> tuple[dict[int, int], np.ndarray]:
    """Where the ranks of a length begin when all lengths stand in one line, and the stretches of
    that line (from, first sequence, offset): pieces of a stretch go to consecutive sequences."""
    begins, total = {}, 0
    for length in sorted(counts):
        begins[length], total = total, total + counts[length]
    at, rows, sequence = dict(begins), [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((at[length], sequence, offset))
            at[length] += times
            offset += length
        sequence += times
    return begins, np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int | None = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text counts as empty and is its end id alone; without an end id it has no piece. Very
    long texts are cut into as many pieces as they fill. Repeated rows and null ids are packed
    like any others, an empty table gives no rows, extra columns are ignored.
    """
    pieces = materialise(pieces_of(docs, path or model_path(TOKENIZER), capacity, end, with_ids), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    begins, segments = _segments(plan(counts, capacity), counts)
    line = docs.sparkSession.sparkContext.broadcast(segments)  # bounded by the number of lengths

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.element_at(F.lit([begins.get(k, 0) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    offsets = per_part.select("part", "length", (begin + before).alias("begin"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    named = pieces.join(offsets, ["part", "length"]).select(*columns, (F.col("begin") + F.col("nth")).alias("at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sequences, offset = line.value.T
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            of = np.searchsorted(starts, at, "right") - 1
            put = [pa.array(sequences[of] + at - starts[of]), pa.array(offset[of])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *put], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.select(*columns).schema)
    return named.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids (32-bit
    little-endian), n_tokens, and the documents in them. A sequence has at most one piece a token."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), "n_tokens", F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"])).alias("documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
