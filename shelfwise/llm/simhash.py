"""SimHash near-duplicate detection by the generalised pigeonhole principle.

Bits that are correlated over the corpus are put into the same group, and each group gets its
own threshold T (-1: not probed) so that the thresholds plus one sum to radius plus one: two
fingerprints within the radius then differ by at most T bits in some group. Dynamic programming
picks the thresholds with the fewest estimated candidates. Fingerprints are indexed by each
group's value, probed over the ball of that radius, and every candidate is verified.

Texts whose shingle sets are similar to 0.8 have fingerprints up to some 16 bits apart, and balls
of that radius hold a share of all pairs that no partition makes small. For such copies
(``keep_one_of_each``) fingerprints within the small radius are one source of candidates, bands of
minimal shingle hashes another; the distance of fingerprints then sorts out most pairs, and the
similarity of the shingle sets decides.
"""

from collections.abc import Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import broadcast_if_small, components, materialise, packed, without

RADIUS, SHINGLE, SEED, BITS = 3, 3, 42, 64
#: Shingles and similarity of near copies.
WORDS, SIMILARITY = 5, 0.8
#: Bands of minimal hashes: two sets of similarity 0.8 share at least one with a probability of 0.9998.
BANDS, BAND = 12, 3
#: Pairs of similarity 0.8 are no further apart, and agree in no fewer minima, but for about one in 100,000.
FAR, AGREE = 24, 18
#: Units of a bucket compared in one task; a unit counts once more for each LONG shingles.
BLOCK, LONG = 512, 4096
#: Leaders that the units of a large bucket are compared with first.
LEADERS = 16
#: Groups of bits. Of at most 16 bits each, so that the counts of their values are bounded.
GROUPS = 4
#: A group value with more fingerprints than this is dealt over several tasks.
HOT = 4096
_CHUNK = 1 << 15
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.zeros(0, np.uint64)
_SKETCH = "fp long, same binary, bands array<long>, minima array<int>, shingles array<int>"


def shingle_hashes(text: str | None, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included, in chunks. Fewer words than a shingle: the whole
    sequence is the one shingle; null or blank: none."""
    # bytes.lower() and bytes.split() know ASCII only, as the definition asks
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    hashed = xxhash.xxh64_intdigest
    for start in range(0, max(1, len(w) - words + 1), _CHUNK):  # bounded memory for very long texts
        part = w[start : start + _CHUNK + words - 1]
        n = max(1, len(part) - words + 1)
        yield np.array([hashed(s, SEED) for s in map(b" ".join, zip(*(part[i : i + n] for i in range(min(words, len(part)))), strict=False))], np.uint64)


def _majority(chunks: Sequence[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in chunks:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64 bits from the shingle hashes; null or blank: 0."""
    return _majority(list(shingle_hashes(text, words)))


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many fingerprints bits i and j are both set (i = j: set at all)."""
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        for start in range(0, len(batch), _CHUNK):
            f = batch.column(0).to_numpy(zero_copy_only=False)[start : start + _CHUNK]
            bits = np.unpackbits(f.astype(">i8").view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float32)
            both += bits.T @ bits
            n += len(f)
    i, j = np.triu_indices(BITS)
    if n:
        rows = [pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(both[i, j], n).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(rows, names=["i", "j", "n"])


def correlated_groups(prints: DataFrame, groups: int) -> list[list[int]]:
    """Bits in groups of equal size; each is grown from the free bit pair that is most correlated."""
    rows = prints.select("fp").mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    total = max(1, next((r.n for r in rows if r.i < 0), 1))
    share = np.zeros((BITS, BITS))
    for r in rows:
        if r.i >= 0:
            share[r.i, r.j] = share[r.j, r.i] = r.n / total
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    free, out, size = set(range(BITS)), [], BITS // groups
    for _ in range(groups - 1):
        left = sorted(free)
        grown = [left[k] for k in np.unravel_index(np.argmax(link[np.ix_(left, left)]), (len(left), len(left)))]
        while len(grown) < size:
            left = sorted(free - set(grown))
            grown.append(left[int(np.argmax(link[np.ix_(left, grown)].mean(1)))])
        out.append(sorted(grown))
        free -= set(grown)
    return [*out, sorted(free)]


def group_value(fp: Column, bits: Sequence[int]) -> Column:
    value = F.lit(0)
    for k, b in enumerate(bits):
        value = value + F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)).cast("int"), k)
    return value


def distance_counts(histogram: np.ndarray) -> np.ndarray:
    """Ordered pairs of fingerprints by the distance of their values, from the counts of values.

    The pairs at each exclusive-or difference are the self-convolution of the counts over
    GF(2)^w, which a Walsh-Hadamard transform gives without visiting pairs.
    """
    f = histogram.astype(np.float64).copy()

    def transform(x: np.ndarray) -> np.ndarray:
        h = 1
        while h < len(x):
            y = x.reshape(-1, 2, h)
            x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(-1)
            h *= 2
        return x

    pairs = np.maximum(transform(transform(f) ** 2) / len(f), 0)
    return np.bincount(np.bitwise_count(np.arange(len(f), dtype=np.uint32)), weights=pairs)


def allocate(costs: Sequence[np.ndarray], radius: int) -> list[int]:
    """Thresholds with the least total cost; costs[g][d] pairs lie at distance d in group g."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for by_distance in costs:
        upto = np.append(0, np.cumsum(by_distance))  # upto[t + 1]: within t
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, min(radius - spent, len(by_distance) - 1) + 1):
                probes = sum(1 for _ in _masks(len(by_distance) - 1, t)) if t > 0 else 1
                new = (cost + upto[t + 1] + (t >= 0) * probes, [*chosen, t])
                if spent + t + 1 not in step or new < step[spent + t + 1]:
                    step[spent + t + 1] = new
        best = step
    return best[radius + 1][1]


def _masks(width: int, radius: int) -> Iterator[int]:
    for r in range(radius + 1):
        for bits in combinations(range(width), r):
            yield sum(1 << b for b in bits)


def linked_pairs(prints: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints ``fp`` at most ``radius`` bits apart."""
    bits = correlated_groups(prints, groups)
    values = F.array(*[F.struct(F.lit(g).alias("g"), group_value(F.col("fp"), b).alias("value")) for g, b in enumerate(bits)])
    keyed = prints.select("fp", F.inline(values))
    # at most groups * 2^16 counts, whatever the corpus
    counts = keyed.groupBy("g", "value").agg(F.count("*").alias("n")).toPandas()
    costs = []
    for g, b in enumerate(bits):
        own = counts[counts["g"] == g]
        histogram = np.zeros(1 << len(b))
        histogram[own["value"]] = own["n"]
        costs.append(distance_counts(histogram))
    thresholds = allocate(costs, radius)
    masks = [F.array(*[F.lit(m) for m in _masks(len(b), t)]) for b, t in zip(bits, thresholds, strict=True)]
    ball = masks[0]
    for g, m in enumerate(masks[1:], 1):
        ball = F.when(F.col("g") == g, m).otherwise(ball) if thresholds[g] >= 0 else ball
    used = [g for g, t in enumerate(thresholds) if t >= 0]
    keyed = keyed.where(F.col("g").isin(used))
    index = keyed.select(F.col("fp").alias("b"), F.col("g").alias("gb"), F.col("value").alias("vb"))
    probe = keyed.withColumn("mask", F.explode(ball)).select(F.col("fp").alias("a"), "g", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    on = (F.col("g") == F.col("gb")) & (F.col("value") == F.col("vb"))
    hot = counts[counts["n"] > HOT]
    if len(hot):  # a hot value's fingerprints are dealt over chunks, and each probe visits all chunks
        chunks = F.broadcast(prints.sparkSession.createDataFrame([(int(r.g), int(r.value), -(-int(r.n) // HOT)) for r in hot.itertuples()], "hg int, hv int, chunks int"))
        n = F.coalesce("chunks", F.lit(1))
        index = index.join(chunks, (F.col("gb") == F.col("hg")) & (F.col("vb") == F.col("hv")), "left").select("b", "gb", "vb", F.pmod(F.xxhash64("b"), n).cast("int").alias("sb"))
        probe = probe.join(chunks, (F.col("g") == F.col("hg")) & (F.col("value") == F.col("hv")), "left").select("a", "g", "value", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
        on &= F.col("s") == F.col("sb")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probe.join(index, on & near).select("a", "b").distinct()


def group_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): fingerprints that reach each other by links share their root."""
    distinct = materialise(prints.select("fp").distinct(), "prints")
    found = components(linked_pairs(distinct, radius))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows with a null id
    belong to groups but do not name them; a group of such rows only has a null component_id.
    Repeated rows get a row each, of one group; very long texts are read whole, in chunks; an empty
    table gives no rows; extra columns are ignored, whatever they are called. A fingerprint that
    fills a large share of the rows is left to adaptive execution, which splits such joins.
    """
    prints = materialise(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = least.join(group_prints(prints, radius), "fp")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = roots.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Sketch(NamedTuple):
    """Of the set of a text's shingles: fingerprint, name of the whole set, bucket keys, minimal
    hashes, and the set itself as sorted 32-bit hashes (two of n shingles share one with a
    probability of n^2 / 2^33, so the similarity is exact but for about one shingle of a long text)."""

    fp: int
    same: bytes
    bands: np.ndarray
    minima: np.ndarray
    shingles: np.ndarray


def sketch(text: str | None, words: int) -> Sketch:
    chunks = list(shingle_hashes(text, words))
    h = np.unique(np.concatenate([*chunks, np.zeros(0, np.uint64)]))
    minima = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for start in range(0, len(h), _CHUNK):
        minima = np.minimum(minima, (h[None, start : start + _CHUNK] * _FACTORS[:, None]).min(1))
    bands = [xxhash.xxh64_intdigest(minima[k : k + BAND].tobytes(), k) for k in range(0, len(minima), BAND)]
    low = (minima >> np.uint64(32)).astype(np.uint32)
    return Sketch(_majority(chunks), xxhash.xxh3_128_digest(h.tobytes()), np.array(bands, np.uint64), low, np.unique((h >> np.uint64(32)).astype(np.uint32)))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                made = [sketch(t, words) for t in part.column(2).to_pylist()]
                columns = [
                    pa.array(np.array([k.fp for k in made], np.uint64).view(np.int64)), pa.array([k.same for k in made], pa.binary()),
                    pa.array([k.bands.view(np.int64) for k in made], pa.list_(pa.int64())), pa.array([k.minima.view(np.int32) for k in made], pa.list_(pa.int32())),
                    pa.array([k.shingles.view(np.int32) for k in made], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "row", *Sketch._fields])

    return run


def joining_links(sketches: Sequence[Sketch], left: np.ndarray, right: np.ndarray, similarity: float, label: np.ndarray) -> list[tuple[int, int]]:
    """Places of pairs of left and right that are similar enough and join all that such pairs join.

    Pairs that others have joined already (equal labels) are passed over, so a dense group costs
    about one comparison of sets a member.
    """
    fp = np.array([k.fp for k in sketches], np.uint64)  # signed numbers would be counted by their absolute value
    minima = np.stack([k.minima for k in sketches])
    label, out = label.copy(), []
    for i in left.tolist():
        others = right[label[right] != label[i]]
        others = others[np.bitwise_count(fp[others] ^ fp[i]) <= FAR]
        agree = (minima[others] == minima[i]).sum(1)
        for j in others[agree >= AGREE][np.argsort(-agree[agree >= AGREE], kind="stable")].tolist():
            if label[i] == label[j]:
                continue
            a, b = sketches[i].shingles, sketches[j].shingles
            if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common >= similarity * (len(a) + len(b) - common):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _compare(similarity: float):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("key", "ascending"), ("unit", "ascending")])
        key, unit, is_i, label = (bucket[c].to_numpy(zero_copy_only=False) for c in ("key", "unit", "is_i", "label"))
        rows = zip(bucket["fp"].to_numpy().view(np.uint64), *(bucket[c] for c in ("minima", "shingles")), strict=True)
        made = [Sketch(f, b"", _NONE, m.values.to_numpy(), s.values.to_numpy()) for f, m, s in rows]
        across = bucket["i"][0].as_py() != bucket["j"][0].as_py()
        found: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
            at = np.arange(e - s)
            sides = (at[is_i[s:e]], at[~is_i[s:e]]) if across else (at, at)
            found += [(s + i, s + j) for i, j in joining_links(made[s:e], *sides, similarity, label[s:e])]
        a, b = np.array(found, int).reshape(-1, 2).T
        return pa.table({"a": unit[a], "b": unit[b]})

    return run


def _apart(units: DataFrame) -> DataFrame:
    """(print, key): pairs of linked fingerprints whose units share no band, a bucket each."""
    prints = units.groupBy("fp").agg(F.count("*").alias("units"), F.min("bands").alias("bands"))
    prints = materialise(prints.select("fp", F.when(F.col("units") == 1, F.col("bands")).alias("bands")), "prints")
    a, b = (prints.select(F.col("fp").alias(c), F.col("bands").alias(f"{c}_bands")) for c in "ab")
    met = F.coalesce(F.arrays_overlap("a_bands", "b_bands"), F.lit(False))
    pairs = linked_pairs(prints).join(a, "a").join(b, "b").where(~met)
    return pairs.select(F.explode(F.array("a", "b")).alias("print"), F.xxhash64("a", "b").alias("key"))


def _leaders(part: pa.Table) -> pa.Table:
    """Of the units of a part, the one whose minima agree most with the commonest ones: a text that
    near copies stem from, or a copy with few edits of its own."""
    part = part.sort_by("unit")
    minima = part["minima"].combine_chunks().flatten().to_numpy().reshape(len(part), -1)
    agree = np.zeros(len(part), np.int64)
    for column in minima.T:
        values, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
        agree += inverse == counts.argmax()
    best = int(agree.argmax())
    return pa.table({"key": part["key"][best : best + 1], "part": part["part"][best : best + 1], "unit": part["unit"][best : best + 1], "agree": agree[best : best + 1]})


def _first_links(large: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Links of the units of large buckets to a few leaders of their bucket: one pass over the
    units, whose minima alone choose the leaders."""
    cut = large.select("key", "unit", "parts", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int").alias("part"))
    chosen = cut.join(whole.select("unit", "minima"), "unit").groupBy("key", "part").applyInArrow(_leaders, "key long, part int, unit long, agree long")
    best = chosen.groupBy("key", F.pmod("part", F.lit(LEADERS)).alias("salt")).agg(F.max(F.struct("agree", "unit")).alias("best"))
    parts = large.groupBy("key").agg(F.max("parts").alias("parts"))
    led = best.select("key", "best.unit").join(parts, "key").select("key", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_i"))
    both = cut.select("key", "unit", "part", F.lit(True).alias("is_i")).unionByName(led)
    dealt = both.select("*", F.col("part").alias("i"), F.lit(-1).alias("j"), F.monotonically_increasing_id().alias("label")).join(whole, "unit")
    return dealt.groupBy("key", "i", "j").applyInArrow(_compare(similarity), "a long, b long")


def _rest_links(large: DataFrame, joined: DataFrame, whole: DataFrame, similarity: float, weight: Column) -> DataFrame:
    """The links still missing in large buckets. Units that links have joined already need none
    among themselves: those outside the largest joined set of a bucket, the rest, are compared with
    all of it, in pairs of parts of bounded size. Without a rest there is nothing to compare."""
    found = components(joined)
    own = large.join(found, F.col("unit") == F.col("node"), "left").withColumn("label", F.coalesce("root", "unit")).drop("node", "root")
    own = materialise(own, "joined-units")
    sets = own.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = sets.groupBy("key").agg(F.max(F.struct("size", "label")).alias("main")).select("key", F.col("main.label").alias("main"))
    marked = own.join(main, "key").withColumn("rest", F.col("label") != F.col("main"))
    left = marked.where("rest").groupBy("key").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("rest_parts"))
    marked = marked.join(left, "key")  # buckets without a rest are done
    part, spread = F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side_i = marked.where("rest").select("key", "unit", "label", F.pmod(F.xxhash64("unit"), F.col("rest_parts")).cast("int").alias("i"), spread("parts").alias("j"), F.lit(True).alias("is_i"))
    side_j = marked.select("key", "unit", "label", spread("rest_parts").alias("i"), part.alias("j"), F.lit(False).alias("is_i"))
    dealt = side_i.unionByName(side_j).withColumn("j", F.col("j") + (1 << 20)).join(whole, "unit")  # never equal to i: two sides
    return dealt.groupBy("key", "i", "j").applyInArrow(_compare(similarity), "a long, b long")


def similar_units(units: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that join the units similar enough. Units (unit, row, fp, bands, n): one per distinct
    shingle set, n of them shingles; sketches hold the minima and shingles of each row.

    Units meet in buckets: those that share a band or a fingerprint, and linked fingerprints that
    do not. Small buckets are compared whole, many in a task. A large one, a dense group as a rule,
    is first joined by its leaders, and only what they leave apart is compared further.
    """
    slim = ("key", "unit", "row", "n")
    own = F.xxhash64("fp", F.lit(SEED))
    keys = units.withColumn("key", F.explode(F.array_append("bands", own))).select(*slim)
    apart = materialise(_apart(units), "apart")  # ``keys`` is used twice
    keys = keys.unionByName(apart.join(units, F.col("print") == F.col("fp")).select(*slim))
    weight = 1 + F.floor(F.col("n") / LONG)
    shared = keys.groupBy("key").agg(F.count("*").alias("units"), F.sum(weight).alias("m")).where("units > 1").select("key", "m")
    met = materialise(keys.join(shared, "key").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")), "buckets")
    wanted = broadcast_if_small(met.select("unit", "row").distinct(), F.lit(64), "met")
    whole = sketches.select("row", "fp", "minima", "shingles").join(wanted, "row").select("unit", "fp", "minima", "shingles")
    small, large = met.where("parts = 1"), met.where("parts > 1")
    total = small.agg(F.sum(weight)).first()[0] or 0
    task = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // BLOCK))))
    dealt = small.select("key", "unit", task.alias("task"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("is_i"), F.col("unit").alias("label")).join(whole, "unit")
    links = dealt.groupBy("task", "i", "j").applyInArrow(_compare(similarity), "a long, b long")
    if large.isEmpty():
        return links.distinct()
    joined = materialise(links.unionByName(_first_links(large, whole, similarity)).distinct(), "first-links")
    return joined.unionByName(_rest_links(large, joined, whole, similarity, weight)).distinct()


def keep_one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, row: Column | None = None) -> DataFrame:
    """The whole documents without near copies: of those that reach each other by links (Jaccard
    similarity of the sets of lower-cased word shingles at or above the bound) the one with the
    smallest id stays, null ids last, then the first in the order of ``row`` (see ``packed``).

    Texts of fewer words are one shingle; null and blank texts have none and are copies of each
    other. Columns keep their names and values, whatever they are called; an empty table stays empty.
    """
    rows = packed(docs, row)
    schema = T.StructType([*rows.select("doc.doc_id", "row").schema.fields, *T.StructType.fromDDL(_SKETCH).fields])
    sketches = materialise(rows.select("doc.doc_id", "row", "doc.text").mapInArrow(_sketches(words), schema), "sketches")
    # one unit for each set of shingles: copies are told by the name of their set
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row", "fp", "bands", F.size("shingles").alias("n")))
    units = sketches.groupBy("same").agg(first.alias("first")).select("first.*", F.monotonically_increasing_id().alias("unit"))
    units = materialise(units, "units")
    roots = components(similar_units(units, sketches, similarity))
    groups = units.join(roots, F.col("unit") == F.col("node"), "left").groupBy(F.coalesce("root", "unit")).agg(F.min(F.struct("no_id", "id", "row")).alias("first"))
    kept = materialise(groups.select("first.row"), "kept")
    return without(rows, sketches.select("row").join(kept, "row", "left_anti"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
