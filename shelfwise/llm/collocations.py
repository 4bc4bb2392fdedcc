"""Phrase collocations by HAT-trie counting.

A task counts phrases in a trie whose root branches by the first word; below it hang hash
containers, and a container that grows too large bursts into one for each second word. When the
trie outgrows its bound, whole subtrees leave it as sorted runs. Runs are dealt by the prefix of
their phrases, which is the first word, or more words where that prefix is frequent, and each
prefix partition merges its runs.

A phrase is never more frequent than its parts, so words are counted first, then pairs of frequent
words, then phrases of frequent pairs. What is frequent is told by bitmaps of fixed size: they
may let more through than is frequent, which costs time, and hold back nothing that is.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

LEAST, TOP, LONGEST = 30, 2000, 4
SCORE, COVERED_PERCENT = 2_000_000, 80
#: Phrases that a task's trie holds, and words that it remembers, before some leave it.
TRIE_ENTRIES, WORD_ENTRIES = 600_000, 1 << 18
#: A container of more entries bursts; bytes of text taken at a time.
BURST, WINDOW = 8192, 1 << 20
#: Occurrences, and so run entries at most, that one prefix partition is made for.
PARTITION_ENTRIES = 1 << 20
#: Bits of a bitmap for each frequent thing, and of a bitmap at most (8 MB).
BITS_EACH, MAX_BITS = 16, 1 << 26

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * 10 + b" ")
_BREAK = re.compile(rb"[ .]")
_KEYS = ["w1", "w2", "w3", "w4"]
_ID_BITS = 21
_ID_MASK = (1 << _ID_BITS) - 1


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words and b"." between pieces, in lists of about a WINDOW; lists end where words do."""
    text = text.translate(_LOWER)
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + WINDOW)
        stop = end.start() if end else len(text)
        yield text[at:stop].replace(b".", b" . ").split()
        at = stop


def _texts_by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of a language joined, with a break between them, up to about a WINDOW."""
    waiting: dict[str, list[bytes]] = defaultdict(list)
    sizes: Counter[str] = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py()
        waiting[lang].append(text)
        sizes[lang] += len(text) + 1
        if sizes[lang] >= WINDOW:
            yield lang, b".".join(waiting.pop(lang))
            del sizes[lang]
    for lang, texts in waiting.items():
        yield lang, b".".join(texts)


def word_id(word: bytes, seed: int) -> int:
    """A signed 64-bit hash, never 0, which stands for no word."""
    h = xxhash.xxh64_intdigest(word, seed)
    return (h - (1 << 64) if h >> 63 else h) or 1


def _mix(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for words of a language; for bitmaps and dealing, where equal ones do no harm."""
    h = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for c in columns:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Bitmap:
    """Which mixed numbers were set; others too, by chance."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(64 * len(cells) - 1)

    def holds(self, mixed: np.ndarray) -> np.ndarray:
        at = mixed & self.mask
        return (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(phrases: DataFrame, count: int, words: int) -> Bitmap:
    """The bitmap of the first ``words`` words of phrases (lang, w1...). Tasks send the cells they
    have set, which meet by cell; the driver gets one number a cell."""
    bits = 1 << min(max(count * BITS_EACH, 1 << 12) - 1, MAX_BITS - 1).bit_length()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            columns = [c.to_numpy() for c in batch.columns[1:]]
            at = np.concatenate([np.zeros(0, np.uint64)] + [_mix(x, [c[langs == x] for c in columns]) for x in set(langs)]) & np.uint64(bits - 1)
            cell, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(cell), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(value.view(np.int64))], names=["cell", "value"])

    found = phrases.select("lang", *_KEYS[:words]).mapInArrow(cells, "cell long, value long")
    table = found.groupBy("cell").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[table["cell"].to_numpy()] = table["value"].to_numpy().view(np.uint64)
    return Bitmap(out)


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, id, word, n) for every word; a task adds up what it can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(b".", None)
                word = list(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(word), pa.string()), pa.array([word_id(w, seed) for w in word], pa.int64()),
                    pa.array(word, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()),
                ], names=["lang", "id", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in _texts_by_lang(batch):
                for words in words_of(text):
                    counts[lang].update(words)
                    if sum(map(len, counts.values())) > WORD_ENTRIES:
                        yield from flush()
        yield from flush()

    parts = texts.mapInArrow(run, "lang string, id long, word string, n long")
    return parts.groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Small numbers for the words that the bitmap lets through, 0 for all others."""

    def __init__(self, lang: str, frequent: Bitmap, seed: int):
        super().__init__()
        self.lang, self.frequent, self.seed, self.ids = lang, frequent, seed, [0]
        self[b"."] = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self)
        if len(self) + len(new) > WORD_ENTRIES:  # words without a number are looked up anew
            for w in [w for w, n in self.items() if n == 0 and w != b"."]:
                del self[w]
            new = set(words).difference(self)
        new = list(new)
        ids = np.array([word_id(w, self.seed) for w in new], np.int64)
        known = self.frequent.holds(_mix(self.lang, [ids]))
        number = np.where(known, len(self.ids) + np.cumsum(known) - 1, 0)
        self.ids += ids[known].tolist()
        self.update(zip(new, number.tolist()))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def full(self) -> bool:
        return len(self.ids) > WORD_ENTRIES // 2


class HatTrie:
    """Counts of phrases: first word -> container {packed other words: n}, or, once burst, second
    word -> container. Words are small numbers, packed 21 bits each."""

    def __init__(self, bursts: bool):
        self.bursts, self.root, self.entries = bursts, {}, 0

    def add(self, first: int, others: list[int], counts: list[int]) -> None:
        node = self.root.get(first)
        if node is None:
            node = self.root[first] = ({}, False)
        below, burst = node
        if not burst:
            before = len(below)
            for o, n in zip(others, counts):
                below[o] = below.get(o, 0) + n
            self.entries += len(below) - before
            if self.bursts and len(below) > BURST:
                split: dict[int, dict[int, int]] = {}
                for o, n in below.items():
                    split.setdefault(o >> 2 * _ID_BITS, {})[o] = n
                self.root[first] = (split, True)
            return
        for o, n in zip(others, counts):
            container = below.setdefault(o >> 2 * _ID_BITS, {})
            before = len(container)
            container[o] = container.get(o, 0) + n
            self.entries += len(container) - before

    def sizes(self) -> list[tuple[int, int]]:
        """(entries, first word) of the subtrees, largest first."""
        return sorted(((sum(map(len, b.values())) if burst else len(b), w) for w, (b, burst) in self.root.items()), reverse=True)

    def take(self, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut off the largest subtrees until so many entries at most are left: (first, others, n)."""
        gone = []
        for size, word in self.sizes():
            if self.entries <= entries:
                break
            below, burst = self.root.pop(word)
            self.entries -= size
            gone += [(word, c) for c in (below.values() if burst else (below,))]
        total = sum(len(c) for _, c in gone)
        first = np.repeat(np.array([w for w, _ in gone], np.int64), [len(c) for _, c in gone])
        others = np.fromiter((o for _, c in gone for o in c), np.int64, total)
        return first, others, np.fromiter((n for _, c in gone for n in c.values()), np.int64, total)


def _phrases(a: np.ndarray, carried: int, vocabulary: Vocabulary, pairs: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """(first, others) of the phrases in a list of word numbers that end behind the carried ones:
    pairs of words, or, with a bitmap of frequent pairs, all of three and four made up of those."""
    x, y = a[:-1], a[1:]
    ok = (x > 0) & (y > 0)
    if pairs is None:
        ok[: max(0, carried - 1)] = False
        return x[ok], y[ok] << 2 * _ID_BITS
    at = np.flatnonzero(ok)
    ids = np.array(vocabulary.ids, np.int64)
    ok[at] = pairs.holds(_mix(vocabulary.lang, [ids[x[at]], ids[y[at]]]))
    three = np.flatnonzero(ok[:-1] & ok[1:])
    four = three[np.isin(three + 1, three, assume_unique=True)]
    three, four = three[three + 2 >= carried], four[four + 3 >= carried]
    start = np.concatenate([three, four])
    last = np.concatenate([np.zeros(len(three), np.int64), a[four + 3]])
    return a[start], (a[start + 1] << 2 * _ID_BITS) | (a[start + 2] << _ID_BITS) | last


class _Counting:
    """The trie of one language in one task."""

    def __init__(self, lang: str, seed: int, frequent: Bitmap, pairs: Bitmap | None):
        self.vocabulary, self.pairs = Vocabulary(lang, frequent, seed), pairs
        self.trie = HatTrie(bursts=pairs is not None)

    def add(self, text: bytes) -> None:
        carry = np.zeros(0, np.int64)
        for words in words_of(text):
            a = np.concatenate([carry, self.vocabulary.numbers(words)])
            first, others = _phrases(a, len(carry), self.vocabulary, self.pairs)
            carry = a[-(LONGEST - 1) :]
            order = np.lexsort((others, first))
            first, others = first[order], others[order]
            new_key = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (others[1:] != others[:-1]))) if len(first) else np.zeros(0, int)
            counts = np.diff(np.append(new_key, len(first)))
            first, others = first[new_key], others[new_key]
            new_first = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else [], len(first)).astype(int)
            others, counts = others.tolist(), counts.tolist()
            for lo, hi in zip(new_first[:-1], new_first[1:]):
                self.trie.add(int(first[lo]), others[lo:hi], counts[lo:hi])

    def runs(self, entries: int, buckets: int, hot: list[Bitmap]) -> Iterator[pa.RecordBatch]:
        """Subtrees that leave the trie, as one sorted run for each prefix partition."""
        first, others, n = self.trie.take(entries)
        ids = np.array(self.vocabulary.ids, np.int64)
        keys = [ids[first]] + [ids[(others >> shift) & _ID_MASK] for shift in (2 * _ID_BITS, _ID_BITS, 0)][: 1 if self.pairs is None else 3]
        if not len(first):
            return
        bucket = (prefix_number(self.vocabulary.lang, keys, hot) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((*keys[::-1], bucket))
        bucket, n, flat = bucket[order], n[order], np.stack(keys, axis=1)[order]
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).astype(np.int32)
        width = flat.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[edges[:-1]]), pa.array([self.vocabulary.lang] * (len(edges) - 1), pa.string()),
            pa.ListArray.from_arrays(pa.array(edges * width), pa.array(flat.ravel())), pa.ListArray.from_arrays(pa.array(edges), pa.array(n)),
        ], names=["bucket", "lang", "keys", "counts"])


def prefix_number(lang: str, keys: list[np.ndarray], hot: list[Bitmap]) -> np.ndarray:
    """Tells the prefix partition of phrases: by the first word, by two where that word is hot,
    and by the whole phrase where the pair is hot too."""
    out = _mix(lang, keys[:1])
    deeper = np.ones(len(out), bool)
    for words, bitmap in enumerate(hot, 1):
        deeper &= bitmap.holds(_mix(lang, keys[:words]))
        longer = keys[: words + 1] if words < len(hot) else keys
        out[deeper] = _mix(lang, [k[deeper] for k in longer])
    return out


def _merge(least: int, width: int):
    def merge(runs: pa.Table) -> pa.Table:
        """Adds up the runs of a prefix partition; only what is frequent leaves it."""
        out = []
        langs = np.array(runs["lang"].to_pylist(), object)
        for lang in sorted(set(langs)):
            own = runs.filter(pa.array(langs == lang))
            keys = own["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            n = own["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort(keys.T[::-1])
            keys, n = keys[order], n[order]
            begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            total = np.add.reduceat(n, begins)
            kept = np.zeros((int((total >= least).sum()), LONGEST), np.int64)
            kept[:, :width] = keys[begins[total >= least]]
            out.append(pa.table({"lang": pa.array([lang] * len(kept), pa.string()), **{k: kept[:, i] for i, k in enumerate(_KEYS)}, "f": total[total >= least]}))
        return pa.concat_tables(out)

    return merge


_PHRASES = "lang string, w1 long, w2 long, w3 long, w4 long, f long"


def count_phrases(texts: DataFrame, frequent: Bitmap, pairs: Bitmap | None, hot: list[Bitmap], buckets: int, seed: int, least: int) -> DataFrame:
    """(lang, w1..w4, f) of frequent phrases: pairs, or those of three and four words (w4 is 0 for
    three) if the frequent pairs are given."""
    sent = texts.sparkSession.sparkContext.broadcast((frequent, pairs, hot))  # four bitmaps of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, two, often = sent.value
        tries: dict[str, _Counting] = {}

        def spill(to: int) -> Iterator[pa.RecordBatch]:
            for counting in tries.values():
                yield from counting.runs(to // len(tries), buckets, often)

        for batch in batches:
            for lang, text in _texts_by_lang(batch):
                counting = tries.get(lang)
                if counting is None:
                    counting = tries[lang] = _Counting(lang, seed, words, two)
                counting.add(text)
                if counting.vocabulary.full:
                    yield from counting.runs(0, buckets, often)
                    del tries[lang]
                elif sum(t.trie.entries + len(t.vocabulary) // 2 for t in tries.values()) > TRIE_ENTRIES:
                    yield from spill(TRIE_ENTRIES // 2)
                    if sum(len(t.vocabulary) for t in tries.values()) > WORD_ENTRIES:
                        yield from spill(0)
                        tries.clear()
        if tries:
            yield from spill(0)

    runs = texts.mapInArrow(run, "bucket long, lang string, keys array<long>, counts array<long>")
    return runs.groupBy("bucket").applyInArrow(_merge(least, 2 if pairs is None else LONGEST), _PHRASES)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, sizes): (lang, w1..w4, f) of all phrases of 1 to 4 words that occur ``least``
    times, (lang, w1, word) of the frequent words, and (lang, n)."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.cast("binary").alias("text"))
    seed = 0
    while True:
        words = materialise(count_words(texts, seed), "words")
        if words.groupBy("lang", "id").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words share a number: other numbers
    total = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // PARTITION_ENTRIES))
    none = [F.lit(0).cast("long").alias(k) for k in _KEYS[1:]]
    known = materialise(words.where(F.col("n") >= least).select("lang", F.col("id").alias("w1"), *none, F.col("n").alias("f"), "word"), "frequent-words")
    often = F.col("f") > PARTITION_ENTRIES // 4
    frequent, hot = bitmap_of(known, known.count(), 1), [bitmap_of(known.where(often), known.where(often).count(), 1)]
    pairs = materialise(count_phrases(texts, frequent, None, hot, buckets, seed, least), "pairs")
    hot.append(bitmap_of(pairs.where(often), pairs.where(often).count(), 2))
    longer = materialise(count_phrases(texts, frequent, bitmap_of(pairs, pairs.count(), 2), hot, buckets, seed, least), "phrases")
    phrases = known.drop("word").unionByName(pairs).unionByName(longer)
    return phrases, known.select("lang", "w1", "word"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _key(*parts: Column | None) -> Column:
    """A phrase as a struct of four words, 0 for none."""
    filled = [*parts, *[F.lit(0).cast("long")] * (LONGEST - len(parts))]
    return F.struct(*[p.alias(k) for p, k in zip(filled, _KEYS)])


def _cuts() -> Column:
    """All cuts of a phrase in two: (k, first, rest)."""
    w1, w2, w3, w4 = map(F.col, _KEYS)
    two = [(1, _key(w1), _key(w2, w3, w4), F.lit(True)), (2, _key(w1, w2), _key(w3, w4), w3 != 0), (3, _key(w1, w2, w3), _key(w4), w4 != 0)]
    made = F.array(*[F.when(there, F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))) for k, first, rest, there in two])
    return F.filter(made, lambda c: c.isNotNull())


def _inside() -> Column:
    """The phrases of two and more words inside a phrase of three or four, itself left out."""
    w1, w2, w3, w4 = map(F.col, _KEYS)
    four = w4 != 0
    made = F.array(_key(w1, w2), _key(w2, w3), F.when(four, _key(w3, w4)), F.when(four, _key(w1, w2, w3)), F.when(four, _key(w2, w3, w4)))
    return F.filter(made, lambda c: c.isNotNull())


def _looked_up(cuts: DataFrame, phrases: DataFrame, part: str, name: str) -> DataFrame:
    """Adds the count of the part. A part that many phrases share is one row on the other side, so
    adaptive execution can split its phrases."""
    counts = phrases.select(F.col("lang").alias("__l"), *[F.col(k).alias(f"__{k}") for k in _KEYS], F.col("f").alias(name))
    match = [F.col("lang") == F.col("__l")] + [F.col(f"{part}.{k}") == F.col(f"__{k}") for k in _KEYS]
    return cuts.join(counts, match).drop("__l", *[f"__{k}" for k in _KEYS])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to 4 words.

    Null texts count as empty, a null language is ``und``; ids play no part, so repeated rows count
    each time. Very long texts are taken in windows that lose no phrase. An empty table, or one
    without a phrase that is frequent enough, gives no rows. Extra columns are ignored.
    """
    phrases, words, sizes = frequent_phrases(docs, least)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    candidates = phrases.where("w2 <> 0")
    inner = candidates.where("w3 <> 0").select("lang", "f", F.explode(_inside()).alias("key"))
    covering = inner.groupBy("lang", *[F.col(f"key.{k}").alias(k) for k in _KEYS]).agg(F.max("f").alias("longer"))
    free = candidates.join(covering, ["lang", *_KEYS], "left").where(
        F.col("longer").isNull() | (exact("longer") * 100 < exact("f") * COVERED_PERCENT)).drop("longer")
    cuts = free.select("lang", *_KEYS, "f", F.explode(_cuts()).alias("cut")).select("lang", *_KEYS, "f", "cut.*")
    counted = _looked_up(_looked_up(cuts, phrases, "first", "l"), phrases, "rest", "r")
    score = F.expr(f"cast(f as decimal(19,0)) * {SCORE} div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("lowest")
    scored = counted.groupBy("lang", *_KEYS, "f").agg(lowest).select("lang", *_KEYS, F.col("f").alias("a"), "lowest.*").drop("k")
    # the best by numbers, ties included, are few: only they get their words
    order = [F.desc("score"), F.desc("a")]
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    spelt = best.select("lang", F.struct(*_KEYS, "a", "l", "r", "score").alias("row"), F.posexplode(F.array(*_KEYS)).alias("pos", "w1")).where("w1 <> 0")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")
    named = spelt.join(words, ["lang", "w1"]).groupBy("lang", "row").agg(texts).select("lang", "phrase", "row.a", "row.l", "row.r", "row.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase"))).cast("long")
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS phrase FROM split, range(1, 5) ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (SELECT c.lang, c.a AS longer, array_to_string(c.w[i:i+j-1], ' ') AS phrase
  FROM cand c, range(2, 4) js(j), range(1, 4) starts(i) WHERE j < c.k AND i + j - 1 <= c.k),
covering AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY lang, phrase),
free AS (SELECT c.* FROM cand c LEFT JOIN covering v ON v.lang = c.lang AND v.phrase = c.phrase
  WHERE v.longer IS NULL OR 100 * CAST(v.longer AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)),
cuts AS (SELECT c.lang, c.phrase, c.a, j, p.f AS l, q.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (p.f + q.f) AS BIGINT) AS score
  FROM free c, range(1, 4) js(j), f p, f q WHERE j < c.k AND p.lang = c.lang AND p.phrase = array_to_string(c.w[1:j], ' ')
  AND q.lang = c.lang AND q.phrase = array_to_string(c.w[j+1:c.k], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""
