"""Toxicity scores from misspelling-tolerant lexicon hits and the context around them.

The lexicon - whole words, and stems that take many endings - is induced from labelled
documents. Its trie is intersected with Levenshtein automata: a state is the set of trie nodes
within the allowed edits of what was read, and states are built when first reached, so a word
is looked up by one table step a character. Around each hit a window of words tells quotation
from abuse: quotation marks, and cue words learned from the windows. A small logistic model
turns the hits of a text into a score. Scores see the text only.
"""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

#: Labelled rows of each class that the model is fitted on: least hashes of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
#: A term needs this log-odds (its lower bound) and this G statistic (beyond chance among millions of words).
MIN_LOG_ODDS, MIN_G, MIN_DOCS = 1.5, 24.0, 4
#: A context cue occurs in at most this share of the documents.
MAX_CUE_SHARE = 0.1
#: Shortest and longest stem; most terms, the strongest first.
STEMS, MAX_TERMS = range(4, 9), 2000
#: Words before and after a hit that make its context; what an edit and a quotation leave of a hit.
WINDOW, EDIT_FACTOR, QUOTE_FACTOR = 6, 0.7, 0.25
_CACHE = 1 << 18
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "“«„‹", "”»›"
Term = tuple[str, bool, float]  # text, whether it is a stem, log-odds


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """Words within the allowed edits of a term, and stems at the start of words."""

    def __init__(self, terms: Iterable[Term]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget = [0]  # most edits of any term at or below the node
        for k, (text, stem, _) in enumerate(self.terms):
            edits = 0 if stem else allowed_edits(len(text))
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.ends[node].append(k)
        self.alphabet = set(chain.from_iterable(self.children))
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._steps: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, False): 0})

    def _state(self, reached: dict[tuple[int, bool], int]) -> int:
        """Close under skipped term letters, and give the set of (node, stem passed) a number."""
        todo = list(reached)
        while todo:
            node, passed = todo.pop()
            e = reached[node, passed]
            if passed:
                continue
            if any(self.terms[k][1] for k in self.ends[node]) and e == 0 and (node, True) not in reached:
                reached[node, True] = 0
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < reached.get((child, False), 99):
                    reached[child, False] = e + 1
                    todo.append((child, False))
        key = tuple(sorted((n, p, e) for (n, p), e in reached.items()))
        if key not in self._ids:
            self._ids[key] = len(self._states)
            self._states.append(key)
        return self._ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[tuple[int, bool], int] = {}

        def reach(node: int, passed: bool, e: int) -> None:
            if e <= (0 if passed else self.budget[node]) and e < out.get((node, passed), 99):
                out[node, passed] = e

        for node, passed, e in self._states[state]:
            if passed:
                reach(node, True, 0)
                continue
            reach(node, False, e + 1)  # a letter too many
            for label, child in self.children[node].items():
                reach(child, False, e if label == c else e + 1)
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """Best (term, edits): fewest edits, then the strongest term."""
        # states are built anew once there are many; a word adds few, as it soon leaves the trie
        if len(self._states) >= _CACHE or len(self._steps) >= 4 * _CACHE:
            self._reset()
        state, steps = self.start, self._steps
        for c in word:
            c = c if c in self.alphabet else "\0"  # all foreign letters behave alike
            found = steps.get((state, c))
            if found is None:
                found = steps[state, c] = self._step(state, c)
            state = found
            if not self._states[state]:
                return None
        hits = []
        for node, passed, e in self._states[state]:
            for k in self.ends[node]:
                text, stem, odds = self.terms[k]
                if (passed and stem) or (not passed and e <= (0 if stem else allowed_edits(len(text)))):
                    hits.append((e, -odds, k))
        return (min(hits)[2], min(hits)[0]) if hits else None


class Finder:
    """Hits of a text, with a cache from raw words, as most words of a corpus are frequent."""

    def __init__(self, automaton: LexiconAutomaton):
        self.automaton, self.cache = automaton, {}

    def look_up(self, raw: str) -> tuple[tuple[int, int], ...]:
        found = tuple(m for w in _WORD.findall(raw) if (m := self.automaton.match(w)))
        if len(self.cache) >= _CACHE:
            self.cache.clear()
        self.cache[raw] = found
        return found

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, bool, list[str]]]]:
        """Number of words, and (term, edits, quoted, window words) of each hit."""
        words = (text or "").lower().split()
        cache, look_up, out = self.cache.get, self.look_up, []
        at = [i for i, w in enumerate(words) if (look_up(w) if (f := cache(w)) is None else f)]
        for i in at:
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            cut = self._split(words[i])
            quoted = is_quoted(" ".join([*before, cut[0]]), " ".join([cut[1], *after]))
            window = [m.group() for w in chain(before, after) if (m := _WORD.search(w))]
            # looked up again, as the cache may have been emptied since
            out += [(term, edits, quoted, window) for term, edits in look_up(words[i])]
        return len(words), out

    @staticmethod
    def _split(raw: str) -> tuple[str, str]:
        spans = [m.span() for m in _WORD.finditer(raw)]
        return raw[: spans[0][0]], raw[spans[-1][1] :]


def is_quoted(before: str, after: str) -> bool:
    """Whether quotation marks open before and close after."""
    if before.count('"') % 2 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in _OPEN)
    closed = min((i for c in _CLOSE if (i := after.find(c)) >= 0), default=-1)
    return opened >= 0 and opened > max(before.rfind(c) for c in _CLOSE) and closed >= 0


class Model:
    def __init__(self, terms: list[Term], cues: dict[str, float] | None = None, weights: np.ndarray | None = None):
        self.terms, self.cues, self.weights = terms, cues or {}, weights
        self._finder: Finder | None = None

    def __getstate__(self):
        return self.__dict__ | {"_finder": None}  # automata are built in each worker

    @property
    def finder(self) -> Finder:
        self._finder = self._finder or Finder(LexiconAutomaton(self.terms))
        return self._finder

    def features(self, text: str | None) -> list[float]:
        """Strength, number, quoted, misspelt and density of the hits."""
        n, hits = self.finder.hits(text)
        strength = quoted = misspelt = 0.0
        for term, edits, in_quotes, window in hits:
            cue = 1 / (1 + math.exp(-sum(self.cues.get(w, 0.0) for w in set(window))))  # 1/2: no cue
            strength += self.terms[term][2] * EDIT_FACTOR**edits * (QUOTE_FACTOR if in_quotes else 1.0) * 2 * cue
            quoted += in_quotes
            misspelt += edits > 0
        return [math.log1p(strength), math.log1p(len(hits)), math.log1p(quoted), math.log1p(misspelt), strength / max(1, n)]

    def score(self, text: str | None) -> float:
        x = float(np.dot(self.weights, [1.0, *self.features(text)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _log_odds(hit: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a document having the feature, less two standard errors, so that words of a few
    copies weigh little; and the G statistic of the two counts."""
    odds = np.log((hit + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / (hit + 0.5) + 1 / (clean + 0.5)), 0)
    n = hit + clean
    expect1, expect0 = n * n1 / (n1 + n0), n * n0 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(hit > 0, hit * np.log(hit / expect1), 0) + np.where(clean > 0, clean * np.log(clean / expect0), 0))
    return odds, g


def _word_features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def _count_features(wanted: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = _word_features(text.as_py())
                counts.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])

    return run


def _counts(texts: DataFrame, wanted: set[str] | None, least: int) -> dict[str, int]:
    counted = texts.select("text").mapInArrow(_count_features(wanted), "f string, n long")
    table = counted.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    return dict(zip(table["f"], table["n"], strict=True))


def induce_terms(hit: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> list[Term]:
    """Words and stems that mark toxic documents. A stem counts if its documents spread over
    several continuations. Words that a kept stem covers stay beside it, as only words may be
    misspelt, and do not count towards MAX_TERMS."""
    names = sorted(hit)
    odds, g = _log_odds(np.array([hit[f] for f in names], float), np.array([clean.get(f, 0) for f in names], float), n1, n0)
    strong = {f: float(o) for f, o, s in zip(names, odds, g, strict=True) if o >= MIN_LOG_ODDS and s >= MIN_G}
    longest: dict[str, int] = {}
    for f in hit:  # the commonest way to go on from each stem
        stem = f[:-1] if f.endswith("*") else f
        # a long word goes on from the longest stem counted
        for parent in {stem[: min(len(stem) - 1, STEMS[-1])], stem}:
            if f != f"{parent}*":
                longest[parent] = max(longest.get(parent, 0), hit[f])
    stems = {f[:-1] for f in strong if f.endswith("*") and longest.get(f[:-1], 0) < 0.9 * hit[f]}
    stems = {s for s in stems if not any(s[:k] in stems for k in STEMS if k < len(s))}
    words = {f for f in strong if not f.endswith("*")}
    covered = {w for w in words if any(w[:k] in stems for k in STEMS)}
    terms = [(s, True, strong[f"{s}*"]) for s in stems] + [(w, False, strong[w]) for w in words - covered]
    terms = sorted(terms, key=lambda t: (-t[2], t[0]))[:MAX_TERMS]
    stems = {t for t, stem, _ in terms if stem}
    terms += [(w, False, strong[w]) for w in covered if any(w[:k] in stems for k in STEMS)]
    return sorted(terms, key=lambda t: (-t[2], t[0]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the ridge keeps weights finite when the classes separate."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two least hashes of the word triples of each text: near copies mostly share both."""
    for batch in batches:
        low = []
        for text in batch.column(0):
            w = (text.as_py() or "").lower().split()
            triples = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
            low.append([min(xxhash.xxh64_intdigest(t, seed) for t in triples) >> 1 for seed in (1, 2)])
        first, second = (pa.array([x[k] for x in low], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first, second], names=["text", "toxic", "first", "second"])


def _without_copies(sample: DataFrame) -> DataFrame:
    """One text of those that share a least hash, so a group of near copies counts about once."""
    rows = sample.select("text", "toxic").mapInArrow(_sketches, "text string, toxic int, first long, second long")
    for key in ("first", "second"):
        rows = rows.groupBy(key).agg(F.min_by(F.struct("text", "toxic", "first", "second"), F.xxhash64("text", "toxic")).alias("one")).select("one.*")
    return rows.select("text", "toxic")


def _describe(model: Model):
    """Features of each row, and the words of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = pa.array([model.features(t) for t in texts], pa.list_(pa.float64()))
            near = [sorted({w for h in model.finder.hits(t)[1] for w in h[3]}) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), x, pa.array(near, pa.list_(pa.string()))], names=["toxic", "x", "near"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents; near copies count about once for the lexicon.

    The sample has one row for each labelled id and text, at most SAMPLE_TOXIC and SAMPLE_CLEAN
    rows, whatever an id or its label repeats; an id labelled both ways counts as toxic. Without
    labelled documents of both kinds the model has no terms and scores by the base rate.
    """
    spark = docs.sparkSession
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.where("toxic = 1").orderBy(*by_hash).limit(SAMPLE_TOXIC)
    chosen = chosen.unionByName(marked.where("toxic = 0").orderBy(*by_hash).limit(SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    taken = [rows.where(F.col("toxic") == k).orderBy(*by_hash, "text").limit(most) for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = materialise(taken[0].unionByName(taken[1]).select("text", "toxic"), "toxic-sample")
    distinct = materialise(_without_copies(sample), "toxic-distinct")
    sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    terms: list[Term] = []
    hit, clean = {}, {}
    if n1 and n0:
        hit = _counts(distinct.where("toxic = 1"), None, MIN_DOCS)
        clean = _counts(distinct.where("toxic = 0"), set(hit), 1)
        terms = induce_terms(hit, clean, n1, n0)
    rows = sample.mapInArrow(_describe(Model(terms)), "toxic int, x array<double>, near array<string>").toPandas()
    if not len(rows):
        return Model([], weights=np.array([math.log(0.1 / 0.9), 0, 0, 0, 0, 0]))
    near = [Counter(w for ws in rows["near"][rows["toxic"] == k] for w in ws) for k in (1, 0)]
    with_hits = [sum(len(ws) > 0 for ws in rows["near"][rows["toxic"] == k]) for k in (1, 0)]
    words = sorted(set(near[0]) | set(near[1]))
    cues: dict[str, float] = {}
    if words and min(with_hits):
        odds, g = _log_odds(np.array([near[0][w] for w in words], float), np.array([near[1][w] for w in words], float), *with_hits)
        rare = MAX_CUE_SHARE * (n1 + n0)  # frequent words tell languages apart, not contexts
        named = {t for t, _, _ in terms}
        cues = {w: float(o) for w, o, s in zip(words, odds, g, strict=True) if s >= MIN_G and hit.get(w, 0) + clean.get(w, 0) <= rare and w not in named}
    model = Model(terms, cues)
    if cues:  # cues change the features
        rows = sample.mapInArrow(_describe(model), "toxic int, x array<double>, near array<string>").toPandas()
    # the sample holds more toxic rows than the corpus: weigh the intercept back
    weights = fit_logistic(np.stack(rows["x"]), rows["toxic"].to_numpy(float))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = rows["toxic"].value_counts()
    if len(taken) == 2:
        weights[0] += math.log(total[1] / taken[1]) - math.log(total[0] / taken[0])
    model.weights = weights
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score`` of each row, from the whole text, however long; null texts score like
    empty ones. Repeated rows are scored each, an empty table gives no rows, extra columns are
    ignored, whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
