"""Token counts by a map-side two-tier lookup.

A pre-token is a word with the spaces before it. No vocabulary piece crosses the border between
two pre-tokens (checked when the model is opened), so a text's count is the sum over them. Tier
one is a compact table of the most frequent pre-tokens with their lengths, broadcast; tier two
a bounded cache in each worker, which encodes what it has not seen. Pre-tokens are never shuffled
as rows; only each task's short list of its most frequent ones is, to choose the table.
"""

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.pieces import Normaliser, model_path

#: Entries of the broadcast table, and what each task may propose for it.
TABLE_ENTRIES, TASK_ENTRIES = 1 << 16, 1 << 13
#: Entries a worker's cache, and a task's running counts, may hold before they are cut back.
CACHE_ENTRIES = 1 << 18
#: Longer pre-tokens are neither counted for the table nor kept, so that entries bound bytes (some 10 MB, some 50 MB).
LONGEST = 64
LIMIT = 4096
_MARK = "▁"
_RUN = re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+")


def pre_tokens(text: str) -> list[str]:
    """Words with all but one of the marks before them; joined by " " they are the text again,
    up to marks written as spaces."""
    if not text:
        return []
    if "  " not in text and _MARK not in text and text[0] != " ":
        return text.split(" ")
    # the leading mark that the model adds belongs to the first run
    return [run[1:] for run in _RUN.findall(" " + text.replace(_MARK, " "))]


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    with open(path, "rb") as f:
        normalise = Normaliser(f.read())
    if normalise.map or normalise.trim or not (normalise.prefix and normalise.mark):
        raise ValueError("the model's normaliser does more than mark spaces: counts of words do not add up for it")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        if _MARK in model.id_to_piece(i).lstrip(_MARK):
            raise ValueError(f"piece {i} crosses words: counts of words do not add up for this model")
    return model


class Lengths(dict):
    """Tier two: lengths of pre-tokens, encoded when first asked for."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__()
        self.model, self.table = _model(path), table
        # the empty pre-token is a lone mark: one piece, or its bytes
        self.lone_mark = len(_MARK.encode()) if self.model.piece_to_id(_MARK) == self.model.unk_id() else 1

    def __missing__(self, word: str) -> int:
        n = self.table.get(word)
        if n is None:
            n = len(self.model.encode(word)) if word else self.lone_mark
        if len(word) <= LONGEST:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's most frequent pre-tokens. Counts are cut back to the larger half whenever they
    outgrow the bound, so memory is fixed; a rare word may be lost, which costs time only."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = pre_tokens(text or "")
            counts.update(words if max(map(len, words), default=0) <= LONGEST else [w for w in words if len(w) <= LONGEST])
            if len(counts) > CACHE_ENTRIES:
                counts = Counter(dict(counts.most_common(CACHE_ENTRIES // 2)))
    best = [x for x in counts.most_common(TASK_ENTRIES) if x[1] > 1]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])


def frequent_lengths(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all documents; at most ``entries``."""
    proposed = docs.select("text").mapInArrow(_propose, "word string, n long")
    top = proposed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    words = top.select("word").toPandas()["word"].tolist()
    lengths = Lengths(path, {})
    return {w: lengths[w] for w in words}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null texts count as empty.

    Repeated rows are counted like any others, an empty table gives no rows, extra columns are
    ignored. The table only saves time: counts are those of the model whatever it holds.
    """
    path = path or model_path()
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Lengths(path, table.value).__getitem__
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            n = pa.array([sum(map(of, pre_tokens(t.as_py() or ""))) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
