"""Offset-preserving SentencePiece encoding, and decoding.

Text is normalised by longest-prefix replacement through the model's compiled character map.
Each normalised byte remembers the source bytes it stands for, so every piece is projected back
to a span of bytes of the original text.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
_SPACE = "▁".encode()


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the top-level fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
        yield tag >> 3, blob[at : at + size]
        at += size


class CharMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie, then the texts
    it points to. The bit layout of a unit is fixed by the public Darts-clone format."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def match(self, source: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at ``start``, and what replaces it."""
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i in range(start, len(source)):
            node ^= source[i]
            if node >= len(units) or units[node] & 0x800000FF != source[i]:
                break
            unit = units[node]
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - start, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.texts.index(0, found[1])
        return found[0], self.texts[found[1] : end]


class Aligned(NamedTuple):
    """Normalised bytes; byte i stands for source bytes begin[i] to end[i]."""

    text: bytes
    begin: np.ndarray
    end: np.ndarray


class Normaliser:
    """The normalisation a model file asks for."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for n, v in _fields(model) if n == 3), b"")))
        blob = spec.get(2, b"")
        self.map = CharMap(blob) if blob else None
        self.prefix, self.trim, self.mark = (bool(spec.get(n, 1)) for n in (3, 4, 5))

    def __call__(self, text: str) -> Aligned:
        source = text.encode()
        if not source:
            return Aligned(b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if self.map is None and not self.trim:
            return self._plain(source)
        return self._mapped(source)

    def _plain(self, source: bytes) -> Aligned:
        """Without a map only spaces change, so the alignment needs no walk over the text."""
        space = _SPACE if self.mark else b" "
        raw = np.frombuffer(source, np.uint8)
        begin = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
        text, end = source.replace(b" ", space), begin + 1
        if self.prefix:
            none = np.zeros(len(space), np.int64)
            text, begin, end = space + text, np.append(none, begin), np.append(none, end)
        return Aligned(text, begin, end)

    def _mapped(self, source: bytes) -> Aligned:
        space = _SPACE if self.mark else b" "
        chunks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(source):
            hit = self.map.match(source, at) if self.map else None
            lead = source[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            size, out = hit or (size, source[at : at + size])
            chunks += [(bytes([b]), at, at + size) for b in out]
            at += size
        if self.trim:  # no white space at the ends, one space between words
            chunks = [c for i, c in enumerate(chunks) if c[0] != b" " or (i and chunks[i - 1][0] != b" ")]
            while chunks and chunks[-1][0] == b" ":
                chunks.pop()
        if not chunks:
            return Aligned(b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if self.prefix:
            chunks.insert(0, (b" ", chunks[0][1], chunks[0][1]))
        chunks = [(c if b != b" " else c, s, e) for b, s, e in chunks for c in ([bytes([x]) for x in space] if b == b" " else [b])]
        return Aligned(b"".join(c for c, _, _ in chunks), np.array([s for _, s, _ in chunks]), np.array([e for _, _, e in chunks]))


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.normalise = Normaliser(f.read())
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        # bytes of normalised text under each id; a byte piece covers one, a control piece none
        self.covers = np.array([1 if self.model.is_byte(i) else 0 if self.model.is_control(i) else len(self.model.id_to_piece(i).encode()) for i in ids])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the begin and end ids, and the span of source bytes under each.

        A span covers whole source characters where the model's pieces do; the ids that stand
        for nothing in the text (begin, end, the leading mark) have empty spans.
        """
        ids = np.array(self.model.encode(text, add_bos=True, add_eos=True), np.uint32)
        aligned = self.normalise(text)
        covers = self.covers[ids]
        if (ids == self.model.unk_id()).any():  # an unknown piece covers what the text has there
            own = self.model.encode(text, out_type="immutable_proto").pieces
            covers[1:-1] = [covers[k] if p.id != self.model.unk_id() else len(p.piece.encode()) for k, p in enumerate(own, 1)]
        stop = np.cumsum(covers)
        start = stop - covers
        size = len(text.encode())
        begins, ends = np.append(aligned.begin, size), np.append(0, aligned.end)
        from_ = begins[start]
        return ids, from_, np.maximum(ends[stop], from_)

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def _rows_of(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """``make(text)`` for each row's last column, beside its other columns; small batches out."""
    for batch in batches:
        for start in range(0, len(batch), most):
            part = batch.slice(start, most)
            made = zip(*[make(t or "") for t in part.column(part.num_columns - 1).to_pylist()], strict=True)
            keys = [part.column(i) for i in range(part.num_columns - 1)]
            names = schema.names[len(keys):]
            columns = [pa.array(list(c), schema.field(n).type) for c, n in zip(made, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=schema.names)


def _map_texts(docs: DataFrame, make, **columns: tuple[T.DataType, pa.DataType]) -> DataFrame:
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, k[0]) for n, k in columns.items()]])
    arrow = pa.schema([("doc_id", pa.int64()), *[(n, k[1]) for n, k in columns.items()]])
    return docs.select("doc_id", "text").mapInArrow(lambda it: _rows_of(it, make, arrow), out)


_INTS, _LONGS = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
_LONG, _TEXT = (T.LongType(), pa.int64()), (T.StringType(), pa.string())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends: every piece with its span of bytes in the original text.

    Null texts count as empty: they give the begin and end ids only. Rows are independent, so
    repeated rows, null ids and extra columns need no care; no shuffle.
    """
    path = path or model_path()

    def make(text: str):
        ids, starts, ends = codec(path).encode(text)
        return ids.astype(np.int32), starts, ends

    return _map_texts(docs, make, ids=_INTS, starts=_LONGS, ends=_LONGS)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    path = path or model_path()
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of what ``encode`` and ``decode`` give, taken in the same pass over the text.

    doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256, spans_sha256
    (start and end of each piece in turn, as little-endian 64-bit), covered (source bytes
    under at least one piece's end). Null texts count as empty; repeated rows are coded like any
    others, very long texts are coded whole, an empty table gives no rows, extra columns are ignored.
    """
    path = path or model_path()

    def make(text: str):
        ids, starts, ends = codec(path).encode(text)
        spans = np.stack([starts, ends], 1).astype("<i8").tobytes()
        hashed = (hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), codec(path).decode(ids).encode(), spans))
        return len(ids), *hashed, int(ends.max(initial=0))

    return _map_texts(docs, make, n_tokens=_LONG, ids_sha256=_TEXT, decoded_sha256=_TEXT, spans_sha256=_TEXT, covered=_LONG)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
