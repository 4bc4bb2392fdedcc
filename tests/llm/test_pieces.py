import hashlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import pieces as pc

MODEL = sentencepiece.SentencePieceProcessor(model_file=pc.model_path())
TEXT = st.text(st.one_of(st.sampled_from(" ▁\t\nabcé"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encode_equals_the_library_and_spans_tile_the_text(text):
    codec = pc.codec(pc.model_path())
    ids, starts, ends = codec.encode(text)
    assert ids.tolist() == MODEL.encode(text, add_bos=True, add_eos=True)
    raw, at = text.encode(), 0
    for i, s, e in zip(ids.tolist(), starts, ends, strict=True):
        assert s == at or s == e
        surface = raw[s:e]
        if MODEL.is_byte(i):
            assert surface == bytes([int(MODEL.id_to_piece(i)[3:5], 16)])
        elif e > s:
            piece = MODEL.id_to_piece(i).encode()
            assert surface.replace(b" ", pc._SPACE) in (piece, piece.removeprefix(pc._SPACE))
        at = max(at, e)
    assert at == len(raw)
    assert codec.decode(ids) == MODEL.decode(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_character_map_equals_the_library(text):
    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=True, add_dummy_prefix=True, escape_whitespaces=True)
    text = text.replace("\0", "")
    got = pc.Normaliser(own.serialized_model_proto())(text)
    assert got.text.decode() == own.normalize(text)
    assert len(got.begin) == len(got.end) == len(got.text)
    assert (np.diff(got.begin) >= 0).all() and (got.begin <= got.end).all() and (got.end <= len(text.encode())).all()


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in pc.op7_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = MODEL.encode(d.text, add_bos=True, add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.covered) == (len(ids), len(d.text.encode()))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()


def test_odd_rows_and_round_trip(spark, write, odd_docs):
    folder = write(odd_docs)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    coded = pc.encode(docs)
    back = sorted(map(tuple, pc.decode(coded).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in odd_docs), key=str)
    assert {tuple(r.ids) for r in coded.where("doc_id in (4, 5)").collect()} == {(1, 2)}
    assert pc.op7_sentencepiece(spark, folder).count() == len(odd_docs)
    assert pc.round_trip(docs.where("doc_id < 0")).count() == 0
