import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import token_counts as tc
from shelfwise.llm.pieces import model_path

MODEL = sentencepiece.SentencePieceProcessor(model_file=model_path())


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("   ▁\t\nabé<s>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pre_tokens_add_up(text):
    of = tc.Lengths(model_path(), {})
    assert sum(of[w] for w in tc.pre_tokens(text)) == len(MODEL.encode(text))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(d.doc_id, len(d.text.encode()), n := len(MODEL.encode(d.text)), n > 4096) for d in docs}
    got = tc.op8_token_counts(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_small_bounds_change_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(tc.count_tokens(docs).collect())
    monkeypatch.setattr(tc, "CACHE_ENTRIES", 50)
    assert len(tc.frequent_lengths(docs, model_path(), entries=10)) == 10
    of = tc.Lengths(model_path(), {})
    assert sorted(sum(map(of.__getitem__, tc.pre_tokens(d.text))) for d in docs.collect()) == sorted(r.n_tokens for r in want)


def test_odd_rows(spark, write, odd_docs):
    folder = write(odd_docs)
    got = sorted(map(tuple, tc.op8_token_counts(spark, folder).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n := len(MODEL.encode(r[1] or "")), n > 4096) for r in odd_docs]
    assert got == sorted(want, key=str)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert tc.count_tokens(docs.where("doc_id < 0")).count() == 0


def test_long_words_are_counted_but_not_kept(spark):
    rows = [(i, "ab" * n + " short short") for i, n in enumerate((10, 40, 50_000, 50_000))]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n_tokens string, word string").coalesce(1)
    assert set(tc.frequent_lengths(docs, model_path())) == {"short"}
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs).collect()} == {i: len(MODEL.encode(t)) for i, t in rows}
    of = tc.Lengths(model_path(), {})
    assert of["a" * 1000] > 1 and not of


def test_other_normalisers_are_refused(tmp_path):
    mapped = sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()
    (tmp_path / "m.model").write_bytes(mapped)
    with pytest.raises(ValueError, match="normaliser"):
        tc._model(str(tmp_path / "m.model"))
