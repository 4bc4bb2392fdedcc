import hashlib

import numpy as np
import sentencepiece

import corpus_pipeline
from shelfwise.llm import langid
from shelfwise.llm.pieces import model_path
from test_exact_dedup import norm
from test_simhash import slow_near_copies


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {d.doc_id: d for d in docs.collect()}
    model = langid.fit(docs)
    kept = {i: d for i, d in rows.items() if model.score(d.text).min() < 0 and model.languages[int(np.argmax(model.score(d.text)))] != langid.UNKNOWN}
    assert len(kept) > 0.99 * len(rows)
    first = {}
    for i in sorted(kept):
        first.setdefault(norm(kept[i].text), i)
    stay = {i for i, c in slow_near_copies({i: kept[i].text for i in first.values()}).items() if i == c}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == stay
    m = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for i in stay:
        ids = m.encode(rows[i].text, add_bos=True, add_eos=True)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_and_take_odd_rows(spark, write, odd_docs, tmp_path):
    folder = write(odd_docs)
    for table in (spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, table, folder)
            assert out.columns == table.columns and out.dtypes == table.dtypes, name
            table.sparkSession.catalog.clearCache()
            path = str(tmp_path / f"{name}-{table.count()}-{k}")
            out.write.parquet(path)
            table = spark.read.parquet(path)
        assert corpus_pipeline.STAGES[-1][1](spark, table, folder).count() == table.count()


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
