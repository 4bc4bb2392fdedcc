import random

import pytest

from shelfwise.llm.common import components


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, i) for i in range(2000, 2100)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    loops = {a for a, b in edges if a == b}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == find(n) for n in got)
    assert set(root) - loops <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_broadcast_depends_on_measured_size(spark):
    from pyspark.sql import functions as F

    from shelfwise.llm.common import broadcast_if_small

    df = spark.range(100)
    plans = {}
    for limit in (99, 100):
        small = broadcast_if_small(df, F.lit(1), "ids", limit)
        joined = spark.range(1000).join(small, "id")
        plans[limit] = joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 100
    assert "strategy=broadcast" in plans[100] and "strategy=broadcast" not in plans[99]
    assert broadcast_if_small(df.limit(0), F.lit(1), "none").count() == 0


def test_rows_keep_their_names_when_parallelism_changes(spark, tmp_path):
    """An executor that comes or goes changes how files are packed into tasks."""
    from pyspark.sql import functions as F

    from shelfwise.llm import exact_dedup, langid, simhash
    from shelfwise.llm.common import file_row, packed

    words = "the cat sat on a mat and it saw that dogs ran far from here to over there by night".split()
    rows = [(i, " ".join(random.Random(i // 2).choices(words, k=30)), "en", "s", i) for i in range(1200)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(path)
    default = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    got = {}
    try:
        for stage in (exact_dedup.deduplicate, simhash.keep_one_of_each, langid.keep_identified):
            for named in (True, False):
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", "8")
                docs = spark.read.parquet(path)
                kept = stage(docs, row=file_row(docs)) if named else stage(docs)
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
                got[stage.__name__, named] = {r.doc_id for r in kept.select("doc_id").collect()}
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "8")
        docs = spark.read.parquet(path)
        before = {r.row: r.n for r in packed(docs, file_row(docs)).select("row", F.col("doc.doc_id").alias("n")).collect()}
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
        assert before == {r.row: r.n for r in packed(docs, file_row(docs)).select("row", F.col("doc.doc_id").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if default is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", default)
    even = set(range(0, 1200, 2))
    assert {k: v == (set(range(1200)) if "identified" in k[0] else even) for k, v in got.items()} == dict.fromkeys(got, True)


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from shelfwise.llm.common import scratch_root

    nothing = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_root(SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing)))


CLASHING = ("row", "doc", "__row", "key", "unit", "digest", "shard", "slot", "language", "same", "kept", "source_", "position", "__bucket", "__offset", "ll", "fp")


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, f"the dogs and cats number {i // 2} ran here", "en", "s", 1, *(f"{c}{i}" for c in CLASHING)) for i in range(6)]
    table = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / str(k))
        table.write.parquet(path)
        table = stage(spark, spark.read.parquet(path), "")
        assert table.columns == [f.split()[0].strip("`") for f in schema.split(", ")]
    assert sorted(tuple(r) for r in table.collect()) == rows[::2]
    path = str(tmp_path / "last")
    table.write.parquet(path)
    assert corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(path), "").count() == 3


def test_plans_of_rounds_stay_small(spark, monkeypatch):
    """The driver plans each round anew and keeps its plans for a while, which is most of what it does."""
    from shelfwise.llm import common

    real, sizes = common.materialise, []

    def counted(df, name):
        sizes.append(df._jdf.queryExecution().sparkPlan().toString().count("\n"))
        return real(df, name)

    monkeypatch.setattr(common, "materialise", counted)
    got = {r.node: r.root for r in common.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0)
    assert len(sizes) > 2 and max(sizes) <= 66, sizes
