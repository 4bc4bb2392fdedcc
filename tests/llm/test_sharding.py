import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import sharding as sh
from shelfwise.llm.common import file_row


def check(got, n, shards=16):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_whole_table(spark, sf_dir):
    got = sh.op3_sharding(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(got, len(docs))
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d.doc_id, len(d.text.encode()) + 1, zlib.crc32(d.text.encode())) for d in docs}


def test_same_seed_same_places_whatever_the_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sh.shuffle_into_shards(d, 5, bucket_bytes=200_000).select("doc.doc_id", "shard", "slot").collect() for d in (docs, docs.repartition(13)))
    check(a, docs.count(), 5)
    assert sorted(a) == sorted(b)
    c = sh.shuffle_into_shards(docs, 5, seed=1, bucket_bytes=200_000).select("doc.doc_id", "shard", "slot").collect()
    assert sorted(a) != sorted(c)


def test_neighbours_come_from_all_over(spark, sf_dir):
    got = sh.shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, bucket_bytes=100_000).orderBy("shard", "slot").collect()
    steps = [abs(a.doc.doc_id - b.doc.doc_id) for a, b in zip(got, got[1:])]
    assert 200 < sum(steps) / len(steps) < 450  # a third of 1,000 is expected


def test_odd_rows(spark, write, odd_docs):
    folder = write(odd_docs)
    got = sh.op3_sharding(spark, folder).collect()
    check(got, len(odd_docs))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in odd_docs)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sh.shuffle_into_shards(docs.where("doc_id < 0")).count() == 0


def test_columns_clash_with_nothing(spark, write):
    names = ["doc_id", "text", "shard", "slot", "bucket", "offset", "doc", "file", "at", "__bucket"]
    rows = [(i, f"text {i}", *(f"{n}{i}" for n in names[2:])) for i in range(20)]
    docs = spark.read.parquet(f"{write(rows, schema=', '.join(f'{n} ' + ('long' if n == 'doc_id' else 'string') for n in names))}/documents.parquet")
    for row in (None, file_row(docs)):
        assert sorted(tuple(r.doc) for r in sh.shuffle_into_shards(docs, 3, row=row).collect()) == sorted(rows)


def test_places_against_a_recount(spark, write, sf_dir):
    """Buckets from the names of the rows, one after the other, each shuffled by its own seed."""
    for repeats, row in ((1, None), (1, file_row), (300, file_row)):
        rows = [(i // repeats, f"text {i // repeats} " * (i % 7 + 1 if repeats == 1 else 1), "en", "s", 1) for i in range(900)]
        docs = spark.read.parquet(f"{write(rows, name=f'd{repeats}')}/d{repeats}.parquet")
        name = row and row(docs)
        key = [F.col("doc_id"), F.col("text"), F.lit(None).cast("binary"), F.lit(None).cast("long")] if row is None else [F.lit(None).cast("long"), F.lit(None).cast("string"), name["file"], name["at"]]
        named = docs.select("doc_id", "text", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]).alias("k"), F.xxhash64(*key, F.lit(sh.SEED)).alias("h")).collect()
        total = sum(len(t.encode()) + 1 for _, t, *_ in rows)
        buckets = {}
        for r in named:
            buckets.setdefault(r.h % max(1, -(-total // 2000)), []).append(r)
        assert max(map(len, buckets.values())) < 300  # copies are spread where rows have names of their own
        want, place = [], 0
        for b in sorted(buckets):
            own = sorted(buckets[b], key=lambda r: [x for x in r.k if x is not None])
            order = np.arange(len(own))
            np.random.default_rng([sh.SEED, b]).shuffle(order)
            for i in order:
                want.append((own[i].doc_id, own[i].text, place % 16, place // 16))
                place += 1
        got = sh.shuffle_into_shards(docs, bucket_bytes=2000, row=name).select("doc.doc_id", "doc.text", "shard", "slot").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_written_shards(spark, sf_dir, tmp_path):
    sharded = sh.shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3)
    sh.write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select("doc.doc_id", "doc.text", "shard", "slot").collect()) == sorted(sharded.select("doc.doc_id", "doc.text", "shard", "slot").collect())
