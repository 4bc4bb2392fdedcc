from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.llm import mixing as mx


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_one_period_is_fair_after_every_slot(parts):
    quota = {f"s{i}": n for i, n in enumerate(parts)}
    order, seen = mx.one_period(quota), dict.fromkeys(quota, 0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        for x, n in quota.items():
            assert abs(seen[x] - Fraction(n * t, sum(parts))) < 1
    assert seen == quota


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.01, 100), min_size=1, max_size=30), st.integers(1, 200))
def test_quotas_fill_the_period(weights, period):
    q = mx.quotas(weights, period)
    assert sum(q.values()) == max(period, len(weights)) and min(q.values()) >= 1


def slow_order(sizes, weights, block, period):
    """(source, block) slot by slot, choosing at each slot by looking at every source."""
    left = {s: -(-n // block) for s, n in sizes.items() if n}
    done, out = dict.fromkeys(left, 0), []
    while left:
        quota = mx.quotas({s: weights[s] for s in left}, period)
        total, t, k = sum(quota.values()), 0, dict.fromkeys(left, 0)
        while all(left.values()):
            ready = [(-(-(k[s] + 1) * total // quota[s]), s) for s in left if k[s] * total // quota[s] <= t]
            s = min(ready)[1]
            out.append((s, done[s]))
            k[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


def check(got, sizes, weights, block, period):
    assert sorted(r.position for r in got) == list(range(sum(sizes.values())))
    order = []
    for r in sorted(got, key=lambda r: r.position):
        if not order or order[-1] != (r.source, r.block):
            order.append((r.source, r.block))
    assert order == slow_order(sizes, weights, block, period)


@pytest.mark.parametrize("block,period,weights", [(1, 7, {"a": 3, "b": 1, "": 2}), (4, 20, {"a": 1, "b": 1, "": 5}), (32, 1000, None)])
def test_whole_schedule_against_slot_by_slot(spark, block, period, weights):
    sizes = {"a": 61, "b": 7, "": 33}
    rows = [(i, f"t{i}", s or None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.schedule(docs, weights, block=block, period=period).select("doc.doc_id", "source", "block", "slot", "phase", "position").collect()
    check(got, sizes, weights or mx.default_weights(sizes), block, period)
    assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 100)
    got = mx.op1_mixing(spark, sf_dir).collect()
    sizes = {r.source: r["count"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").count().collect()}
    check(got, sizes, mx.default_weights(sizes), mx.BLOCK_ROWS, mx.PERIOD)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = mx.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("buckets", [1 << 14, 4])
def test_parts_follow_the_schedule(spark, sf_dir, monkeypatch, tmp_path, buckets):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 40)
    monkeypatch.setattr(mx, "MAX_BUCKETS", buckets)
    monkeypatch.setattr(mx, "PART_ROWS", 90)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = mx.random_key(docs)
    want = [r.doc_id for r in mx.schedule(docs, key=key).orderBy("position").select("doc.doc_id").collect()]
    mixed = mx.mix(docs, key=key)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    mixed.write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    assert len(files) > 1 and [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == want


def test_rows_with_equal_keys_over_parts(spark, monkeypatch):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 30)
    monkeypatch.setattr(mx, "LEAST_PART_ROWS", 10)
    rows = [(7 if i % 3 else i, "same" if i % 3 else f"t{i}", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mx.mix(docs, {"a": 2, "b": 1}, block=4)
    assert sorted(tuple(r) for r in mixed.collect()) == sorted(rows)
    assert mx.mix(docs, {"a": 2, "b": 1}, key=F.lit(1), block=4).count() == len(rows)


def test_odd_rows(spark, write, odd_docs):
    folder = write(odd_docs)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mx.mix(docs)
    assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(docs.collect(), key=str)
    assert mx.mix(docs.where("doc_id < 0")).count() == 0
    clash = docs.withColumnRenamed("lang", "position").withColumnRenamed("n_chars", "slot")
    assert mx.mix(clash).columns == clash.columns and mx.mix(clash).count() == len(odd_docs)
    with pytest.raises(ValueError):
        mx.mix(docs, {"a": 1.0})


def test_mixed_files_follow_the_schedule(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mx.mix(docs, {f"src{i}": 1.0 + i for i in range(20)}, block=4).write.parquet(str(tmp_path / "mixed"))
    want = [r.doc_id for r in mx.schedule(docs, {f"src{i}": 1.0 + i for i in range(20)}, block=4).orderBy("position").select("doc.doc_id").collect()]
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == want


@pytest.mark.parametrize("weights", [None, {f"s{i:02}": w for i, w in enumerate([1e-4, 0.3, 0.05, 7.0])}])
def test_every_prefix_is_near_the_target_weights(weights):
    sizes = {f"s{i:02}": 160_000 if i == 0 else 16_000 for i in range(20)} if weights is None else {s: 400_000 for s in weights}
    weights = weights or {s: n**mx.TEMPERATURE for s, n in sizes.items()}
    left = dict(weights)
    phases = mx.plan(sizes, weights, 4, mx.PERIOD)
    blocks = {}
    for s, phase, first, end, *_, slots in phases:
        blocks.setdefault(phase, {})[s] = list(slots)
        assert len(slots) == end - first
    assert sum(len(slots) for of in blocks.values() for slots in of.values()) == sum(-(-n // 4) for n in sizes.values())
    for of in blocks.values():
        total = sum(Fraction(left[s]) for s in of)
        assert sorted(t for slots in of.values() for t in slots) == list(range(sum(map(len, of.values()))))
        for s, slots in of.items():
            w = Fraction(left[s]) / total
            for k, t in enumerate(slots):  # just before and just after each block
                assert k - w * t > -1 and k + 1 - w * (t + 1) < 1
            assert len(slots) - w * sum(map(len, of.values())) > -1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", max_size=3), st.tuples(st.integers(1, 300), st.integers(1, 7)), min_size=1, max_size=7), st.integers(1, 3))
def test_repeated_periods_equal_slot_by_slot(of, block):
    sizes, weights = {s: n for s, (n, _) in of.items()}, {s: w for s, (_, w) in of.items()}
    phases, at = mx.plan(sizes, weights, block), {}
    for s, _, first, end, start, slots in phases:
        assert len(slots.dealt) <= sum(weights.values())
        for k in range(first, end):
            at[start + slots[k - first] * block] = (s, k)
    assert [at[p] for p in sorted(at)] == slow_order(sizes, weights, block, None)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_rows_over_many_periods(spark, monkeypatch, chunk):
    monkeypatch.setattr(mx, "CHUNK", chunk)
    sizes, weights = {"a": 610, "b": 70, "": 333}, {"a": 0.3, "b": 0.1, "": 0.5}
    rows = [(i, f"t{i}", s or None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mx.schedule(docs, weights, block=2).select("source", "block", "position").collect(), sizes, weights, 2, None)


def test_default_weights_do_not_grow_with_the_rows():
    sizes = {"hot": 10**10, "b": 10**9, "c": 5, "d": 0}
    weights, exact = mx.default_weights(sizes), {s: n**mx.TEMPERATURE for s, n in sizes.items()}
    for s, n in exact.items():
        assert abs(weights[s] - max(1, mx.SHARES * n / sum(exact.values()))) <= 0.5
    phases = mx.plan(sizes, weights, mx.BLOCK_ROWS)
    assert sum(len(slots) for *_, slots in phases) == sum(-(-n // mx.BLOCK_ROWS) for n in sizes.values())
    assert sum(len(slots.dealt) for *_, slots in phases) <= 3 * (mx.SHARES + len(sizes))


def test_any_positive_weights(spark):
    """A weight that is nothing beside another: its block waits until the other source runs out."""
    sizes = {"a": 40, "b": 6}
    for weights in ({"a": 0.1, "b": 1e-20}, {"a": 1e-300, "b": 1e300}):
        phases = mx.plan(sizes, weights, 2)
        assert sum(p[3] - p[2] for p in phases) == 23
    rows = [(i, s, "x") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mx.schedule(docs, {"a": 0.1, "b": 1e-20}, block=2).collect()
    assert sorted(r.position for r in got) == list(range(46))
    assert [r.source for r in sorted(got, key=lambda r: r.position)] == ["a"] * 40 + ["b"] * 6


def test_seven_digit_weights_over_a_million_blocks():
    """The order of a period longer than the data is held as 8 bytes a block, no more."""
    import tracemalloc

    rows = {"a": 400_000, "b": 800_000, "c": 300_000}
    weights = {"a": 0.2471113, "b": 0.5028887, "c": 0.25}
    tracemalloc.start()
    phases = mx.plan(rows, weights, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(p[3] - p[2] for p in phases) == 1_500_000 and peak < 60 << 20
    for s, _, first, end, _, slots in phases[:3]:
        for k in range(0, end - first, 997):
            assert k / weights[s] - 1 < slots[k] < (k + 1) / weights[s] + 1


def test_a_thousand_sources(spark):
    """A source with hundreds of phases: its blocks meet about two of them each."""
    import bisect

    sizes = {f"s{i:04}": 3 + i for i in range(1000)}
    phases = mx.plan(sizes, {s: 1 for s in sizes}, 3)
    planned = mx._tables(phases)
    own = [p for p in phases if p[0] == "s0999" and p[2] < p[3]]
    blocks = -(-sizes["s0999"] // 3)
    assert len(own) > 300 and planned[0].num_rows == 1000
    width, spans = dict(zip(*(c.to_pylist() for c in planned[0].columns)))["s0999"], [r for r in planned[1].to_pylist() if r["p_source"] == "s0999"]
    assert sum(sum(r["cell"] == k // width for r in spans) for k in range(blocks)) < 2.5 * blocks
    rows = spark.range(sizes["s0999"]).select(F.lit("s0999").alias("source"), F.col("id").alias("idx"))
    placed = mx._placed(rows, tuple(spark.createDataFrame(t) for t in planned), 3)
    firsts = [p[2] for p in own]
    want = [(i // 3, own[bisect.bisect_right(firsts, i // 3) - 1][1]) for i in range(sizes["s0999"])]
    assert [(r.block, r.phase) for r in placed.orderBy("idx").collect()] == want
