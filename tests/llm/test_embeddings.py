import numpy as np
import pytest

from compare import assert_same
from shelfwise.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow_links(rows):
    """{vec_id: (n_links, component)} with all pairs compared; vec_ids are unique."""
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.sqrt((v * v).sum())) for i, v in usable]
    links = {i: set() for i, _, _ in rows}
    for a, (i, u) in enumerate(unit):
        for j, w in unit[:a]:
            if len(u) == len(w) and u @ w >= 0.95:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(links):
        if i in out:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        for j in seen:
            out[j] = (len(links[j]), i)
    return out


def cloud(rng, n, dim, clusters):
    """Random vectors, then clusters of near copies and of exact copies."""
    v = list(rng.standard_normal((n, dim)))
    for size, spread in clusters:
        centre = rng.standard_normal(dim)
        v += [centre + spread * rng.standard_normal(dim) for _ in range(size)]
    order = rng.permutation(len(v))
    return [(int(i), np.float32(v[k]).tolist(), 0) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [em.BLOCK, 16])
def test_against_all_pairs(spark, write, tmp_path, monkeypatch, block):
    monkeypatch.setattr(em, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = cloud(rng, 900, 32, [(2, 0.1)] * 30 + [(40, 0.1), (25, 0.17), (60, 0.0), (5, 0.0)])
    write(rows, "embeddings", SCHEMA)
    got = {r.vec_id: r for r in em.op10_embeddings(spark, str(tmp_path)).collect()}
    want = slow_links(rows)
    assert len(got) == len(rows)
    found, true = sum(min(got[i].n_links, n) for i, (n, _) in want.items()), sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items()) and found >= 0.97 * true
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_given_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in em.op10_embeddings(spark, folder).collect()}
    assert got == slow_links(rows)


def test_agrees_with_sql(spark, sf_dir):
    assert_same(em.op10_embeddings(spark, sf_dir), em.OP10_SQL, sf_dir)


def test_odd_rows(spark, write, tmp_path):
    a, nan, inf = [1.0, 2.0, 0.5], float("nan"), float("inf")
    rows = [(5, a, 1), (3, a, 1), (3, a, 1), (None, a, 1), (7, [2.0, 4.0, 1.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 2.0], None), (8, [3.0, -1.0, 0.0], 1),
            (10, None, 1), (11, [], 1), (12, [0.0, 0.0, 0.0], 1), (13, [1.0, None, 1.0], 1), (14, [nan, 1.0, 1.0], 1), (15, [inf, 1.0, 1.0], 1), (15, [inf, 1.0, 1.0], 1)]
    write(rows, "embeddings", SCHEMA)
    got = em.op10_embeddings(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id in (3, 5, 7)) == [(3, 4, 3, True), (3, 4, 3, True), (5, 4, 3, False), (7, 4, 3, False)]
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id in (8, 9)) == [(0, 8), (1, 8), (1, 8)]
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if (r.vec_id or 0) >= 10)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(4, 3, False)]
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    assert em.link(df.where("vec_id < 0")).count() == 0 and em.link(df.where("vec_id = 10")).count() == 1


@pytest.mark.parametrize("doublings,half,block", [(0, 14, em.BLOCK), (0, 14, 8), (em.MAX_DOUBLINGS, 80, em.BLOCK)])
def test_two_halves_that_fill_each_list(spark, write, tmp_path, monkeypatch, doublings, half, block):
    monkeypatch.setattr(em, "MAX_DOUBLINGS", doublings)
    monkeypatch.setattr(em, "BLOCK", block)
    rng = np.random.default_rng(half)
    first, off = np.eye(32)[:2]
    second = 0.97 * first + np.sqrt(1 - 0.97**2) * off
    vectors = [c + 0.003 * rng.standard_normal(32) for c in (first, second) for _ in range(half)] + [*rng.standard_normal((40, 32))]
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate(vectors)]
    write(rows, "embeddings", SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in em.op10_embeddings(spark, str(tmp_path)).collect()}
    assert got == slow_links(rows) and got[0] == (2 * half - 1, 0)


def test_audit_counts_each_query_once_and_each_size(spark):
    """A group of many copies, counted exactly, must not hide that the small groups are missed."""
    dim, unit = 60, np.eye(60)
    vectors = [(2 * g + s, 500 if g == 0 else 1, (unit[2 * g] + 0.2 * s * unit[2 * g + 1])) for g in range(30) for s in (0, 1)]
    nodes = spark.createDataFrame([(i, w, (v / np.linalg.norm(v)).tolist()) for i, w, v in vectors], "id long, weight long, unit array<double>")
    counted = spark.createDataFrame([(0, 500), (1, 500)], "id long, links long")
    assert em.audit(nodes, counted, len(vectors), dim, 0.95) < 0.1
