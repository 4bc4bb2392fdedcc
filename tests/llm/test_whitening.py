import numpy as np
import pytest

from shelfwise.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, components=16):
    """{vec_id: [(deviation, whitened...)]} with numpy and whole numbers of any size."""
    usable = [(i, v) for i, v, _ in rows if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    grid = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in usable]
    fit = sorted({x for _, x in grid})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    w = centred @ v[:, :k] / np.sqrt(e[:k])
    of = {x: (sum((n * a - b) ** 2 for a, b in zip(x, s)), r) for x, r in zip(fit, w)}
    return n, [(i, *of[x]) for i, x in grid], e[:k] / np.trace(cov)


def check(got, rows, components=16):
    n, want, shares = slow(rows, components)
    k = len(shares)
    assert len(got) == len(want) * k and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation)
    tables = {c: sorted((r for r in got if r.component == c), key=lambda r: (key(r), r.whitened)) for c in range(1, k + 1)}
    for c, table in tables.items():
        assert len(table) == len(want)
        assert abs(table[0].explained - shares[c - 1]) < 1e-9 and len({r.explained for r in table}) == 1
        ordered = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert [(r.vec_id, r.deviation) for r in table] == [r[:2] for r in ordered]
        mine, theirs = np.array([r.whitened for r in table]), np.array([r[2][c - 1] for r in ordered])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8  # either sign


def test_given_vectors(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(wh.op13_whitening(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("task_bytes", [1, 1 << 20])
def test_slabs_copies_and_odd_rows(spark, write, monkeypatch, task_bytes):
    monkeypatch.setattr(wh, "BLOCK_BYTES", 25 * 8 * 6)
    monkeypatch.setattr(wh, "TASK_BYTES", task_bytes)  # 1: every block is a slab of its own
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]).tolist(), 0) for i in range(60)]
    rows += [(100 + i, rows[7][1], 1) for i in range(40)] + [(7, rows[7][1], 0), (None, rows[8][1], 0), (0, rows[0][1], None)]
    rows += [(200, None, 0), (201, [], 0), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (203, [float("nan")] * 6, 0), (204, [float("inf")] + [0.0] * 5, 0), (205, [0.0] * 6, 0)]
    folder = write(rows, "embeddings", SCHEMA)
    check(wh.op13_whitening(spark, folder).collect(), rows)
    check(wh.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"), components=2).collect(), rows, 2)


def test_directions_without_variance_have_no_component(spark, write):
    rows = [(i, [float(i), 2.0 * i, 7.0, 0.0], 0) for i in range(20)]
    got = wh.op13_whitening(spark, write(rows, "embeddings", SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and abs(got[0].explained - 1) < 1e-9


def test_too_little_to_whiten(spark, write):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    names = [f.split()[0] for f in wh.SCHEMA.split(", ")]
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)] * 3):
        got = wh.whiten(frame(rows))
        assert got.columns == names and got.count() == 0
    with pytest.raises(ValueError, match="entries"):
        wh.whiten(frame([(1, [1.0], 0), (2, [1.0, 2.0], 0)]))


def test_clashing_columns(spark):
    rows = [(i, [float(i), float(i * i)], i, "a") for i in range(8)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, index string"))
    assert got.count() == 16
