"""Near-duplicate embeddings by NN-descent.

Equal vectors are one node with a weight. Leaves of random-projection trees start each node's
list of nearest neighbours; then neighbours of neighbours are compared, round by round, as a
neighbour of a neighbour is likely a neighbour. Edges at or above the threshold, checked in
double precision, are the links. A node whose whole list is links is saturated: its list is
enlarged to all of its component, compared in blocks, so dense groups are counted exactly and
their pairs never listed. Recall is audited by comparing a hashed share of the nodes with all
vectors; while it is too low for the mean query or for queries of any group size, lists are
doubled and the descent goes on. Where that does not help, all pairs are compared in blocks.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import components, materialise

THRESHOLD = 0.95
#: Length of neighbour lists at first; trees; nodes of a leaf that are compared in one task.
NEIGHBOURS, TREES, LEAF = 8, 6, 128
#: Rounds of descent end early once under this share of the list entries is new.
MAX_ROUNDS, SETTLED = 5, 0.01
#: The audit's queries: one node in AUDITED_ONE_IN, more of a small table to have AUDITED; compared in blocks.
AUDITED, AUDITED_ONE_IN, AUDIT_BLOCK = 1000, 20, 4096
#: The recall the audit asks for, and how often lists may be doubled for it.
TARGET_RECALL, MAX_DOUBLINGS = 0.97, 3
#: Nodes of a component compared with each other in one task; reverse lists are sampled in salts.
BLOCK, SALTS = 1024, 16
SEED = 7
#: Slack of the single-precision search; what it lets through is checked in double precision.
_SLACK = 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(embedding, least, weight, dim, unit): one row per distinct usable vector, with its smallest vec_id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    usable = vectors.select("vec_id", "embedding", norm.alias("norm")).where(finite & (norm > 0))
    # the norm passes through the grouping, so that it is not worked out again for each component
    grouped = usable.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.max("norm").alias("norm"))
    return grouped.select("embedding", "least", "weight", F.size("embedding").alias("dim"), F.transform(v, lambda x: x / F.col("norm")).alias("unit"))


def _best(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest similarities of each src."""
    order = np.lexsort((dst, -sim, src))
    first = np.flatnonzero(np.append(True, src[order][1:] != src[order][:-1])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float32())})


_EDGE = "src long, dst long, sim float"


def _leaf_keys(dim: int, bits: int):
    planes = np.random.default_rng(SEED).standard_normal((dim, max(1, TREES * bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            side = (x @ planes > 0).astype(np.int64).reshape(len(x), -1)
            for t in range(TREES):
                keys = side[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), pa.array(np.full(len(x), t, np.int32)), pa.array(keys)],
                    names=["id", "unit", "tree", "leaf"],
                )

    return run


def first_lists(nodes: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """Nearest neighbours within the leaves of each tree; a large leaf is cut into parts by hash."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    leaves = nodes.select("id", "unit").mapInArrow(_leaf_keys(dim, bits), "id long, unit array<float>, tree int, leaf long")
    sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("in_leaf"))
    parts = F.ceil(F.col("in_leaf") / (2 * LEAF))
    cut = leaves.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), parts))

    def compare(leaf: pa.Table) -> pa.Table:
        ids, x = leaf["id"].to_numpy(), _matrix(leaf["unit"], dim)
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        near = np.argsort(-sims, axis=1)[:, :k]
        src = np.repeat(np.arange(len(ids)), near.shape[1])
        keep = src != near.ravel()
        return _edges(ids[src[keep]], ids[near.ravel()[keep]], sims[src[keep], near.ravel()[keep]])

    return cut.select("tree", "leaf", "part", "id", "unit").groupBy("tree", "leaf", "part").applyInArrow(compare, _EDGE)


def _cut_to(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list; an edge found twice is new only if it was never there before."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("is_new").alias("is_new"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _descend(lists: DataFrame, nodes: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """Candidates from comparing the neighbours, forward and reverse, of each node."""
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(SALTS)))
    order = F.xxhash64("src", "dst")
    for keys in (("dst", "salt"), ("dst",)):  # a hub's many reverse edges never meet in one task
        salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_new"), order))).where(F.col("r") <= k)
    reverse = salted.select(F.col("dst").alias("at"), F.col("src").alias("id"), "is_new")
    around = lists.select(F.col("src").alias("at"), F.col("dst").alias("id"), "is_new").unionByName(reverse)
    around = around.groupBy("at", "id").agg(F.min("is_new").alias("is_new"))
    # the similarity that a candidate must beat to enter a list
    worst = lists.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    carried = nodes.select("id", F.transform("unit", lambda x: x.cast("float")).alias("unit")).join(worst, F.col("id") == F.col("src"), "left")
    carried = carried.select("id", "unit", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    blocks = max(1, n // 1000)
    ready = around.join(carried, "id").withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        at, ids, new = block["at"].to_numpy(), block["id"].to_numpy(), block["is_new"].to_numpy().astype(bool)
        x, worst = _matrix(block["unit"], dim), block["worst"].to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True):
            if e - s < 2 or not new[s:e].any():
                continue
            sims = x[s:e] @ x[s:e].T
            # row enters column's list and the other way round: both orders are looked at
            good = (sims > worst[s:e, None]) & (new[s:e, None] | new[None, s:e])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            found.append((ids[s + i], ids[s + j], sims[i, j]))
        if not found:
            return _edges(*(np.zeros(0),) * 3)
        src, dst, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        _, once = np.unique(np.stack([src, dst]), axis=1, return_index=True)
        src, dst, sim = src[once], dst[once], sim[once]
        keep = _best(src, dst, sim, k)
        return _edges(src[keep], dst[keep], sim[keep])

    return ready.select("block", "at", "id", "is_new", "unit", "worst").groupBy("block").applyInArrow(compare, _EDGE)


def _settle(lists: DataFrame, nodes: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    for _ in range(MAX_ROUNDS):
        found = _descend(lists, nodes, n, dim, k).withColumn("is_new", F.lit(1))
        lists = _cut_to(lists.withColumn("is_new", F.lit(0)).unionByName(found), k).checkpoint()
        if (lists.agg(F.sum("is_new")).first()[0] or 0) < SETTLED * k * n:
            break
    return lists


def exact_links(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of the list entries that reach the threshold in double precision."""
    likely = lists.where(F.col("sim") >= threshold - _SLACK)
    pairs = likely.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    left, right = (nodes.select(F.col("id").alias(c), F.col("unit").alias(f"{c}_unit")) for c in "ab")
    cosine = F.aggregate(F.zip_with("a_unit", "b_unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(left, "a").join(right, "b").where(cosine >= threshold).select("a", "b")


def _forest(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Places of links that join the same nodes as all of them do, at most one less than the nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(src.tolist(), dst.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
            kept.append(k)
    return np.array(kept, int)


def _whole_components(members: DataFrame, dim: int, threshold: float, joining: bool = False) -> DataFrame:
    """(id, links) over all pairs of each component, in blocks of nodes; if ``joining``, also rows
    (id, links, other) with no links, each a link, that join what is linked.

    Members (id, weight, unit, root): a component of m nodes makes m * m / BLOCK rows, and each
    pair of blocks adds one row per node, never one per pair.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.join(sizes, "root").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = placed.withColumn("other", other).select(
        "root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("is_i"), "id", "weight", "unit"
    )

    def count(pair: pa.Table) -> pa.Table:
        ids, weight, is_i = pair["id"].to_numpy(), pair["weight"].to_numpy(), pair["is_i"].to_numpy(zero_copy_only=False)
        x = _matrix(pair["unit"], dim)
        same = pair["i"][0].as_py() == pair["j"][0].as_py()
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(is_i), np.flatnonzero(~is_i))
        links = np.zeros(len(ids), np.int64)
        ends: list[np.ndarray] = []
        for s in range(0, len(a), BLOCK):
            rows = a[s : s + BLOCK]
            near = x[rows] @ x[b].T >= threshold
            if same:
                near[np.arange(len(rows)), s + np.arange(len(rows))] = False
            links[rows] += near @ weight[b]
            if not same:
                links[b] += weight[rows] @ near
            if joining:
                i, j = np.nonzero(near)
                keep = _forest(rows[i], b[j])
                ends.append(np.stack([ids[rows[i[keep]]], ids[b[j[keep]]]]))
        if not joining:
            return pa.table({"id": ids, "links": links})
        pairs = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        other = pa.array(np.append(np.zeros(len(ids), np.int64), pairs[1]), mask=np.arange(len(ids) + pairs.shape[1]) < len(ids))
        return pa.table({"id": np.append(ids, pairs[0]), "links": np.append(links, np.zeros(pairs.shape[1], np.int64)), "other": other})

    if joining:
        return dealt.groupBy("root", "i", "j").applyInArrow(count, "id long, links long, other long")
    counted = dealt.groupBy("root", "i", "j").applyInArrow(count, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _all_pairs(nodes: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, root) and (id, links) of the linked nodes, exact: n * n / BLOCK rows are dealt."""
    members = nodes.select("id", "weight", "unit", F.lit(0).cast("long").alias("root"))
    found = materialise(_whole_components(members, dim, threshold, joining=True), "all-pairs")
    roots = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    return roots, found.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")


def audit(nodes: DataFrame, counted: DataFrame, n: int, dim: int, threshold: float) -> float:
    """Recall of links: a hashed share of the nodes is compared with all nodes. Each linked query
    counts once, by the share of its links that was found; the least mean is given, over all queries
    and over the queries of each size of group (powers of two)."""
    queries = nodes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, min(AUDITED_ONE_IN, n // AUDITED)))) == 0).select("id", "unit")
    parts = -(-n // (AUDITED_ONE_IN * AUDIT_BLOCK))
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(parts))
    true: DataFrame | None = None
    for p in range(parts):
        block = queries.where(part == p).toArrow()
        if not len(block):
            continue
        shared = nodes.sparkSession.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["unit"], dim)))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            total = np.zeros(len(ids), np.int64)
            for batch in batches:
                for s in range(0, len(batch), 4096):
                    some = batch.slice(s, 4096)
                    near = q @ _matrix(some.column(2), dim).T >= threshold
                    near &= ids[:, None] != some.column(0).to_numpy()[None]
                    total += near @ some.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "true_links"])

        own = nodes.select("id", "weight", "unit").mapInArrow(compare, "id long, true_links long").groupBy("id").agg(F.sum("true_links").alias("true_links"))
        own = materialise(own.where("true_links > 0"), "audited")
        shared.destroy()
        true = own if true is None else true.unionByName(own)
    if true is None:
        return 1.0
    share = F.least("true_links", F.coalesce("links", F.lit(0))) / F.col("true_links")
    means = true.join(counted, "id", "left").groupBy(F.floor(F.log2("true_links")).alias("size")).agg(F.avg(share).alias("mean"), F.count("*").alias("n")).collect()
    if not means:
        return 1.0
    return min(*(r["mean"] for r in means), sum(r["mean"] * r["n"] for r in means) / sum(r["n"] for r in means))


def _count_links(lists: DataFrame, nodes: DataFrame, dim: int, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, root) of linked nodes, and (id, links): weights of the other nodes each is linked to."""
    links = exact_links(lists, nodes, threshold).checkpoint()
    roots = components(links).withColumnRenamed("node", "id")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    full = both.groupBy("a").agg(F.count("*").alias("own")).where(F.col("own") >= k).select(F.col("a").alias("id"))
    dense = roots.join(full, "id").select("root").distinct().withColumn("dense", F.lit(True))
    placed = roots.join(dense, "root", "left").select("id", "root", F.coalesce("dense", F.lit(False)).alias("dense")).checkpoint()
    members = placed.where("dense").join(nodes, "id").select("id", "weight", "unit", "root")
    weights = nodes.select(F.col("id").alias("b"), "weight")
    sparse = both.join(placed.where("NOT dense").select(F.col("id").alias("a")), "a").join(weights, "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("links"))
    counted = sparse.unionByName(_whole_components(members, dim, threshold)).checkpoint()
    return placed.select("id", "root"), counted


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths with each other. Rows that repeat a vec_id, or have none,
    count like any others; a null vec_id names no component. Extra columns are ignored.
    """
    # the id is drawn before the table is written, so it is the same for every later reader
    nodes = materialise(nodes_of(vectors).withColumn("id", F.monotonically_increasing_id()), "nodes")
    linked: DataFrame | None = None
    for dim, n in ((r["dim"], r["n"]) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own, k = nodes.where(F.col("dim") == dim), NEIGHBOURS
        lists = _cut_to(first_lists(own, n, dim, k).withColumn("is_new", F.lit(1)), k).checkpoint()
        for doublings in range(MAX_DOUBLINGS + 1):
            lists = _settle(lists, own, n, dim, k)
            roots, counted = _count_links(lists, own, dim, k, threshold)
            if audit(own, counted, n, dim, threshold) >= TARGET_RECALL:
                break
            if doublings == MAX_DOUBLINGS:
                roots, counted = _all_pairs(own, dim, threshold)
                break
            k *= 2
            lists = lists.withColumn("is_new", F.lit(1))
        part = counted.join(roots, "id")
        linked = part if linked is None else linked.unionByName(part)
    rows = vectors.select("vec_id", "embedding")
    if linked is None:  # no usable vector at all
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = nodes.select("embedding", "id", "least", "weight").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(names, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    # rows find their node by the vector itself: copies share it
    component = F.coalesce("component_id", "vec_id")
    return rows.join(found, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, for tables of the size that the comparison with SQL uses.
OP10_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id)
SELECT v.vec_id, COALESCE(c.n, 0) AS n_links, LEAST(v.vec_id, COALESCE(m.other, v.vec_id)) AS component_id,
  v.vec_id = LEAST(v.vec_id, COALESCE(m.other, v.vec_id)) AS kept
FROM v LEFT JOIN counts c ON c.vec_id = v.vec_id LEFT JOIN least m ON m.vec_id = v.vec_id"""
