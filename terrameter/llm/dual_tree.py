"""Centroid clustering by dual-tree Lloyd rounds, exact on integer vectors.

Vectors are made integers once and written in blocks, each with a cover tree over its vectors: a node
covers its points within a radius, its children cover them within half of that and lie further apart.
Each round builds a cover tree over the centroids as well and walks pairs of nodes, one of either tree,
a level at a time: a pair whose least possible distance exceeds what a node's points are sure to find
elsewhere is dropped; a node left with one centroid is assigned whole; leaf pairs are compared in exact
integers.  Counts and sums of a round are added up by cluster and component, and only these reach the
driver, as do the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, drop, written


@dataclass(frozen=True)
class Plan:
    clusters: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    seed: str = "3"
    block: int = 1024  # vectors in a cover tree
    leaf: int = 16  # vectors of a node that is not split
    bound: int = 1 << 26  # integers are brought to this bound, so that squared distances fit a long
    pairs: int = 1 << 15  # point and centroid pairs compared at once


@dataclass
class CoverTree:
    """Nodes in breadth-first order; a node's points and children are contiguous."""

    order: np.ndarray  # point numbers, so that each node's points are a range
    first: np.ndarray
    last: np.ndarray
    kid_first: np.ndarray
    kid_last: np.ndarray
    centre: np.ndarray  # place in ``order`` of the point in a node's middle
    radius: np.ndarray


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt((d * d).sum(-1))


def cover_tree(x: np.ndarray, leaf: int) -> CoverTree:
    """The cover tree of the rows of ``x`` (at least one); nodes of at most ``leaf`` points, or of equal ones, are leaves."""
    x = x.astype(np.float64)
    order, nodes = np.arange(len(x)), []
    todo: list[tuple[int, int]] = [(0, len(x))]  # ranges of order; a node's middle comes first
    at = 0
    while at < len(todo):
        first, last = todo[at]
        rows = order[first:last]
        d = _distances(x[rows], x[rows[0]])
        radius, kids = float(d.max()), (0, 0)
        if last - first > leaf and radius > 0:
            scale, owner, middles, near = radius / 2, np.zeros(len(rows), np.int64), [0], d
            while near.max() > scale:
                far = int(near.argmax())
                there = _distances(x[rows], x[rows[far]])
                owner[there < near] = len(middles)
                near = np.minimum(near, there)
                middles.append(far)
            lead = np.ones(len(rows), np.int8)
            lead[middles] = 0
            new = np.lexsort((lead, owner))
            order[first:last] = rows[new]
            ends = first + np.cumsum(np.bincount(owner, minlength=len(middles)))
            kids = (len(todo), len(todo) + len(middles))
            todo += zip([first, *ends[:-1].tolist()], ends.tolist(), strict=True)
        nodes.append((first, last, *kids, radius))
        at += 1
    first, last, kid_first, kid_last = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
    return CoverTree(order, first, last, kid_first, kid_last, first, np.array([n[4] for n in nodes]))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of the ranges."""
    n = last - first
    row = np.repeat(np.arange(len(first)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]


def assign(x: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree, pairs: int) -> np.ndarray:
    """Nearest centroid (ties: the smaller number) of the integer vectors ``x``, which are in the tree's order."""
    real, means = x.astype(np.float64), centroids[over.order].astype(np.float64)
    numbers = over.order
    found = np.full(len(x), -1, np.int64)
    bound = np.full(len(tree.first), np.inf)
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    one_vector = tree.radius == 0
    q_leaf, c_leaf = tree.kid_last == tree.kid_first, over.kid_last == over.kid_first
    compare_q, compare_c = [], []
    while len(q):
        d = _distances(real[tree.centre[q]], means[over.centre[c]])
        slack = 1e-9 * (1 + d)
        np.minimum.at(bound, q, d + tree.radius[q] + slack)
        near = d - tree.radius[q] - over.radius[c] - slack <= bound[q]
        q, c = q[near], c[near]
        alone = np.bincount(q, minlength=len(bound)) == 1
        settled = alone[q] & (over.radius[c] == 0)
        for node, at in zip(q[settled].tolist(), c[settled].tolist(), strict=True):
            found[tree.first[node] : tree.last[node]] = numbers[over.first[at] : over.last[at]].min()
        q, c = q[~settled], c[~settled]
        # all pairs of a node go on alike: down the centroids' tree while one of them is the wider, else down its own
        wide = np.zeros(len(bound), bool)
        wide[q[~c_leaf[c] & ((over.radius[c] >= tree.radius[q]) | q_leaf[q])]] = True
        down_c, down_q = wide[q] & ~c_leaf[c], ~wide[q] & ~q_leaf[q]
        ends = ~wide[q] & q_leaf[q]
        compare_q.append(q[ends])
        compare_c.append(c[ends])
        stay = wide[q] & c_leaf[c]
        row, kid = _spread(over.kid_first[c[down_c]], over.kid_last[c[down_c]])
        own_row, own_kid = _spread(tree.kid_first[q[down_q]], tree.kid_last[q[down_q]])
        bound[own_kid] = np.minimum(bound[own_kid], bound[q[down_q]][own_row])
        q, c = np.concatenate([q[stay], q[down_c][row], own_kid]), np.concatenate([c[stay], kid, c[down_q][own_row]])
    q, c = np.concatenate(compare_q), np.concatenate(compare_c)
    # a leaf of equal vectors is compared once; a leaf of the centroids' tree may hold several
    row, point = _spread(tree.first[q], np.where(one_vector[q], tree.first[q] + 1, tree.last[q]))
    member, place = _spread(over.first[c[row]], over.last[c[row]])
    point, number = point[member], numbers[place]
    distance = np.empty(len(point), np.int64)
    for i in range(0, len(point), pairs):
        part = slice(i, i + pairs)
        diff = x[point[part]] - centroids[number[part]]
        distance[part] = (diff * diff).sum(1)
    best = np.lexsort((number, distance, point))
    point, number = point[best], number[best]
    lead = np.ones(len(point), bool)
    lead[1:] = point[1:] != point[:-1]
    found[point[lead]] = number[lead]
    for node in np.unique(q[one_vector[q]]).tolist():
        found[tree.first[node] : tree.last[node]] = found[tree.first[node]]
    return found


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, plan: Plan) -> DataFrame:
    """(id, v): kept vectors as integers floor(scale * x), brought to the bound."""
    v = vectors[vector_col]

    def whole(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * plan.scale), F.lit(plan.bound)), F.lit(-plan.bound)).cast("long")

    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where((F.size(v) == plan.dims) & finite).select(vectors[id_col].cast("long").alias("id"), F.transform(v, whole).alias("v"))


_BLOCK = "ids array<long>, v array<long>, first array<long>, last array<long>, kid_first array<long>, kid_last array<long>, radius array<double>"


def tree_blocks(whole: DataFrame, plan: Plan) -> DataFrame:
    """Blocks of vectors in the order of their cover trees, with the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= plan.block:
                rows = pa.Table.from_batches(kept).combine_chunks()
                yield block(rows.slice(0, plan.block))
                kept = rows.slice(plan.block).to_batches()
        if sum(b.num_rows for b in kept):
            yield block(pa.Table.from_batches(kept).combine_chunks())

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, plan.dims)
        t = cover_tree(x, plan.leaf)
        ids = rows["id"].combine_chunks().take(pa.array(t.order))
        values = [ids, x[t.order].ravel(), t.first, t.last, t.kid_first, t.kid_last, t.radius]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a)) for a in values]
        return pa.record_batch(lists, names=["ids", "v", "first", "last", "kid_first", "kid_last", "radius"])

    return whole.mapInArrow(run, _BLOCK)


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, *arrays = (batch.column(c)[i].values for c in range(7))
            v, first, last, kid_first, kid_last, radius = (a.to_numpy(zero_copy_only=False) for a in arrays)
            x = v.reshape(-1, dims)
            yield ids, x, CoverTree(np.arange(len(x)), first, last, kid_first, kid_last, first, radius)


def _round_sums(blocks: DataFrame, centroids: np.ndarray, plan: Plan) -> list[tuple[int, int, int, int]]:
    """(cluster, component, count, sum) over all blocks: clusters times components, however many vectors."""
    over = cover_tree(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, tree in _trees(batches, plan.dims):
            found = assign(x, tree, centroids, over, plan.pairs)
            by = np.argsort(found, kind="stable")
            own, starts = np.unique(found[by], return_index=True)
            total[own] += np.add.reduceat(x[by], starts)
            n += np.bincount(found, minlength=len(centroids))
        own = np.repeat(np.flatnonzero(n), plan.dims)
        dim = np.tile(np.arange(plan.dims), np.count_nonzero(n))
        yield pa.record_batch([pa.array(own), pa.array(dim), pa.array(n[own]), pa.array(total[own, dim])], names=["cluster", "dim", "n", "total"])

    sums = blocks.mapInArrow(run, "cluster long, dim long, n long, total long").groupBy("cluster", "dim")
    return [tuple(map(int, r)) for r in sums.agg(F.sum(F.col("n").cast("decimal(38,0)")), F.sum(F.col("total").cast("decimal(38,0)"))).collect()]


def _final(blocks: DataFrame, centroids: np.ndarray, plan: Plan) -> DataFrame:
    over = cover_tree(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _trees(batches, plan.dims):
            found = assign(x, tree, centroids, over, plan.pairs)
            diff = x - centroids[found]
            yield pa.record_batch([ids, pa.array(found), pa.array((diff * diff).sum(1))], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(run, "id long, cluster long, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan = Plan()) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of ``dims`` components, none null or non-finite; others have no row.  Integers
    beyond ``bound`` (components beyond 65,536 in the default plan) are brought to it.  The first
    centroids are the vectors with the smallest hashes of their ids; a null id is hashed as an empty
    one, and rows with one id come in the order of their integers.  With fewer vectors than clusters
    there are as many clusters as vectors; repeated rows count as often as they come; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = integer_vectors(vectors, id_col, vector_col, plan)
    blocks = written(tree_blocks(whole, plan))
    order = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = whole.select(order.alias("h"), "v").orderBy("h", "v").limit(plan.clusters).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, plan.dims)
    for _ in range(plan.rounds if len(centroids) else 0):
        after = centroids.copy()
        for own, dim, n, total in _round_sums(blocks, centroids, plan):
            after[own, dim] = total // n
        centroids = after
    if not len(centroids):
        drop(blocks)
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = written(_final(blocks, centroids, plan))
    drop(blocks)
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by = spark.createDataFrame([(c, d, sum(inertia.values()), digests[c]) for c, d in sorted(inertia.items())], "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(plan: Plan = Plan()) -> str:
    """The same rounds in another engine's SQL: every vector against every centroid."""
    kept = f"len(embedding) = {plan.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {plan.dims}"
    parts = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: least(greatest(floor({plan.scale} * x::DOUBLE), -{plan.bound}), {plan.bound})::BIGINT) AS v FROM embeddings WHERE {kept}),
flat AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({plan.dims})) AS dim FROM kept),
start AS (SELECT row_number() OVER (ORDER BY sha256('{plan.seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept),
m0 AS MATERIALIZED (SELECT c, unnest(v) AS x, unnest(range({plan.dims})) AS dim FROM start WHERE c < {plan.clusters})"""]
    for i in range(plan.rounds + 1):
        parts.append(f"""
n{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((flat.x - m.x) * (flat.x - m.x))::BIGINT AS d FROM flat JOIN m{i} AS m USING (dim) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < plan.rounds:
            parts.append(f"""
s{i} AS (SELECT c, dim, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN n{i} USING (r) GROUP BY c, dim),
m{i + 1} AS MATERIALIZED (SELECT c, dim, coalesce((s - ((s % n) + n) % n) // n, m.x) AS x FROM m{i} AS m LEFT JOIN s{i} USING (c, dim))""")
    last = plan.rounds
    return ",".join(parts) + f""",
digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS h FROM m{last} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM n{last} JOIN kept USING (r) JOIN digest USING (c)
"""


SQL = _sql()
