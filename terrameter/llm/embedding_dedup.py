"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are one class first, so copies cost nothing.  Each tree splits the classes again and
again along a random direction at the median; classes within a quantile band around it go to both
sides (spill overlap).  The trees are fitted on a bounded sample and deal the classes to groups,
which are compared in full; groups that are too large for one task are split again, at quantiles of
all their vectors, one level a round.  At every split the distance of two vectors at the threshold, along the
direction, tells how likely a vector keeps such a partner; a vector goes to further trees, fitted on
the vectors still in want of them, until it is unlikely to have missed one.  Where too many trees
would be needed, the vectors left over are compared with each other in full.  Links are verified in
double precision and united.  The links of each vector are then counted exactly inside its component,
in square tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import bounded_batches, drop, written


@dataclass(frozen=True)
class Limits:
    trees: int = 6  # for every vector, at least
    most_trees: int = 48  # vectors that want more are compared with each other in full
    miss: float = 0.002  # chance to lose a partner at the threshold below which a vector needs no more trees
    leaf: int = 192  # rows of a block in which a group's vectors are compared
    spill: float = 0.05  # share of a node's vectors on each side of the median that go to both sides
    group: int = 2048  # vectors that a group should have
    fit_rows: int = 16_384  # vectors that the trees are fitted on
    top_depth: int = 12  # levels fitted on the sample; the groups of larger tables are split further
    forest_bytes: int = 256 << 20  # of the directions that are sent to every task: long vectors get fewer fitted levels
    tile: int = 1024

    def for_length(self, dim: int) -> Limits:
        """These limits with as many fitted levels as the forest's bytes allow for vectors of ``dim`` components."""
        fit = int(math.log2(max(2, self.forest_bytes // (4 * max(1, dim) * self.most_trees))))
        return replace(self, top_depth=min(self.top_depth, fit))


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _split(x: np.ndarray, rng: np.random.Generator, spill: float) -> tuple[np.ndarray, float, float, float]:
    """A random direction with the median and the quantiles that bound the overlap."""
    direction = rng.standard_normal(x.shape[1])
    low, mid, high = np.quantile(x @ direction, [0.5 - spill, 0.5, 0.5 + spill])
    return direction, low, mid, high


def fit_tree(sample: np.ndarray, depth: int, limits: Limits, rng: np.random.Generator) -> list[tuple]:
    """One tree as nodes in heap order: (direction, low, high)."""
    nodes: list[tuple | None] = [None] * (2**depth - 1)
    todo = [(0, np.arange(len(sample)))]
    while todo:
        i, rows = todo.pop()
        if i >= len(nodes):
            continue
        if len(rows) > 1:
            direction, low, mid, high = _split(sample[rows], rng, limits.spill)
            p = sample[rows] @ direction
            left, right = rows[p <= mid], rows[p > mid]
        else:
            direction, low, high, left, right = rng.standard_normal(sample.shape[1]), 0.0, 0.0, rows, rows
        nodes[i] = direction.astype(np.float32), float(low), float(high)
        todo += [(2 * i + 1, left), (2 * i + 2, right)]
    return nodes


def _levels(n: float, limits: Limits) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / limits.group)))


def _depth(n: float, limits: Limits) -> int:
    return min(limits.top_depth, _levels(n, limits))


def _kept(x: np.ndarray, nodes: list[tuple], reach: float) -> np.ndarray:
    """Chance of each row to meet a partner at distance ``reach`` in a tree's groups."""
    kept = np.zeros(len(x))
    for _, rows, chance in _route(x, nodes, reach):
        kept[rows] += chance
    return kept


def fit_forest(sample: np.ndarray, n: int, threshold: float, limits: Limits, seed: int) -> tuple[list[tuple[list[tuple], float]], int]:
    """Trees for ``n`` vectors like ``sample``, and the blocks of those left over (0 if none are).

    Beside each tree stands the factor by which its further levels, split on the cluster, lessen the
    chances: for each level that of the last fitted one.  Trees after the first few are fitted on the
    vectors that may still miss a partner.  They end when there are none, or when comparing these with
    each other takes fewer copies than more trees.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    miss = np.ones(len(sample))
    trees: list[tuple[list[tuple], float]] = []
    while True:
        want = np.flatnonzero(miss > limits.miss) if len(trees) >= limits.trees else np.arange(len(sample))
        left = n * len(want) / max(1, len(sample))
        if trees and (not len(want) or not trees[0][0]):
            return trees, 0
        depth, levels = _depth(left, limits), _levels(left, limits)
        nodes = fit_tree(sample[want], depth, limits, np.random.default_rng([seed, len(trees)]))
        kept, fade = _kept(sample[want], nodes, reach), 1.0
        if levels > depth and depth and len(want):
            fade = min(1.0, kept.mean() / _kept(sample[want], nodes[: 2 ** (depth - 1) - 1], reach).mean()) ** (levels - depth)
            kept *= fade
        if len(trees) >= limits.trees:
            more = np.log(limits.miss / miss[want]) / np.log1p(-np.clip(kept, 1e-9, 1 - 1e-9))
            blocks = math.ceil(left / max(1, limits.group // 2))
            if len(trees) >= limits.most_trees or blocks <= more.mean() * (1 + 2 * limits.spill) ** levels:
                return trees, blocks
        trees.append((nodes, fade))
        miss[want] *= 1 - np.minimum(kept, 1)


_AT = np.linspace(-6, 6, 2401)
_BELOW = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _AT])


def _route(x: np.ndarray, nodes: list[tuple], reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, rows, chance) of one tree; rows in a band appear on both sides.

    The chances of a row add up to that of a vector at distance ``reach`` meeting it in one of its
    groups: along a normal direction the two lie a normal deviate of that size apart.
    """
    todo = [(0, np.arange(len(x)), np.ones(len(x)))]
    while todo:
        i, rows, chance = todo.pop()
        if not len(rows):
            continue
        if i >= len(nodes):
            yield i - len(nodes), rows, chance
            continue
        direction, low, high = nodes[i]
        p = x[rows] @ direction
        left, right = p <= high, p > low
        # a row in the band shares its chance out at the middle, one outside keeps partners up to the band's far end
        cut = np.where(left & right, (low + high) / 2, np.where(left, high, low))
        below = np.interp((cut - p) / max(reach, 1e-12), _AT, _BELOW)
        todo += [(2 * i + 1, rows[left], (chance * below)[left]), (2 * i + 2, rows[right], (chance * (1 - below))[right])]


def _blocks(x: np.ndarray, threshold: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, near) of every two blocks of ``size`` rows that hold a link, in double precision."""
    small = x.astype(np.float32)
    for i in range(0, len(x), size):
        for j in range(i, len(x), size):
            # single precision is off by far less than the margin; a block without a candidate ends here
            some = small[i : i + size] @ small[j : j + size].T >= threshold - 1e-4
            if i == j:
                np.fill_diagonal(some, False)
            if not some.any():
                continue
            rows = np.unique(np.concatenate((i + np.flatnonzero(some.any(1)), j + np.flatnonzero(some.any(0)))))
            near = x[rows] @ x[rows].T >= threshold
            np.fill_diagonal(near, False)
            yield rows, near


def _stars(near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each row of a leaf to the smallest row it reaches inside the leaf."""
    label = np.arange(len(ids))
    while True:
        least = np.where(near, label[None, :], len(ids)).min(1)
        least = np.minimum(label, least)
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def marked_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, ok, h1, h2, vec): whether the vector can link, and two hashes that name equal vectors."""
    kind = rows.schema[vector_col].dataType.simpleString()
    vec = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    out = rows.select(F.col(id_col).alias("id"), F.coalesce(finite, F.lit(False)).alias("ok"), vec.alias("vec"))
    return out.select("id", "ok", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), F.when(F.col("ok"), F.col("vec")).alias("vec"))


def forest_links(classes: DataFrame, threshold: float, limits: Limits = Limits(), seed: int = 7) -> DataFrame:
    """(a, b): verified links between classes (cid, h1, h2, vec) that keep what the forest found together.

    Vectors of different lengths are in different dimensions and are not compared; each length that
    occurs is dealt by itself, one after the other.
    """
    spark = classes.sparkSession
    dims = classes.groupBy(F.size("vec").alias("d")).count().collect()
    none = spark.createDataFrame([], "a long, b long")
    for dim, own in dims:
        none = none.union(_links_of(classes.where(F.size("vec") == dim), own, dim, threshold, limits.for_length(dim), seed))
    return none


def _links_of(classes: DataFrame, n: int, dim: int, threshold: float, limits: Limits, seed: int) -> DataFrame:
    share = min(1.0, limits.fit_rows / max(1, n))
    roll = F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(1 << 30))
    sample = classes.where(roll < int(share * (1 << 30)) + 1).select("h1", "h2", "vec").limit(limits.fit_rows + limits.fit_rows // 8).toPandas()
    x = unit(sample.sort_values(["h1", "h2"])["vec"].tolist()) if len(sample) else np.zeros((0, dim))
    trees, blocks = fit_forest(x, n, threshold, limits, seed)
    shared = classes.sparkSession.sparkContext.broadcast(trees)  # most_trees x 2^top_depth nodes at most
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = unit(raw)
            cids = b.column(0).to_numpy(zero_copy_only=False)

            def batch(group: int, at: np.ndarray) -> pa.RecordBatch:
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * dim + 1, dim), pa.int32()), pa.array(raw[at].ravel()))
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group, np.int64)), pa.array(cids[at]), vecs], ["grp", "cid", "vec"])

            miss = np.ones(len(x))
            for t, (nodes, fade) in enumerate(shared.value):
                want = np.flatnonzero(miss > limits.miss) if t >= limits.trees else np.arange(len(x))
                kept = np.zeros(len(want))
                for group, at, chance in _route(x[want], nodes, reach):
                    kept[at] += chance * fade
                    yield batch(t << 20 | group, want[at])
                miss[want] *= 1 - np.minimum(kept, 1)
            over = np.flatnonzero(miss > limits.miss) if blocks else np.zeros(0, np.int64)
            block = cids[over] % max(1, blocks)
            for mine in np.unique(block):
                for other in range(blocks):
                    if other != mine or blocks == 1:  # every pair of blocks meets, and with it each block itself
                        i, j = sorted((int(mine), other))
                        yield batch(-1 - (i * blocks + j), over[block == mine])

    def compare(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("cid")
        x = unit(np.stack(table["vec"].to_numpy()))
        ids = table["cid"].to_numpy()
        found = [_stars(near, ids[rows]) for rows, near in _blocks(x, threshold, limits.leaf)]
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    kind = classes.schema["vec"].dataType.simpleString()
    dealt = classes.select("cid", "vec").mapInArrow(deal, f"grp long, cid long, vec {kind}")
    extra = _levels(n, limits) - limits.top_depth
    if extra <= 0:
        return dealt.groupBy("grp").applyInPandas(compare, "a long, b long")
    small, large = split_large(written(dealt), dim, extra, limits, seed)
    found = small.groupBy("grp").applyInPandas(compare, "a long, b long")
    if large is not None:
        found = found.unionByName(_block_pairs(large, limits).groupBy("grp", "i", "j").applyInPandas(compare, "a long, b long"))
    return found


def split_large(dealt: DataFrame, dim: int, extra: int, limits: Limits, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """``dealt`` (grp, cid, vec) in groups of at most four times the wanted size, and what could not be split.

    Each round splits every larger group along a random direction of its own at quantiles of all its
    vectors, with the same overlap.  Only groups and their quantiles are aggregated; vectors never
    meet in one task.  The second frame (with n, the size) holds groups that rounds did not make small,
    as in vectors that all lie at one place of every direction.
    """
    most = 4 * limits.group
    kind = dealt.schema["vec"].dataType.simpleString()
    done: DataFrame | None = None

    def with_sizes(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
        return rows.join(sizes, "grp")

    for at in range(2 * extra + 8):
        sized = written(with_sizes(dealt))
        small = sized.where(F.col("n") <= most).select("grp", "cid", "vec")
        done = small if done is None else done.unionByName(small)
        large = sized.where(F.col("n") > most)
        if large.isEmpty():
            return done, None

        def project(batches: Iterator[pa.RecordBatch], at: int = at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                groups, of = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                ways = np.stack([np.random.default_rng([seed, at, int(g) & (1 << 63) - 1]).standard_normal(dim) for g in groups])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x * ways[of]).sum(1))], ["grp", "cid", "vec", "p"])

        placed = large.select("grp", "cid", "vec").mapInArrow(project, f"grp long, cid long, vec {kind}, p double")
        cuts = placed.groupBy("grp").agg(F.percentile_approx("p", [0.5 - limits.spill, 0.5 + limits.spill], 1000).alias("cut"))
        sides = F.filter(F.array(F.when(F.col("p") <= F.col("cut")[1], 0), F.when(F.col("p") > F.col("cut")[0], 1)), lambda s: s.isNotNull())
        halves = placed.join(cuts, "grp").withColumn("side", F.explode(sides))
        dealt = halves.select(F.xxhash64("grp", F.lit(at), "side").alias("grp"), "cid", "vec")
    sized = written(with_sizes(dealt))
    return done.unionByName(sized.where(F.col("n") <= most).select("grp", "cid", "vec")), sized.where(F.col("n") > most)


def _block_pairs(large: DataFrame, limits: Limits) -> DataFrame:
    """Rows of large groups (grp, cid, vec, n) once for each pair of blocks i <= j in which they meet others."""
    blocks = F.ceil(F.col("n") / limits.group)
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long")
    rows = large.withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "vec")


def count_links(members: DataFrame, threshold: float, limits: Limits = Limits(), n: int = 0) -> DataFrame:
    """(cid, links) with the vectors of linked classes weighed by their copies, exact in each component.

    members: cid, component, copies, vec; n: a bound on their number.  A component larger than a tile is cut into blocks; every
    pair of blocks meets in one task, so no task holds more than two tiles.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    sized = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / limits.tile))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tiles = sized.withColumn("block", own).withColumn("other", F.explode(every))
    tiles = tiles.select("cid", "component", "copies", "vec", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks")
    # small components share a task; a block pair of a large one has its own key
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(max(4096, n // limits.group)))).otherwise(F.xxhash64("component", "i", "j"))

    def count(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in table.groupby(["component", "i", "j"], sort=False):
            x = unit(part["vec"].tolist())
            copies = part["copies"].to_numpy(np.int64)
            block = part["block"].to_numpy()
            mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = x[mine] @ x[other].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            links = np.zeros(len(part), np.int64)
            links[mine] += near @ copies[other]
            if i != j:
                links[other] += near.T @ copies[mine]
            out.append(pd.DataFrame({"cid": part["cid"].to_numpy(), "links": links}))
        return pd.concat(out)

    counted = tiles.withColumn("key", key).groupBy("key").applyInPandas(count, "cid long, links long")
    return counted.groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", limits: Limits = Limits()) -> DataFrame:
    """id_col, n_links, component_id and kept of every row of ``rows``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Equal
    vectors are linked.  Repeated ids are separate vectors.  Other columns are ignored; an empty table
    gives an empty result.
    """
    bounded_batches(rows.sparkSession)
    named = written(marked_vectors(rows, id_col, vector_col))
    classes = named.where("ok").groupBy("h1", "h2", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))  # unique, and fixed once written
    n = classes.count()
    links = written(forest_links(classes, threshold, limits))
    parts = connected_components(links, "a", "b")
    drop(links)
    linked = classes.join(parts, classes.cid == parts.node).select("cid", "component", "copies", "vec", "least")
    linked = written(linked)
    counted = count_links(linked, threshold, limits, n)
    roots = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    known = linked.join(roots, "component").join(counted, "cid").select("cid", "component_id", "links")
    links_of = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    info = classes.join(known, "cid", "left").select("h1", "h2", links_of.alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    good = named.where("ok").select("id", "h1", "h2").join(info, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = named.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


# every pair of vectors and everything that links reach: for tables of thousands of vectors
SQL = """
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT *, len(e) AS n FROM v WHERE len([x FOR x IN e IF isfinite(x)]) = len(e) AND len([x FOR x IN e IF x <> 0]) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.n = b.n AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
part AS (SELECT a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a AS r, count(*) AS links FROM link GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN part USING (r) LEFT JOIN n USING (r)
"""
