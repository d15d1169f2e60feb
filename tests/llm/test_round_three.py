"""Exact dedup by tries, importance resampling and dual-tree clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrameter.llm import dual_tree, exact_dedup, importance
from terrameter.llm.queries import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_groups(rows, largest):
    """Sorted (id, keep_id, size, kept, hash) where ``rows`` are (id, text) in the order they are read."""
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault((text or "").translate(LOWER), []).append((doc, i))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (m[0] is None, -m[0] if largest and m[0] is not None else m[0] or 0, m[1]))
        out += [(doc, keep[0], len(members), i == keep[1], hashlib.sha256(text.encode()).hexdigest()) for doc, i in members]
    return sorted(map(repr, out))


def op11(docs, **kw):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.exact_duplicates(docs, **kw).collect())


def test_op11_against_plain(spark, odd_docs, no_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    both = docs.union(odd_docs.select("doc_id", "text")).coalesce(3)
    for keep in ("smallest", "largest"):
        assert op11(both, keep=keep) == plain_groups(rows, keep == "largest")
    assert op11(odd_docs.repartition(5), keep="largest") == plain_groups([(r.doc_id, r.text) for r in odd_docs.collect()], True)
    assert op11(no_docs) == []


def test_op11_spills_subtrees(spark):
    """Tries with room for a few texts: long shared prefixes, one text far beyond the budget, a hot text, texts that are prefixes."""
    texts = [("p" * 3000 + str(i % 40)) for i in range(120)] + ["z" * 50_000, "Z" * 50_000, "z" * 49_999] + ["hot"] * 60 + ["ab" * i for i in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    want = plain_groups(list(enumerate(texts)), True)
    small = exact_dedup.Limits(trie_bytes=9000, part_bytes=1 << 40, emit_bytes=4000)
    assert op11(docs, keep="largest", limits=small) == want
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert op11(docs.coalesce(1), keep="largest", limits=small) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.sampled_from([b"aaaa", b"aaaab", b"aab", b"", b"a"]), max_size=40), st.integers(0, 40))
def test_op11_trie(texts, cut_at):
    trie, found = exact_dedup.Trie(), {}
    for i, text in enumerate(texts):
        node = trie.find(text)
        if i == cut_at and trie.ends > 1:
            top, path = trie.heaviest(900)
            spilled = {whole for end, whole in trie.walk(top, path) if end.number >= 0}
            assert spilled and len(spilled) < trie.ends and all(t in found for t in spilled)
            trie.cut(top)
            for t in spilled:
                assert trie.find(t).gone
                del found[t]
            node = trie.find(text)
        if node.gone:
            continue
        if node.number < 0:
            node.number, trie.ends = i, trie.ends + 1
            found[text] = i
        assert node.number == found[text]
    assert {whole: end.number for end, whole in trie.walk(trie.root, b"") if end.number >= 0} == found and trie.ends == len(found)


def plain_resample(rows, targets, n_max=1, percent=10, least=20):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]

    per = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in per for b in f), Counter(b for x in targets for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in s}
    out = []
    for (doc, _), (words, f) in zip(rows, per, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(rows) // 100], 1):
        r[4] = rank
    return sorted(repr(tuple(r[:5])) for r in out)


def op12(docs, targets, **kw):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in importance.resample(docs, targets, **kw).collect())


def test_op12_against_plain(spark, odd_docs, no_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    targets = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = [r.text for r in targets.collect()] + [None]
    targets = targets.select("text").union(spark.createDataFrame([(None,)], "text string"))
    rows = [tuple(r) for r in docs.collect()] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    both = docs.union(odd_docs.select("doc_id", "text"))
    assert op12(both, targets) == plain_resample(rows, wanted)
    assert op12(both.repartition(5), targets, plan=importance.Plan(ngrams=3, block_cells=300, remembered=50, percent=50)) == plain_resample(rows, wanted, 3, 50)
    assert op12(odd_docs, targets.limit(0)) == plain_resample([(r.doc_id, r.text) for r in odd_docs.collect()], [])
    assert op12(no_docs, targets) == []


def test_op12_ranks_equal_rows(spark):
    """A third of all rows with one id and text: ranks stay 1, 2, 3... and no range takes all of them."""
    text = F.repeat(F.lit("same words in all of these "), 6)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), text.alias("text"))
    got = importance.resample(docs, docs.limit(5), plan=importance.Plan(percent=100)).toPandas()
    assert sorted(got["rank"]) == list(range(1, 3001)) and got.weight.nunique() == 1
    by_rank = got.sort_values("rank").score.tolist()
    assert by_rank == sorted(by_rank, reverse=True)
    same = docs.select("doc_id").withColumn("score", F.lit(1))
    placed = importance.ranked(same.where("doc_id is null"), [F.col("score").desc()], 8)
    assert sorted(r.place for r in placed.collect()) == list(range(1, 1001))


def test_op12_query_draws_from_documents_with_enough_words(spark, tmp_path):
    """37 long and 63 short documents: a tenth of the long ones is drawn, not of all."""
    text = F.when(F.col("id") < 37, F.concat_ws(" ", F.repeat(F.lit("some words "), 12), "id")).otherwise("short")
    spark.range(100).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries()["op12_importance_resampling"](spark, str(tmp_path)).where("rank is not null").collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3] and all(r.doc_id < 37 for r in rows)


def test_op12_csr_blocks_hold_the_matrix(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "B ünï b9"), (4, "- - -")], "doc_id long, text string").coalesce(1)
    blocks = importance.csr_blocks(docs, "doc_id", "text", importance.Plan()).collect()
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    cells = {(b.ids[i], b.cols[j]): b.counts[j] for b in blocks for i in range(len(b.ids)) for j in range(b.starts[i], b.starts[i + 1])}
    assert cells == {(1, bucket("a")): 2, (1, bucket("b")): 1, (3, bucket("b")): 1, (3, bucket("ünï")): 1, (3, bucket("b9")): 1}
    assert [n for b in blocks for n in b.n_features] == [3, 0, 3, 0]


def plain_lloyd(rows, plan):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == plan.dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-plan.bound, min(plan.bound, math.floor(float(np.float32(x)) * plan.scale))) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{plan.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in start[: plan.clusters]]
    for turn in range(plan.rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)) for _, v in kept]
        if turn < plan.rounds:
            for c in range(len(means)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n[1] == c]
                if own:
                    means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    return sorted(repr((i, c, d, inertia[c], sum(inertia.values()), digest[c])) for (i, _), (d, c) in zip(kept, near, strict=True))


def op13(rows, **kw):
    return sorted(repr(tuple(r)) for r in dual_tree.cluster(rows, **kw).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "cast(null as int) as cluster", "cast(null as long) as id", "cast(null as array<long>) as v")


def test_op13_against_plain(spark):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((5, 6)) * 3
    rows = [(i, (middles[i % 5] + 0.3 * rng.standard_normal(6)).round(2).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a hot vector
    rows += [rows[3], rows[3], (None, rows[9][1]), (None, [0.0] * 6), (500, None), (501, []), (502, [1.0] * 5), (503, [None] + [1.0] * 5), (504, [float("nan")] * 6), (505, [float("inf")] + [0.0] * 5), (506, [3e38] + [-3e38] * 5)]
    for plan in (dual_tree.Plan(dims=6, block=64, leaf=4, pairs=100), dual_tree.Plan(dims=6, clusters=20, rounds=3, leaf=1, block=4096)):
        assert op13(vectors(spark, rows).repartition(3), plan=plan) == plain_lloyd(rows, plan)
    few = rows[:3]
    plan = dual_tree.Plan(dims=6)
    assert op13(vectors(spark, few), plan=plan) == plain_lloyd(few, plan)
    assert op13(vectors(spark, rows[-8:-1]), plan=plan) == plain_lloyd(rows[-8:-1], plan)
    assert op13(vectors(spark, []), plan=plan) == []


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 4), st.integers(1, 6), st.integers(0, 10_000))
def test_op13_trees_and_assignment(n, k, dims, spread, seed):
    """Covering, separation and nesting of the tree; assignments equal to comparing everything, on grids full of ties."""
    rng = np.random.default_rng(seed)
    x, means = rng.integers(-spread, spread, (n, dims)), rng.integers(-spread, spread, (k, dims))
    tree = dual_tree.cover_tree(x, 3)
    assert sorted(tree.order.tolist()) == list(range(n))
    own = x[tree.order]
    for node in range(len(tree.first)):
        inside = own[tree.first[node] : tree.last[node]]
        assert np.isclose(np.sqrt(((inside - inside[0]) ** 2).sum(1)).max(), tree.radius[node])
        kids = range(tree.kid_first[node], tree.kid_last[node])
        if len(kids):
            assert tree.first[kids[0]] == tree.first[node] and sum(tree.last[j] - tree.first[j] for j in kids) == len(inside)
            at = own[[tree.first[j] for j in kids]]
            apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + np.eye(len(at)) * 1e9
            assert apart.min() > tree.radius[node] / 2 and all(tree.radius[j] <= tree.radius[node] / 2 + 1e-9 for j in kids)
    found = dual_tree.assign(own, tree, means, dual_tree.cover_tree(means, 1), 7)
    assert found.tolist() == ((own[:, None] - means[None]) ** 2).sum(2).argmin(1).tolist()


def test_op13_prunes_far_pairs(monkeypatch):
    """Clusters far apart: whole nodes are assigned, and few leaf pairs are compared."""
    rng = np.random.default_rng(1)
    means = rng.integers(-10_000, 10_000, (8, 64))
    x = np.concatenate([m + rng.integers(-50, 50, (100, 64)) for m in means])
    tree = dual_tree.cover_tree(x, 16)
    monkeypatch.setattr(dual_tree, "_spread", lambda first, last, plain=dual_tree._spread: seen.append(int((last - first).sum())) or plain(first, last))
    seen: list[int] = []
    dual_tree.assign(x[tree.order], tree, means, dual_tree.cover_tree(means, 1), 1 << 15)
    assert sum(seen[-2:]) < len(x) and max(seen) < len(x) * len(means) // 10
