"""Mixing, chat formatting, embeddings and the pipeline."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrameter.llm import chat, embedding_dedup, mixing, simhash
from terrameter.llm import queries as q
from terrameter.llm.embedding_dedup import Limits, near_duplicates


def plain_targets(sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        targets = {s: left * w / sum(rest.values()) for s, w in rest.items()} if rest else {}
        over = [s for s, t in targets.items() if t > 3 * sizes[s]]
        if not over:
            return fixed | targets
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(docs):
    rows = mixing.mix_report(docs).toPandas()
    texts = docs.select("doc_id", "text", "source").toPandas()
    assert len(rows) == len(texts)
    sizes = texts.assign(n=[len((t or "").split()) if isinstance(t, str) else 0 for t in texts.text], s=[s if isinstance(s, str) else None for s in texts.source])
    want = sizes.groupby("s", dropna=False).n.sum()
    by = {(None if s != s else s): int(v) for s, v in want.items()}
    targets = plain_targets(by)
    assert (rows.taken <= 3 * rows["size"]).all()
    got = rows.groupby("target").taken.sum()
    for target, taken in got.items():
        same = [s for s, t in targets.items() if abs(t - target) < 1e-6 * max(1, t)]
        assert same and abs(taken - target * len(same)) <= len(same)
    return rows


def test_op1_targets(spark, odd_docs, no_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, again = check_mix(docs), check_mix(docs.repartition(7))
    key = ["doc_id", "taken"]
    assert first[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    check_mix(odd_docs)
    assert mixing.mix_report(no_docs).count() == 0
    assert mixing.mix_sources(no_docs).count() == 0


def test_sql_of_operators_matches(spark, sf_dir):
    """The registered SQL on another engine; for op1 also with null ids, texts and sources."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    near = lambda rows, names: sorted(repr([float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in sorted(range(len(names)), key=names.__getitem__)]) for r in rows)
    for name, sql in q.oracle_sql().items():
        got, want = q.queries()[name](spark, sf_dir), con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names) and near(got.collect(), got.columns) == near(want.fetchall(), names), name
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumns({"doc_id": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")), "source": F.when(F.col("n_chars") % 5 > 0, F.col("source")), "text": F.when(F.col("n_chars") % 7 > 0, F.col("text"))})
    odd = docs.toPandas()  # noqa: F841  the other engine reads it by name
    odd["doc_id"] = odd["doc_id"].astype("Int64")
    con.execute("CREATE OR REPLACE TABLE rows AS SELECT * FROM odd")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM rows")
    got, want = mixing.mix_report(docs), con.execute(mixing.SQL)
    names = [c[0] for c in want.description]
    assert near(got.collect(), got.columns) == near(want.fetchall(), names)


def test_sql_of_near_duplicates_on_odd_rows(spark):
    """op5 and op9 against their SQL on copies, near copies, null, zero and non-finite vectors, and words of every length."""
    import duckdb

    con, rng = duckdb.connect(), np.random.default_rng(3)
    far = rng.standard_normal((60, 16))
    near = far[:25] + 0.2 * rng.standard_normal((25, 16))
    vectors = [*far.tolist(), *near.tolist(), *far[:5].tolist(), None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    embeddings = rows.toArrow()  # noqa: F841  the other engine reads it by name
    got = [tuple(r) for r in near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(con.execute(embedding_dedup.SQL).fetchall()) and sum(r[1] for r in got) > 20

    base = " ".join(f"w{i}" for i in range(300))
    texts = [*("abcdéfghX"[i % 9] * i + "Q" for i in range(70)), None, "", " \n", "One  Two", "one two", base, base + " x", base.upper(), "é\u00a0É x y z", "ÄA ÄA ÄA"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = rows.toArrow()  # noqa: F841
    got = simhash.simhash_groups(rows).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(simhash.SQL).fetchall())


def test_op1_no_task_sorts_a_share_of_a_source(spark):
    """Low weights, null ids and ties: the rows that are sorted stay few, and the draw is that of one whole sort."""
    text = F.concat(F.repeat(F.lit("# "), (F.col("id") % 7).cast("int")), F.lit("one two "), F.col("id").cast("string"))
    low = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    low = low.withColumn("text", F.when(F.col("source") == "a", F.concat(F.lit("#" * 90 + " "), "text")).otherwise(F.col("text")))
    no_ids = low.where("doc_id % 5 = 0").withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit("c")})
    ties = spark.range(500).select(F.lit(77).cast("long").alias("doc_id"), F.lit("same row").alias("text"), F.lit("d").alias("source"))
    docs = low.union(no_ids).union(ties)
    from terrameter.llm.store import written

    rows = written(mixing.keyed(docs))
    for fine in (1, 40, 100_000):
        plan = mixing.source_plan(rows, fine=fine)
        ranges = rows.join(plan, rows["_source"].eqNullSafe(plan["_of"])).where(mixing._among())
        assert all(r["n"] <= fine or r["k"] == 1 for r in ranges.groupBy("_source").agg(F.count("*").alias("n"), F.count_distinct(*mixing.ORDER).alias("k")).collect())
        got = mixing.mix(rows, plan, fine).select("_source", "_key", "_id", "_size", "extra", "rest").toPandas()
        assert len(got) == rows.count()
        for _, part in got.groupby("_source", dropna=False):
            part = part.sort_values(["_key", "_id", "_size"], na_position="first")
            prior = part._size.cumsum() - part._size
            want = np.clip(np.minimum(part._size, np.floor(part.rest) - prior), 0, None).to_numpy()
            tie = part.groupby(["_key", "_size"]).extra.transform("sum").to_numpy(), part.assign(w=want).groupby(["_key", "_size"]).w.transform("sum").to_numpy()
            assert (tie[0] == tie[1]).all()
    check_mix(docs)


def test_op1_equal_keys_are_counted(spark):
    """A hundred thousand rows with one key, by null ids and by one id: words taken are the target, rows stay whole, no task has them all."""
    from terrameter.llm.store import written

    n = 100_000
    no_ids = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four five six seven").alias("text"), F.lit("a").alias("source"), F.lit(1).alias("x"))
    one_id = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("b").alias("source"), (F.col("id") % 2).cast("int").alias("x"))
    few = spark.range(50).select("id", F.lit("one two").alias("text"), F.lit("c").alias("source"), F.lit(1).alias("x")).toDF("doc_id", "text", "source", "x")
    docs = written(no_ids.union(one_id).union(few))
    rows = written(mixing.keyed(docs))
    plan = mixing.source_plan(rows)
    ends = {r["_of"]: r for r in plan.collect()}
    assert ends["a"]["n"] == n and ends["b"]["n"] in (n // 6, n // 6 + 1) and ends["b"]["lo_hash"] == ends["b"]["hi_hash"]
    got = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert sorted(r["n"] for r in got) == [50, n, n] and all(0 <= r["target"] - r["taken"] < 1 + 1e-6 and r["most"] <= 3 for r in got)
    shares = mixing._repeated(rows.join(plan, rows["_source"].eqNullSafe(plan["_of"])).where(mixing._among() & (F.col("n") > mixing.FINE)), mixing.FINE).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in shares) == n + ends["b"]["n"] and max(r["count"] for r in shares) <= n // 2
    mixed = mixing.mix_sources(docs).groupBy("source", "x", "text").count().collect()
    words = {s: sum(r["count"] * len(r["text"].split()) for r in mixed if r["source"] == s) for s in "abc"}
    assert all(abs(words[s] - ends[s]["target"]) <= 7 for s in "abc")
    assert {(r["x"], r["text"]) for r in mixed if r["source"] == "b"} <= {(r["x"], r["text"]) for r in docs.where("source = 'b'").distinct().collect()}
    few = mixing.mix(rows, plan, fine=mixing.FINE).where("_size > 0").groupBy("_of").agg(F.sum("extra").alias("e"), F.max("rest").alias("r")).collect()
    assert all(r["e"] == int(r["r"]) for r in few)


def test_op1_rows_with_types_that_have_no_hash(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), "text"))
    assert mixing.mix_sources(docs).columns == docs.columns and mixing.mix_report(docs).count() == 2


def test_op1_rows_repeat_whole(spark, odd_docs):
    mixed = mixing.mix_sources(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert {r["text"] for r in mixed.collect()} <= {r["text"] for r in odd_docs.collect()}


def test_op1_heavy_documents_are_drawn_more_often():
    rng = np.random.default_rng(5)
    w = np.repeat([1.0, 4.0], 5000)
    key = -np.log(rng.random(10_000)) / w
    assert (w[np.argsort(key)[:2000]] == 4).mean() > 0.7  # the rule that the column form applies


def test_op1_skewed_source_spreads(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"))
    rows = check_mix(docs)
    assert rows.taken.sum() > 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a</s>"]), st.text(alphabet=st.one_of(st.sampled_from(list("\\<>/s[]INST|_role")), st.characters(codec="utf-8")), max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    parts = [chat.format_turn(r, t) for r, t in turns]
    whole = "".join(p[0] for p in parts)
    assert [(r, t) for r, t, _, _ in chat.parse(whole)] == turns
    for (role, text), (segment, begin, end) in zip(turns, parts, strict=True):
        assert role != "assistant" or chat.unescape(segment[begin:end]) == text
    for control in chat.CONTROL:
        assert control not in chat.escape("".join(t for _, t in turns))


def test_chat_layouts_by_fingerprint():
    u, s = "ask", "answer"
    layouts = [
        {"prompt": u, "completion": s}, {"question": u, "answer": s}, {"instruction": u, "output": s}, {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": s}]},
        {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": s}]}, {"dialog": {"turns": [{"speaker": "human", "utterance": u}, {"speaker": "bot", "utterance": s}]}},
    ]
    for record in layouts:
        assert chat.turns(record)[1] == [("user", u), ("assistant", s)]
        assert chat.turns(dict(reversed(record.items())))[0] == chat.turns(record)[0]
    assert chat.turns({"unknown": 1})[1] is None


def test_chat_records_keep_every_row(spark):
    rows = [(1, json.dumps({"prompt": "a", "completion": None})), (2, None), (3, "{broken"), (4, "[1]"), (5, json.dumps({"messages": []}))]
    got = chat.format_records(spark.createDataFrame(rows, "id long, record string"), ["id"], "record").collect()
    assert {r["id"] for r in got} == {1, 2, 3, 4, 5}
    assert {r["id"] for r in got if r["part"] == -1} == {2, 3, 4, 5}


def test_op2_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas()
    rows.loc[len(rows)] = [-1, 0, "user", "</s>[INST] ok [/INST]"]
    rows.loc[len(rows)] = [-1, 1, "assistant", "</s>[INST] ok [/INST]"]
    got = q.op2_chat_format(spark, sf_dir).toPandas().set_index("conv_id")
    assert len(got) == rows.conv_id.nunique()
    for conv, part in rows.groupby("conv_id"):
        part = part.sort_values(["turn", "role", "text"]).fillna("")
        learned = "".join(part.text[part.role == "assistant"])
        r = got.loc[conv]
        assert r.n_turns == len(part)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in zip(part.role, part.text, strict=True)).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for a, b in zip(part.role, part.text, strict=True))


def test_op2_nulls_and_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(5000)] + [(None, None, None, None), (2, 0, "user", None), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_records(records, ["conv_id", "turn"], "record"), "conv_id", ["turn", "role", "text"]).collect()}
    assert got[1]["n_turns"] == 5000 and got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(0, 5000, 2)).encode()).hexdigest()
    assert chat.conversation_digests(chat.format_records(records.limit(0), ["conv_id", "turn"], "record"), "conv_id", ["turn"]).count() == 0


def brute_duplicates(ids, vectors, threshold=0.95):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(ids))}
    unit = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in good}
    for i in good:
        for j in good:
            if i != j and len(vectors[i]) == len(vectors[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
    out, seen = [None] * len(ids), set()
    for i in range(len(ids)):
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        least = min((ids[j] for j in part if ids[j] is not None), default=None)
        for j in part:
            out[j] = ids[j], len(links[j]), least
    return sorted(out, key=repr)


def test_op5_small_leaves_and_tiles(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 16))
    vectors = [(c + rng.normal(size=16) * 0.08 * np.linalg.norm(c) / 4).astype(np.float32).tolist() for c in centers for _ in range(int(rng.integers(1, 8)))]
    vectors += [(centers[0] + rng.normal(size=16) * 0.04).astype(np.float32).tolist() for _ in range(150)]  # one large group
    vectors += [vectors[3]] * 40 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").withColumn("cid", F.lit(0)).withColumn("label", F.lit(None).cast("int"))
    limits = Limits(trees=8, leaf=24, group=64, tile=32)
    got = near_duplicates(df, limits=limits).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_duplicates(ids, vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert near_duplicates(df.limit(0)).count() == 0


def test_op5_recall_on_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * side
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.vstack([a, b]))]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), limits=Limits(leaf=64, group=256)).toPandas()
    assert (got.n_links > 0).mean() >= 0.97 and (got.n_links <= 1).all()


def test_op5_recall_in_a_dense_cluster(spark):
    """With the limits in use: pairs at the threshold inside one cluster of mean cosine 0.9."""
    rng = np.random.default_rng(10)
    mean = rng.normal(size=64)
    x = np.sqrt(0.9) * mean / np.linalg.norm(mean) + np.sqrt(0.1) * rng.normal(size=(10_000, 64)) / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[:500]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    x[500:1000] = 0.951 * a + np.sqrt(1 - 0.951**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    linked = np.array([(x @ v >= 0.95).sum() > 1 for v in x])
    got = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    assert linked[:1000].all() and not (got.n_links.to_numpy() > 0)[~linked].any()
    assert (got.n_links.to_numpy()[linked] > 0).mean() >= 0.98


def test_op5_leftover_vectors_meet_in_blocks(spark):
    """Where trees are not allowed to help, the vectors left over are compared in full."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=16) + 0.2 * rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99, limits=Limits(trees=1, most_trees=1, group=64)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_duplicates([i for i, _ in rows], [v for _, v in rows], 0.99)


@pytest.mark.parametrize("rounds", [True, False])
def test_op5_groups_beyond_the_fitted_levels(spark, monkeypatch, rounds):
    """Few fitted levels for many vectors: groups are split on the cluster, or met in blocks where that fails."""
    from terrameter.llm import embedding_dedup

    rng = np.random.default_rng(12)
    a = rng.normal(size=(2500, 24))
    b = a[:800] + 0.25 * np.linalg.norm(a[:800], axis=1, keepdims=True) * rng.normal(size=(800, 24)) / np.sqrt(24)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))]
    limits = Limits(leaf=16, group=64, top_depth=1)
    if not rounds:  # quantiles at the ends put every vector on both sides, so no group ever shrinks
        limits = Limits(leaf=16, group=64, top_depth=3, trees=1, most_trees=2)
        monkeypatch.setattr(embedding_dedup, "split_large", lambda dealt, *_: (dealt.limit(0), dealt.join(dealt.groupBy("grp").agg(F.count("*").alias("n")), "grp")))
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), limits=limits).toPandas().set_index("vec_id").sort_index()
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    linked = near.sum(1) > 1
    assert linked.sum() > 800 and not (got.n_links.to_numpy() > 0)[~linked].any()
    assert (got.n_links.to_numpy()[linked] > 0).mean() >= 0.97


def test_op5_large_groups_are_split_by_rounds(spark):
    from terrameter.llm import embedding_dedup

    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 8))
    dealt = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)] + [(5, 9000 + i, [1.0] * 8) for i in range(300)], "grp long, cid long, vec array<double>")
    limits = Limits(group=32)
    small, large = embedding_dedup.split_large(dealt, 8, 6, limits, 1)
    sizes = small.groupBy("grp").count().toPandas()["count"]
    assert sizes.max() <= 4 * 32 and {r["cid"] for r in small.select("cid").collect()} == set(range(3000))
    assert {r["cid"] for r in large.select("cid").collect()} == {9000 + i for i in range(300)}  # equal vectors cannot be split
    blocks = embedding_dedup._block_pairs(large, limits).toPandas()
    met = set()
    for _, part in blocks.groupby(["grp", "i", "j"]):
        assert len(part) <= 4 * 32
        met |= {(a, b) for a in part.cid for b in part.cid if a < b}
    assert len(met) == 300 * 299 // 2


def test_shared_folder_must_be_named_on_a_cluster():
    from terrameter.llm import store

    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        store.shared_dir(Session())


def test_op2_clashing_columns(spark, odd_docs):
    """Extra columns named like the operator's own change nothing."""
    rows = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "y")], "conv_id long, turn long, role string, text string, part string")
    plain = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    extra = plain.withColumns({c: F.lit("z") for c in ("part", "segment", "n_turns", "role", "text", "begin", "ids")})
    digest = lambda df: chat.conversation_digests(chat.format_records(df, ["conv_id", "turn"], "record"), "conv_id", ["turn"]).collect()
    assert digest(plain) == digest(extra)


def test_pipeline_stages(spark, sf_dir, odd_docs, no_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["language_id", "simhash_dedup", "secret_scan", "mix_sources", "sentencepiece"]
    assert [n for n, _ in pipeline.STAGES] == names
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    from terrameter.llm.store import written

    for _, stage in pipeline.STAGES[:-1]:
        now = written(stage(spark, now, sf_dir))
        assert now.columns == docs.columns
    assert pipeline.run(spark, sf_dir).count() == now.count()
    kept = pipeline.drop_near_duplicates(spark, docs, sf_dir).toPandas()
    groups = q.op9_simhash_dedup(spark, sf_dir).toPandas()
    assert sorted(kept.doc_id) == sorted(groups.doc_id[groups.doc_id == groups.component_id])
    for stage in (s for _, s in pipeline.STAGES):
        stage(spark, odd_docs, sf_dir).count()
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert pipeline.drop_near_duplicates(spark, odd_docs, sf_dir).where("doc_id = 1").count() == 1
    assert pipeline.mask_secrets(spark, odd_docs, sf_dir).count() == 12


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Null and repeated ids neither join groups nor empty them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d, e = (" ".join(f"{w}{i * k % 97}" for i in range(60)) for w, k in (("ape", 3), ("bee", 5), ("cat", 7), ("dog", 11), ("elk", 13)))
    texts = [(5, a), (5, b), (3, b), (None, c), (None, d), (None, d), (7, e), (None, e), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(5, a), (3, b), (None, c), (None, d), (7, e), (8, None)], key=repr)


def test_op5_forest_stays_within_its_bytes():
    """Directions of all trees and levels: bounded for any length, and all levels where vectors are short."""
    limits = Limits()
    assert limits.for_length(64).top_depth == limits.top_depth
    for dim in (768, 4096, 100_000, 10**9):
        depth = limits.for_length(dim).top_depth
        assert depth >= 1 and (depth == 1 or limits.most_trees * 2**depth * dim * 4 <= limits.forest_bytes)


def test_op7_null_ids_share_no_roll(spark):
    from terrameter.llm import language_id

    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    some = language_id.training_rows(docs, F.lit(True), language_id.Limits(docs_per_language=100), "doc_id", "text", "lang").count()
    assert 50 < some < 180
