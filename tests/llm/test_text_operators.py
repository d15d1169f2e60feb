"""Encoding, counts, fingerprints, rules, languages, secrets and quality against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import string
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrameter.llm import language_id, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, simhash, token_counts
from terrameter.llm import queries as q

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = sentencepiece_codec.PrefixTableCodec(open(MODEL, "rb").read())
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = string.ascii_letters + string.digits


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  \n▁the ing<s/>x0A")), st.characters(codec="utf-8")), max_size=60))
def test_sentencepiece_agrees_with_the_library(text):
    ids = LIB.encode(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIB.decode(ids)


def test_sentencepiece_decodes_any_ids():
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(32_000), 259, 28705, 0, 1, 2]) for _ in range(r.randint(0, 9))]
        assert CODEC.decode(ids) == LIB.decode(ids)


def test_sentencepiece_forgets_and_still_agrees():
    small = sentencepiece_codec.PrefixTableCodec(open(MODEL, "rb").read(), remember=3)
    text = "one two three four five six seven one two three, four. Five"
    assert small.encode(text) == small.encode(text) == LIB.encode(text)


def test_sentencepiece_long_runs():
    for text in ("x" * 50_000, " " * 3_001, "ab" * 20_000 + " " + "é" * 1_000):
        assert CODEC.encode(text) == LIB.encode(text)


def message(*fields):
    """A protocol buffer message of (number, value) fields: ints, bytes and floats."""
    out = b""
    for number, value in fields:
        varint = lambda v: bytes([v]) if v < 128 else bytes([v & 127 | 128]) + varint(v >> 7)
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde f▁", max_size=20))
def test_sentencepiece_characters_that_are_no_piece(text):
    """A vocabulary with pieces whose characters are no pieces themselves."""
    global ODD
    if "ODD" not in globals():
        pieces = [(b"<unk>", 2), (b"<s>", 3), (b"</s>", 3), *[(f"<0x{b:02X}>".encode(), 6) for b in range(256)]]
        normal = ["ab", "abc", "▁ab", "▁", "cd", "e", "abcd", "▁e", "de"]
        fields = [(1, message((1, p), (2, 0.0), (3, k))) for p, k in pieces] + [(1, message((1, p.encode()), (2, -float(i)))) for i, p in enumerate(normal)]
        model = message(*fields, (2, message((3, 2), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
        ODD = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.PrefixTableCodec(model)
    library, own = ODD
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)


def test_op8_rows(spark, odd_docs, no_docs, sf_dir):
    got = {(r["doc_id"], r["ids_sha256"]): r for r in sentencepiece_codec.encode_documents(odd_docs, MODEL).collect()}
    for row in odd_docs.collect():
        ids = LIB.encode(row["text"] or "")
        r = got[row["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(no_docs, MODEL).count() == 0
    kept = sentencepiece_codec.encode_documents(odd_docs.limit(3), MODEL, keep_ids=True).collect()
    assert all(LIB.decode(r["ids"]) == r["decoded"] for r in kept)
    rows = q.op8_sentencepiece(spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert len(rows) == len(docs)
    for d in docs.itertuples():
        assert rows.loc[d.doc_id, "ids_sha256"] == hashlib.sha256(",".join(map(str, LIB.encode(d.text))).encode()).hexdigest()


def test_op3_table(spark, odd_docs, no_docs, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = token_counts.encoding(open(path, "rb").read(), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        n = np.array([len(enc.encode_ordinary(r["text"] or "")) for r in docs.select("text").collect()])
        table = token_counts.length_table(token_counts.token_lengths(docs, path, public_tokenizers.PATTERN)).collect()
        assert sorted(r["length"] for r in table) == sorted(set(n.tolist()))
        for r in table:
            k = r["length"]
            assert r["n_docs"] == (n == k).sum() and r["docs_over"] == (n > k).sum() and r["tokens_over"] == n[n > k].sum()
            assert r["truncated_tokens"] == np.minimum(n, k).sum() and r["total_tokens"] == n.sum()
            assert r["lost_tokens"] == n.sum() - np.minimum(n, k).sum() and abs(r["quantile"] - (n <= k).mean()) < 1e-12
    table = token_counts.length_table(token_counts.token_lengths(docs, path, public_tokenizers.PATTERN))
    assert token_counts.truncated_total(table, 777).first()[0] == np.minimum(n, 777).sum()
    assert token_counts.length_quantile(table, 0.5).first()[0] == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]
    assert token_counts.length_table(token_counts.token_lengths(no_docs, path, public_tokenizers.PATTERN)).count() == 0


ENC = token_counts.encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def plain_n_tokens(text):
    """By the pattern in another engine, one piece at a time, and merging the best pair again and again."""
    ranks, n = ENC._mergeable_ranks, 0
    for piece in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        n += len(parts)
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "\n", "\t", "\u3000", "\x85", "\x1c", "a", "'s", "12", "!!", "é"]), st.text(max_size=5)), max_size=12), st.integers(2, 5))
def test_op3_counts_against_a_plain_encoder(parts, least):
    """Also with runs cut from two characters on."""
    text = "".join(parts)
    kept = token_counts._LONG_RUN
    token_counts._LONG_RUN = re.compile(kept.pattern.replace("10000", str(least)))
    try:
        assert token_counts.n_tokens(ENC, text) == len(ENC.encode_ordinary(text)) == plain_n_tokens(text)
    finally:
        token_counts._LONG_RUN = kept


def test_op3_runs_of_two_million(spark):
    """Runs that overflow the library's matcher; a run is one piece, less its last character before text."""
    n = 2_000_000
    one = lambda s: len(ENC._encode_single_piece(s))
    want = {
        " " * n: one(" " * n), "\n" * n: one("\n" * n), "a" + " \t" * n + "b": 1 + one((" \t" * n)[:-1]) + one("\t") + 1, "a" + " " * n + "b": 1 + one(" " * (n - 1)) + one(" b"),
        "x " + "\n" * n + "y " + "\u3000" * n: 1 + one(" " + "\n" * (n - 1)) + one("\n") + 1 + one(" " + "\u3000" * n), "!" * n: one("!" * n),
    }
    assert one(" " * n) == n  # known length: this vocabulary has no token of two spaces
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string").repartition(len(want))
    got = token_counts.token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == dict(enumerate(want.values()))


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(rows):
    """Components by brute force over all pairs of fingerprints."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=repr)


def test_op9_groups(spark, odd_docs, no_docs, sf_dir):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40
    near = spark.createDataFrame([(100 + i, base + f" tail{i}", "en", "z", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd_docs, near, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
        got = simhash.simhash_groups(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_groups(rows)


def test_ball_links_reach_every_near_pair(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(200)]
    for f in fps[:60]:
        x = f
        for _ in range(5):  # chains: each step within two bits
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from terrameter.llm.components import connected_components

    links = simhash.ball_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    parts = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    groups = {d: c for d, _, c in plain_groups(list(zip(signed, fps, strict=True)))}
    assert {s: parts.get(s, s) for s in signed} == groups


def test_components_of_a_path_a_star_and_noise(spark):
    from terrameter.llm.components import connected_components

    links = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (None, 7), (8, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_measures(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_op6_measures(spark, odd_docs, no_docs):
    extra = ["a b c a b c", "a b c d a b c", "one two\none two\n\none two", "x x x x x x", "a b c b c a b c b"]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(50 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(repr((r["doc_id"], *(r[c] for c in cols))) for r in quality_rules.ledger(docs).collect())
    assert got == sorted(repr((r["doc_id"], *plain_measures(r["text"] or ""))) for r in docs.collect())
    assert quality_rules.ledger(no_docs).count() == 0
    assert quality_rules.ledger(odd_docs).count() == 12


def test_op6_ablations(spark, sf_dir):
    rows = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r["fail_bits"] for r in rows.collect()]
    names = list(quality_rules._rules())
    for policy in quality_rules.POLICIES:
        m = quality_rules.mask(policy)
        for r in quality_rules.ablations(rows, policy).collect():
            bit = 1 << names.index(r["rule"])
            assert r["failed"] == sum(bool(b & bit) for b in bits)
            assert r["failed_alone"] == sum(b & m == bit for b in bits)
            assert r["kept_without"] == sum(b & m & ~bit == 0 for b in bits)


def test_op7_held_out_accuracy(spark, sf_dir):
    rows = q.op7_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = rows.merge(docs[["doc_id", "lang"]], on="doc_id")
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    assert both.score.between(0, 1).all()


def test_op7_mixtures_and_odd_texts(spark, odd_docs, no_docs, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.where("n_chars > 1500").select("lang", "text").collect()}
    mixed = by["en"][:1000] + " " + by["de"][:1000]
    (lang, share, shares), (single, one, _) = language_id.predict([mixed, by["fr"]], model)
    assert lang in ("en", "de") and set(shares) >= {"en", "de"} and 0.3 < share < 0.75
    assert single == "fr" and one > 0.9
    got = {r["doc_id"]: r for r in language_id.identify(odd_docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert got[6]["lang_pred"] in model.languages
    assert language_id.identify(no_docs, language_id.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, language_id.fit(no_docs)).collect()} == {"und"}
    assert language_id.fit(odd_docs).languages == ["de", "en", "fr"]


def test_op7_mixture_matches_a_plain_em():
    rng = np.random.default_rng(1)
    words = np.log(rng.dirichlet(np.ones(3), 400)).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), penalty=0.0, floor=-50.0)
    share = language_id.infer(words, np.array([0]), model, rounds=200)[0]
    p, pi = np.exp(words.astype(float)), np.full(3, 1 / 3)
    for _ in range(2000):
        joint = p * pi
        pi = (joint / joint.sum(1, keepdims=True)).mean(0)
    assert np.abs(share - pi).max() < 0.02


def plain_cells(text):
    """Cells of the letter trigrams of each word, one letter at a time."""
    words, word = [], []
    for c in text:
        if c.isalpha():
            word.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif word:
            words.append(word)
            word = []
    out, m = [], 0xFFFFFFFF
    for word in [*words, word] if word else words:
        cells = []
        line = [0, 0, *word, 0]
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            a = 0 if b == 0 else a
            h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA6B & m) ^ (c * 0xC2B2AE35 & m)
            h ^= h >> 15
            cells.append((h * 0x27D4EB2F & m) >> 17)
        out.append(cells)
    return out


def plain_mixture(like, share):
    for _ in range(15):
        joint = like * share
        share = (joint / joint.sum(1)[:, None]).mean(0)
    return share, np.log((like * share).sum(1)).sum()


def plain_language(text, languages, log_p):
    words = plain_cells(text or "")
    if not words:
        return "und", 0.0
    score = np.array([sum(log_p[c] for c in w) for w in words], float)
    like = np.exp(np.maximum(score - score.max(1)[:, None], -14.0))
    k = len(languages)
    single = np.log(like).sum(0)
    best, out = single.max(), np.eye(k)[single.argmax()]
    full, whole = plain_mixture(like, np.full(k, 1 / k))
    for size in range(2, k + 1):
        chosen = np.where(full >= np.sort(full)[-size], full, 0)
        share, value = plain_mixture(like, chosen / chosen.sum())
        if whole - 3.0 * (size - 1) > best and value - 3.0 * (size - 1) > best:
            best, out = value - 3.0 * (size - 1), share
    return languages[out.argmax()], out.max()


def test_op7_query_against_a_plain_version(spark, sf_dir):
    """Counts, mixtures and sets of the whole query, one word and one document at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = q.op7_language_id(spark, sf_dir).toPandas().set_index("doc_id")
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs.doc_id}
    languages = sorted({d.lang for d in docs.itertuples() if d.lang and not held[d.doc_id]})
    counts = np.full((language_id.CELLS, len(languages)), 0.5)
    for d in docs.itertuples():
        if d.lang and not held[d.doc_id]:
            for w in plain_cells(d.text or ""):
                np.add.at(counts, (w, languages.index(d.lang)), 1)
    log_p = np.log(counts / counts.sum(0)).astype(np.float32)
    assert len(got) == len(docs)
    for d in docs.itertuples():
        lang, score = plain_language(d.text, languages, log_p)
        assert got.loc[d.doc_id, "held_out"] == held[d.doc_id]
        assert got.loc[d.doc_id, "lang_pred"] == lang and abs(got.loc[d.doc_id, "score"] - score) < 1e-3


def test_op7_words_longer_than_a_slab(monkeypatch):
    monkeypatch.setattr(language_id, "_SLAB", 8)
    for text in ("abcdefghijklmnopqrstuvwxyz", "ab cd " * 5, "x" * 50 + " " + "y" * 50, "a\nb" * 9, ""):
        pieces = list(language_id._pieces(text))
        assert "".join(pieces) == text and all(p[-1] in " \n" for p in pieces[:-1])
        got = [c.tolist() for p in pieces for c in np.split(*(lambda t: (t[0], t[1][1:]))(language_id.trigrams(p))) if len(c)]
        assert got == plain_cells(text)


def test_op7_documents_of_more_than_three_languages():
    """Every number of languages competes."""
    rng = np.random.default_rng(6)
    model = language_id.Model(list("abcdef"), np.zeros((1, 6)), floor=-50.0)
    for n in (1, 2, 3, 4, 5, 6):
        own = np.repeat(np.arange(n), 40)
        words = np.full((len(own), 6), -8.0) + rng.normal(size=(len(own), 6)) * 0.1
        words[np.arange(len(own)), own] = -2.0
        share = language_id.infer(words, np.array([0]), model)[0]
        assert (share > 0.001).sum() == n and np.allclose(share[:n], 1 / n, atol=0.02)


def test_op7_learns_every_labelled_language(spark):
    """Languages are not left out where there are many; the rows of each stay bounded."""
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i * 3 + k, f"{n * 3} {n}{n[::-1]} {n[::-1] * 2}", n) for i, n in enumerate(names) for k in range(3)] + [(1000 + i, "aa", "aa") for i in range(500)] + [(None, "aa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == sorted([*names, "aa"])
    assert [x[0] for x in language_id.predict([t for _, t, _ in rows[:300]], model)] == [n for _, _, n in rows[:300]]
    few = language_id.training_rows(docs, F.lit(True), language_id.Limits(docs_per_language=50), "doc_id", "text", "lang")
    assert few.columns == docs.columns and 20 < few.where("lang = 'aa'").count() < 100 and few.where("lang <> 'aa'").count() == 300


SCANNER = secret_scan.train()


def hit_rates(scanner, findings):
    """(recall, false alarms by harmless findings, precision)."""
    hits = [(any(b < end and e > begin and s >= 0.5 for b, e, s in scanner.scan(text)), label) for text, begin, end, label in findings]
    found, alarms = sum(h and y for h, y in hits), sum(h and not y for h, y in hits)
    true = sum(y for _, y in hits)
    return found / max(1, true), alarms / max(1, len(hits) - true), found / max(1, found + alarms)


def test_op4_forest_and_masks(spark, odd_docs, no_docs):
    recall, _, precision = hit_rates(SCANNER, secret_scan.labelled_findings(2000, seed=99))
    assert recall > 0.97 and precision > 0.97
    rows = secret_scan.scan_documents(odd_docs, SCANNER).collect()
    assert len(rows) == 12
    masked = [r for r in rows if r["findings"]]
    assert len(masked) == 1 and secret_scan.MASK in masked[0]["text"] and "0123456789abcdef" not in masked[0]["text"]
    before = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] != 9}
    assert all(before[r["doc_id"]] == r["text"] for r in rows if r["doc_id"] in before)
    assert secret_scan.scan_report(no_docs, SCANNER).count() == 0


def test_op4_shapes_that_the_forest_never_saw():
    """Each shape is held out whole: the forest is trained on the others and asked about it alone."""
    true, false = {}, {}
    for shapes, rates, which in ((secret_scan.TRUE_SHAPES, true, 0), (secret_scan.FALSE_SHAPES | secret_scan.HASH_SHAPES, false, 1)):
        for shape in shapes:
            other = secret_scan.train(secret_scan.labelled_findings(without=frozenset([shape])))
            rates[shape] = hit_rates(other, secret_scan.labelled_findings(150, seed=98, only=shape))[which]
    del true["spaced"]  # phrases with spaces, told from sentences only by examples of their own
    assert np.mean(list(true.values())) > 0.9 and min(true.values()) > 0.25  # recall
    assert np.mean(list(false.values())) < 0.1 and max(false.values()) < 0.6 and false["camel"] < 0.2  # share of harmless findings taken for secrets


def test_op4_forest_decides_on_wide_candidates():
    """Hashes, ids, hosts and paths reach the forest, which rejects them."""
    harmless = ["commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b now", "mail und.34@mail7.example.com ok", "see /usr/lib/python3/site/index2.html", "id 550e8400-e29b-41d4-a716-446655440000 ok", "the file path/to/home/list/version_12.py"]
    for text in harmless:
        found = SCANNER.scan(text)
        assert found and all(s < 0.5 for _, _, s in found), text


PLANTED = st.one_of(
    st.text("0123456789abcdef", min_size=32, max_size=64), st.text(ALNUM, min_size=24, max_size=64), st.text(ALNUM + "!@#%^&*+/_.-", min_size=24, max_size=60),
    st.text(ALNUM, min_size=36, max_size=36).map("ghp_".__add__), st.text(ALNUM + "+/", min_size=30, max_size=60).map(lambda s: s + "=="),
)


@settings(max_examples=400, deadline=None)
@given(PLANTED, st.sampled_from(["api_key", "MY_API_KEY", "config_password", "Token", "client-secret", "DB_PASSWORD"]), st.sampled_from(["=", ": ", ' = "', ":='", " => "]), st.text("ab c.\n", max_size=20), st.sampled_from(["", " ", "\n", "x" * 30 + " "]))
def test_op4_no_character_of_a_planted_secret_remains(secret, name, assign, before, lead):
    """Candidates cover the whole secret and leave its name; once accepted, nothing of it stays."""
    quote = assign[-1] if assign[-1] in "\"'" else ""
    head = f"{before} {lead}{name}{assign}"
    text = f"{head}{secret}{quote} and more"
    at = len(head)
    found = [c for c in secret_scan.candidates(text) if c[0] < at + len(secret) and c[1] > at]
    filler = re.match(r"([+/_=.-])\1{3,}", secret)  # a rule line before a value is no part of it
    assert found and min(c[0] for c in found) == at + (filler.end() if filler else 0) and max(c[1] for c in found) == at + len(secret)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))


def test_op4_random_secrets_leave_no_trace(spark):
    """2,000 random secrets in unseen layouts: each found one is masked whole, its name and neighbours stay."""
    findings = [f for f in secret_scan.labelled_findings(4000, seed=77) if f[3]]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(findings)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secret_scan.scan_documents(docs, SCANNER).collect()}
    found = 0
    for i, (text, begin, end, _) in enumerate(findings):
        if any(f["begin"] < end and f["end"] > begin for f in rows[i]["findings"]):
            found += 1
            masked = rows[i]["text"]
            rest = text[end:].lstrip("'\"#!")
            assert masked.startswith(text[:begin]) and masked.endswith(rest)
            assert masked[begin : len(masked) - len(rest)].replace(secret_scan.MASK, "").strip("'\"#!") == ""
    assert found > 0.97 * len(findings)


def plain_candidates(text):
    """Spans by trying every position and every pair of spans."""
    word = lambda i, j: any(c.isascii() and c.isalpha() for c in text[i:j]) and (any(c in "0123456789" for c in text[i:j]) or j - i >= 24 and re.search("[a-z][A-Z]|[/+_]", text[i:j]) is not None)
    spans, names, i = [], [], 0
    while i < len(text):
        m = re.compile(secret_scan.NAMES + r"(?::=|=>|[:=])\s{0,3}" + secret_scan.VALUES).match(text, i)
        b, e = next(m.span(k) for k in (1, 2, 3, 4, 5) if m[k] is not None) if m else (0, 0)
        if e - b >= 6:
            names.append((i, b))
            rule = re.match(r"([+/_=.-])\1{3,}", text[b:e])
            spans.append((b + rule.end() if rule and e - b - rule.end() >= 6 else b, e, True, False))
        i = m.end() if m else i + 1
    for i in range(len(text)):
        m = re.match(r"://([^\s/:@\"'<>]*):([^\s/@\"'<>]*)@", text[i:])
        if m and len(m[2]) >= 4:
            spans.append((i + m.start(2), i + m.end(2), True, False))
    i = 0
    while i < len(text):
        m = secret_scan._SHAPED.match(text, i)
        if m:
            spans.append((*m.span(), False, True))
        i = m.end() if m else i + 1
    inside = [c.isascii() and (c.isalnum() or c in "+/_=.-") for c in text] + [False]
    runs, b = [], None
    for i, yes in enumerate(inside):
        if yes and b is None:
            b = i
        elif not yes and b is not None:
            runs += [(b, i)] if i - b >= 12 else []
            b = None
    for b, e in runs:
        own = [c for c in range(b, e) if not any(x <= c < y for x, y in names)]
        pieces = [[own[0]]] if own else []
        for c in own[1:]:
            pieces[-1].append(c) if c == pieces[-1][-1] + 1 else pieces.append([c])
        for piece in pieces:
            x, y = piece[0], piece[-1] + 1
            if y - x < 12 or not word(x, y):
                continue
            cut, parts = x, []
            for m in re.finditer(r"([+/_=.-])\1{3,}", text[x:y]):
                parts.append((cut, x + m.start()))
                cut = x + m.end()
            parts = [p for p in [*parts, (cut, y)] if word(*p)] or [(x, y)]
            for p, q in parts:
                head, sign, rest = text[p:q].partition("=")
                named = sign and rest[:1] != "=" and re.fullmatch(r"[A-Za-z_][A-Za-z_.-]*[0-9]{0,3}", head) and len(rest) >= 8 and word(q - len(rest), q)
                spans.append((q - len(rest) if named else p, q, False, False))
    joined = True
    while joined:
        joined = False
        for x in spans:
            y = next((y for y in spans if y is not x and y[0] < x[1] and x[0] < y[1]), None)
            if y:
                spans = [s for s in spans if s is not x and s is not y] + [(min(x[0], y[0]), max(x[1], y[1]), x[2] or y[2], x[3] or y[3])]
                joined = True
                break
    return sorted(spans)


def plain_score(trees, x):
    def leaf(t, i):
        return t.share[i] if t.feature[i] < 0 else leaf(t, t.left[i] if x[t.feature[i]] <= t.cut[i] else t.right[i])

    return sum(leaf(t, 0) for t in trees) / len(trees)


def plain_features(text, begin, end, assigned, shaped):
    token = text[begin:end]
    n, low = len(token), token.lower()
    place = lambda c: "abcdefghijklmnopqrstuvwxyz".find(c) if c in "abcdefghijklmnopqrstuvwxyz" else 26
    pairs = [secret_scan._PAIRS[place(a), place(b)] for a, b in zip(low, low[1:], strict=False)]
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in token]
    count = Counter(token)
    lead, tail = text[max(0, begin - 48) : begin], text[end : end + 32]
    words = lambda x: [w.lower() for w in re.findall(r"[^\W\d_]+", x)]
    whole = lambda x, y: not re.fullmatch(r"[^\W\d_]{2}", x + y)
    before, after = words(lead), words(tail)
    before = before if whole(text[max(0, begin - 49) : max(0, begin - 48)], lead[:1]) else before[1:]
    near = before[-4:] + (after if whole(tail[-1:], text[end + 32 : end + 33]) else after[:-1])[:2]
    lead, tail = text[max(0, begin - 3) : begin], text[end : end + 1]
    slashes = sum(c in "/\\" for c in token) + (lead[-1:] in ("/", "\\")) + (tail in ("/", "\\"))
    covered, i = 0, 0
    names = [w for w in secret_scan.WORDS + secret_scan.PLACEHOLDERS if len(w) > 2]
    while i < n:
        longest = max((len(w) for w in names if low.startswith(w, i)), default=0)
        covered, i = covered + longest, i + max(1, longest)
    return [
        np.log(n), np.mean(pairs) if pairs else -3.0, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), kinds.count("d") / n, kinds.count("u") / n,
        len(count) / min(n, 64), -sum(v / n * np.log2(v / n) for v in count.values()), covered / n, min(slashes, 5), sum(w in secret_scan.SECRET_WORDS for w in near), sum(w in secret_scan.HARMLESS_WORDS for w in near),
        assigned, shaped, set(token) <= set("0123456789abcdefABCDEF"), any(p in low for p in secret_scan.PLACEHOLDERS), token.count("-") / n, token.count(".") / n,
        np.log(1 + n - covered - sum(c in " -_./\\:=" for c in token)), sum(c in "!@#$%^&*" for c in token) / n, token.count(" ") / n,
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["api_key", "=", "==", ": ", '"', "'", " ", "\n", "-----", "a1b2c3d4e5f6a7b8", "Abc", "password", "token=", "/usr/lib", "ghp_" + "aB3" * 9, "x.y_z-", "é", "==" * 3, "NAME=", "9" * 15, "word" * 7, "://", "@", ":", ";", ",x", "\\", "passwort"]), max_size=14))
def test_op4_candidates_against_every_position(parts):
    text = "".join(parts)
    assert secret_scan.candidates(text) == plain_candidates(text)


def test_op4_forms_of_assigned_values(spark):
    """Phrases, escaped quotes, logins in addresses, names in other languages, values with commas, known shapes: masked whole, the rest stays."""
    m = secret_scan.MASK
    texts = {
        'password = "correct horse 9 battery staple" next': f'password = "{m}" next', '{"password":"ab\\"cd12XYqq99"}': f'{{"password":"{m}"}}', "use postgres://admin:S3cr3tPw9@db.internal/app now": f"use postgres://admin:{m}@db.internal/app now",
        "passwort: Hunter2x!": f"passwort: {m}", "secret=ab;cd12345XYZtail99 x": f"secret={m} x", "key: sk-4f9aQ2LmZx81TrPq77VbNc30 y": f"key: {m} y", "mot de passe : Zebre77!rouge": f"mot de passe : {m}", "password=q9X1zz7LpW,user=bob": f"password={m},user=bob",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.scan_documents(rows, SCANNER).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    plain = ['the key: "a sentence about the place where we all were last year" and more', "token: first, second, third", "see http://host.example.com:8080/path for more", "key: 'tis the time of year"]
    for text in plain:
        assert all(s < 0.5 for _, _, s in SCANNER.scan(text)), text


HEADS = ["eyJ", "eyJabcdefghi.", "sk-", "ghp_", "xoxb-", "AIza", "AKIA", "key=", 'key: "', "password='", 'token="\\', "secret=ab;", "key=a,", "://", "://a:", "a1", "aB", "-=", "NAME=", "key:'\"", "a.b@", "word "]


@pytest.mark.parametrize("head", HEADS)
def test_op4_time_is_linear_on_repeated_heads(head):
    """Two million characters of any shape's beginning: seconds, where quadratic time would be an hour."""
    text = head * (2_000_000 // len(head))
    began = time.process_time()
    found = secret_scan.candidates(text)
    assert time.process_time() - began < 40
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    began = time.process_time()
    for c in found[:2]:
        secret_scan.features(text, *c)
    assert time.process_time() - began < 40


def test_op4_long_tokens_are_read_whole():
    """A secret behind a rule line or filler of any length is a candidate."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    for filler in ("=" * 450, "-" * 401, "_" * 5000, "=" * 10):
        text = f"see {filler}{key} there"
        at = text.index(key)
        assert [c[:2] for c in secret_scan.candidates(text)] == [(at, at + len(key))]
    text = f"api key {'=' * 450}{key} there"
    assert [c[:2] for c in secret_scan.candidates(text)] == [(458, 498)]
    assert [(b, e) for b, e, s in secret_scan.train().scan(text) if s >= 0.5] == [(458, 498)]
    text = "a" * 450 + key
    assert [c[:2] for c in secret_scan.candidates(text)] == [(0, len(text))]
    assert [c[:2] for c in secret_scan.candidates("abcdefghijkl" + "=" * 9 + "0123456789")] == [(0, 31)]
    assert not secret_scan.candidates("=" * 450 + "a" * 40)


def test_op4_name_and_value_with_punctuation(spark):
    """No tail of an assigned value stays where a long token covers only its head; the name stays."""
    secret = "Tr0ub4dor1&3xyzSECRETTAIL"
    for mark in "&!@#%^*:":
        text = f"x DB_PASSWORD={secret.replace('&', mark)} y"
        assert [c[:3] for c in secret_scan.candidates(text)] == [(14, 14 + len(secret), True)]
    texts = ["x DB_PASSWORD=Tr0ub4dor1&3xyzSECRETTAIL y", "MY_API_KEY=Ab9dXq77Lm20PqRs8TuV!x9Z#tail99", "config_password=Abcdef1234567890!Zq9secretTail", 'see token="a,b;c<d>e1F2g3" end']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.scan_documents(rows, SCANNER).collect()}
    m = secret_scan.MASK
    assert [got[i] for i in range(4)] == [f"x DB_PASSWORD={m} y", f"MY_API_KEY={m}", f"config_password={m}", f'see token="{m}" end']


def test_op4_query_masks_what_a_plain_scan_finds(spark, sf_dir):
    """Candidates, features, votes and masks of the query against plain versions of each."""
    rows = {r["doc_id"]: r for r in q.op4_secret_scan(spark, sf_dir).collect()}
    extra = [(t, None) for t, *_ in secret_scan.labelled_findings(300, seed=55)]
    for d in [*spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "doc_id").collect(), *extra]:
        text, doc_id = d
        found = plain_candidates(text)
        hits = [(b, e) for b, e, a, s in found if plain_score(SCANNER.trees, plain_features(text, b, e, a, s)) >= 0.5]
        assert hits == [(b, e) for b, e, s in SCANNER.scan(text) if s >= 0.5]
        for b, e in reversed(hits):
            text = text[:b] + secret_scan.MASK + text[e:]
        if doc_id is not None:
            assert (rows[doc_id]["n_candidates"], rows[doc_id]["n_secrets"]) == (len(found), len(hits))
            assert rows[doc_id]["masked_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_statistics(text):
    words, lines = WORD.findall(text), text.split("\n")
    n = len(words)
    per = lambda k: k / max(1, n)
    chars = lambda s: per(sum(c in s for c in text))
    return {
        "words": np.log(n + 1.0), "word_chars": per(sum(map(len, words))), "distinct": per(len(set(words))), "bare": per(sum(regex.search(r"\p{L}", w) is None for w in words)),
        "symbols": chars("#*$%&<>"), "bars": chars("|"), "shouts": chars("!"), "stops": chars(".?"), "commas": chars(",;:"), "digits": chars(string.digits), "upper": chars(string.ascii_uppercase),
        "lines": per(len(lines)), "line_repeats": (len(lines) - len(set(lines))) / len(lines), "quotes": chars("\"'()[]{}=/\\"),
    }


def test_op10_query_against_a_plain_version(spark, odd_docs, sf_dir):
    """All 14 statistics, the rules and the score of the query, one text at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (docs, odd_docs, spark.createDataFrame([(1, "😀 a\u00a0b |x| \n\n x\n x\n\u2003")], "doc_id long, text string")):
        got = quality_classifier.with_statistics(rows, [F.col("text").alias("raw")]).collect()
        assert len(got) == rows.count()
        for r in got:
            want = plain_statistics(r["raw"] or "")
            assert list(want) == quality_classifier.NAMES and all(abs(r[k] - v) < 1e-9 for k, v in want.items())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    rows = {r["doc_id"]: r for r in q.op10_quality_classifier(spark, sf_dir).collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        x = plain_statistics(d["text"] or "")
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[quality_classifier.NAMES[f]] > cut) == greater for f, greater, cut in rule))
        r = rows[d["doc_id"]]
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.op10_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_op10_column_score_is_the_ensemble(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    x = rng.random((500, len(quality_classifier.NAMES)))
    y = ((x[:, 4] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    model = quality_classifier.fit_rules(x, y)
    assert 0 < len(model.rules) < 400
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], quality_classifier.NAMES)
    got = np.array([r[0] for r in frame.select(model.score()).collect()])
    z = model.bias + sum(w * quality_classifier._holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.abs(got - 1 / (1 + np.exp(-z))).max() < 1e-9
    assert ((got >= 0.5) == y).mean() > 0.97
    scored = quality_classifier.score_documents(odd_docs, model).collect()
    assert len(scored) == 12 and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_classifier.score_documents(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (6, 1)], "doc_id long, quality int")
    assert 0 <= quality_classifier.score_documents(odd_docs, quality_classifier.fit(odd_docs, labels, F.lit(True))).first()["score"] <= 1
    assert quality_classifier.fit(odd_docs, labels.limit(0), F.lit(True)).score() is not None


def test_lasso_is_sparse():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (400, 30)).astype(float)
    y = (z[:, 0] > 0).astype(float)
    w, _ = quality_classifier.lasso_logistic(z, y, 0.02)
    assert w[0] > 1 and (np.abs(w[1:]) < 0.2).all()
