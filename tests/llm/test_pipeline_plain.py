"""The whole pipeline against a plain version, one document at a time."""

from __future__ import annotations

import hashlib
import math

import pytest
from test_text_operators import LIB, SCANNER, WORD, plain_candidates, plain_features, plain_fingerprint, plain_score


def plain_kept(docs):
    """Documents with a letter; of each group of near fingerprints the one with the smallest id."""
    docs = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def plain_masked(text):
    hits = [(b, e) for b, e, a, s in plain_candidates(text) if plain_score(SCANNER.trees, plain_features(text, b, e, a, s)) >= 0.5]
    for b, e in reversed(hits):
        text = f"{text[:b]}[SECRET]{text[e:]}"
    return text


def plain_targets(sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    fixed = {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in fixed}
        left = sum(sizes.values()) - sum(fixed.values())
        targets = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s, t in targets.items() if t > 3 * sizes[s]]
        if not over:
            return fixed | targets
        fixed |= {s: 3 * sizes[s] for s in over}


def plain_mix(docs):
    by = {}
    for d in docs:
        n = len(WORD.findall(d["text"]))
        symbols = sum(c in "#*$%&|<>" for c in d["text"])
        u = (int(hashlib.md5(f"{d['doc_id']}:17".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by.setdefault(d["source"], []).append((-math.log(u) / max(0.1, 1.0 - symbols / max(n, 1)), d["doc_id"], n, d))
    targets = plain_targets({s: sum(x[2] for x in rows) for s, rows in by.items()})
    out = []
    for source, rows in by.items():
        size = sum(x[2] for x in rows)
        epochs = math.floor(targets[source] / size) if size else 0
        rest, prior = targets[source] - epochs * size, 0
        for _, _, n, d in sorted(rows, key=lambda x: x[:3]):
            out += [d] * (epochs + (n > 0 and prior + n / 2 <= rest))
            prior += n
    return out


def test_pipeline_against_a_plain_version(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = [d | {"text": plain_masked(d["text"])} for d in plain_kept(docs)]
    want = []
    for d in plain_mix(kept):
        ids = LIB.encode(d["text"])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids))))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_leaves_no_planted_secret(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from terrameter.llm import secret_scan

    findings = [f for f in secret_scan.labelled_findings(1200, seed=31) if f[3]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (t, *_) in enumerate(findings)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = pipeline.mask_secrets(spark, docs, "").collect()
    found = [r for r in rows if secret_scan.MASK in r["text"]]
    assert len(rows) == len(findings) and len(found) > 0.97 * len(rows)
    for r in found:
        text, begin, end, _ = findings[r["doc_id"]]
        rest = text[end:].lstrip("'\"#!")
        assert r["text"].startswith(text[:begin]) and r["text"].endswith(rest) and r["n_chars"] == len(r["text"])
        assert r["text"][begin : len(r["text"]) - len(rest)].replace(secret_scan.MASK, "").strip("'\"#!") == ""
