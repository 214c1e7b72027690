"""The pipeline's rows against a version in plain Python, and its stages over odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
from test_llm_operators import brute_spans, texts_of, tokenizer
from test_near_dedup import first_of_groups

from ledgerloom.llm import mixing, quality

DATA = "/root/testdata/sf0.001"


def one_of_each(docs):
    """By exact similarity of five-word shingle sets, all pairs."""
    docs = sorted(docs)
    stay = first_of_groups([t or "" for _, t, *_ in docs])
    return [d for at, d in enumerate(docs) if at in stay]


def redacted(text):
    at, out = 0, []
    for a, _, b in brute_spans(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def topic(t):
    return "tabular" if " | " in t else "legal" if "license" in t.lower() else "loud" if "!! " in t else "plain"


def mixed(docs):
    named = lambda v, k: v if v in mixing.TARGETS[k] else mixing.OTHER
    cell = lambda d: (named(d[2], "source"), named(d[3], "lang"), topic(d[1]))
    sums = Counter()
    for d in docs:
        sums[cell(d)] += len(re.findall(r"[^ \t-\r]+", d[1]))
    raked = mixing.rake(sums, [mixing.TARGETS[k] for k in ("source", "lang", "topic")])
    rate = {k: min(1.0, v / sums[k] * mixing.BUDGET) for k, v in raked.items()}
    u = lambda i: int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:12], 16) / 2**48
    return [d for d in docs if u(d[0]) < rate.get(cell(d), 0.0)]


def test_pipeline_rows(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(rows.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))
    docs = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in rows.collect()]
    import numpy as np

    x = np.array([quality.features(t.encode()) for _, t, *_ in docs])
    docs = [d for d, s in zip(docs, model.score(x), strict=True) if s >= quality.THRESHOLD]
    docs = mixed([(i, redacted(t), s, g) for i, t, s, g in one_of_each(docs)])
    t, want = tokenizer("byte_bpe_50k.json"), Counter()
    for i, text, *_ in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_stages_take_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, DATA)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            assert out.count() <= docs.count()
    assert len(texts_of(odd)) == odd.count()
