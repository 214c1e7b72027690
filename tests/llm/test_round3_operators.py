"""Phrases, line dedup and resampling against brute force, over ordinary and odd rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocation, importance, lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# 11: phrases


def brute_phrases(docs, most=3, least=10, percent=50, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for n in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= percent * a for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s))
    return sorted(out)


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def talk(seed, n, langs=("en", "fr", None, "und")):
    rng = random.Random(seed)
    stock = ["new york city", "as well as", "on the other hand", "é \U0001f642 ß", "a b", "b a b", "x\x1cy z", "New  York"]
    words = "the of a b c and to in x y Z".split()
    sep = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", " ; "]
    return [(rng.choice(langs), "".join(rng.choice(stock if rng.random() < 0.4 else words) + rng.choice(sep) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("most,least,percent,top", [(3, 10, 50, 2000), (4, 5, 80, 2000), (2, 3, 50, 7)])
def test_phrases_equal_counts_of_all_phrases(spark, monkeypatch, most, least, percent, top):
    monkeypatch.setattr(collocation, "SHARD", 300)
    docs = talk(1, 120) + [(None, None), ("en", ""), ("en", "  \t"), ("de", "only once here")]
    df = spark.createDataFrame([(t, lang, 1, "x") for lang, t in docs], "text string, lang string, f int, phrase string").repartition(3)
    got = collocation.collocations(df, most, least, percent, top)
    want = brute_phrases(docs, most, least, percent, top)
    assert sorted(pairs(got, *COLS)) == want and len(want) > 10


def test_phrases_of_empty_and_rare_texts(spark, none):
    assert collocation.collocations(none).count() == 0
    assert collocation.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


def test_phrases_with_a_full_filter_are_the_same(spark, monkeypatch):
    """A filter that lets everything pass changes nothing."""
    docs = talk(2, 60)
    df = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string")
    monkeypatch.setattr(collocation, "bloom", lambda phrases: b"\xff" * collocation.BLOOM)
    assert sorted(pairs(collocation.collocations(df), *COLS)) == brute_phrases(docs)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13 + 7
    known = spark.createDataFrame([("en", "a", 3 * big, 1), ("en", "b", 2 * big + 1, 1), ("en", "a b", big, 2)], "lang string, phrase string, f long, words int")
    sizes = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    (row,) = collocation.ranked(known, sizes, 50, 10).collect()
    assert row["score"] == 10**6 * big * big // (3 * big * (2 * big + 1))


def test_automaton_states_are_classes_of_equal_ends():
    rng = random.Random(3)
    for depth in (1, 2, 3, 4):
        words = np.array([rng.choice([0, 1, 1, 2, 2, 3, 4]) for _ in range(300)], np.uint32)
        ends = defaultdict(set)
        for i in range(len(words)):
            for n in range(1, depth + 1):
                p = tuple(words[max(0, i - n + 1) : i + 1])
                if len(p) == n and 0 not in p:
                    ends[p].add(i)
        classes = defaultdict(list)
        for p, e in ends.items():
            classes[frozenset(e), p[-1]].append(p)
        a = collocation.Automaton(words, depth)
        text = lambda i, n: tuple(words[a.at[i] - n + 1 : a.at[i] + 1])
        got = {(text(i, a.longest[i]), int(a.shortest[i]), int(a.count[i])) for i in range(len(a.at))}
        assert got == {(max(c, key=len), min(map(len, c)), len(e)) for (e, _), c in classes.items()}
        for i, up in enumerate(a.link):
            suffix = text(i, a.shortest[i] - 1)
            assert up == -1 if not suffix else a.shortest[up] <= len(suffix) == a.longest[up] and text(up, a.longest[up]) == suffix
        for n in range(1, depth + 1):
            at, f = a.phrases(n)
            assert {tuple(words[i - n + 1 : i + 1]): int(c) for i, c in zip(at, f, strict=True)} == {p: len(e) for p, e in ends.items() if len(p) == n}
    assert len(collocation.Automaton(np.zeros(5, np.uint32), 3).at) == 0


# 12: lines


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    order = lambda i: math.inf if i is None else i
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(order(i))
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == order(i)]
        out.append((i, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return Counter(out)


def pages(seed, n):
    rng = random.Random(seed)
    stock = ["All Rights Reserved", " all rights reserved\t", "ALL RIGHTS RESERVED\r", "short", "ÄÖÜäöüß日本", "äÖÜäöüß日本語!", "0123456789", "012345678", "\x0b\x0c menu | home \x0b", "x" * 39, "", "\x85same line kept"]
    return [(i, "\n".join(rng.choice(stock) if rng.random() < 0.6 else f"line {rng.randint(0, 200)} of its own" for _ in range(rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("block,shard", [(200, 7), (16 << 20, 100_000)])
def test_lines_equal_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "SHARD", shard)
    docs = [*pages(4, 150), (None, "all rights reserved\nonly the null has this"), (None, None), (3, "All rights reserved\n0123456789"), (3, "All rights reserved"), (-5, "menu | home"), (900, ""), (901, None), (902, "\n\n")]
    docs.append((903, "\n".join(f"line {k % 5000} of its own" for k in range(60_000))))
    df = spark.createDataFrame([(i, t, 1, True) for i, t in docs], "doc_id long, text string, block int, body boolean").repartition(4)
    assert Counter(pairs(lines.drop_repeated(df), "doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(docs)


def test_lines_of_odd_and_no_documents(spark, odd, none):
    assert lines.drop_repeated(none).count() == 0
    docs = pairs(odd, "doc_id", "text")
    assert Counter(pairs(lines.drop_repeated(odd), "doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(docs)


def test_perfect_hash_numbers_every_pair_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        hi, lo = rng.integers(-(1 << 63), (1 << 63) - 1, (2, n))
        if n > 2:
            hi[: n // 2] = hi[0]  # equal in one half, told apart by the other
        made = lines.Perfect.of(hi, lo)
        back = lines.Perfect.load(made.sizes, made.packed())
        assert sorted(back.numbers(hi, lo)) == list(range(n))
        if n == 50_000:
            assert sum(made.sizes) < 5 * n
            strange = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 1000))
            at = back.numbers(*strange)
            marks = np.zeros(n, "<u4")
            marks[back.numbers(hi, lo)] = lines.fingerprints(hi, lo)
            assert not ((at >= 0) & (marks[at] == lines.fingerprints(*strange))).any()


# 13: resampling


def brute_draw(docs, target, percent=10, least=20, seed=2024, buckets=10_000, runs=(1, 1)):
    def found(t):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(words) - n + 1)]

    have, want = Counter(), Counter()
    for _, t in docs:
        have.update(found(t)[1])
    for t in target:
        want.update(found(t)[1])
    s_all, t_all = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s_all + buckets) / ((have[b] + 1) * (t_all + buckets))))
    rows = []
    for i, t in docs:
        n, bs = found(t)
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0], r[2], r[1]))
    draw = percent * len(fit) // 100
    out = Counter((r[0], *r[2:], k + 1 if k < draw else None) for k, r in enumerate(fit))
    return out + Counter((r[0], *r[2:], None) for r in rows if r[1] < least)


@pytest.mark.parametrize("percent,least,runs,buckets", [(10, 20, (1, 1), 10_000), (50, 3, (1, 2), 101), (100, 0, (2, 3), 50), (0, 1, (1, 1), 10)])
def test_draws_equal_a_sort_of_all(spark, percent, least, runs, buckets):
    rng = random.Random(6)
    words = ["Alpha", "beta-Gamma", "日本", "naïve", "x1", "ÉTÉ", "the", "\x7fa`b"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(None, None), (None, "the " * 30), (7, "the " * 30), (7, "the " * 30), (500, ""), (501, "!!! ..."), (502, "word " * 50_000)]
    target = ["alpha the the", "naïve x1", None, ""]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, score int, doc string").repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, 2024, buckets, runs)
    assert Counter(pairs(got, "doc_id", "n_features", "weight", "score", "rank")) == brute_draw(docs, target, percent, least, 2024, buckets, runs)


def test_ties_of_a_score_go_by_id(spark):
    """With noise held still by equal ids, rows tie; ranks stay gapless and the cut falls inside a score."""
    docs = [(7, "one two three")] * 9 + [(8, "one two three")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resample(df, df.limit(0), percent=50, least=1)
    assert sorted(r for (r,) in pairs(got.filter("rank IS NOT NULL"), "rank")) == [1, 2, 3, 4, 5]


def test_draw_from_nothing_and_towards_nothing(spark, odd, none, folder):
    assert importance.document_draw(spark, folder(documents=none, benchmark=odd.select("text"))).count() == 0
    docs = pairs(odd, "doc_id", "text")
    got = importance.resample(odd, none)
    assert Counter(pairs(got, "doc_id", "n_features", "weight", "score", "rank")) == brute_draw(docs, [])
    assert got.filter(F.col("rank").isNotNull()).count() > 0
