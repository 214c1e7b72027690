"""keep_one against groups by exact Jaccard similarity of five-word shingle sets."""

from __future__ import annotations

import random
from functools import cache

from conftest import SCHEMA, rows

from ledgerloom.llm import simhash


@cache
def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def kept(spark, texts):
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    return {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}


def first_of_groups(texts):
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and jaccard(texts[a], texts[b]) >= 0.8:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    return {group.index(g) for g in set(group)}


def pair(rng, n, new):
    """Texts of n + 4 words; the second has `new` other shingles at its end."""
    words = fresh(rng, n + 4)
    return [" ".join(words), " ".join(words[: n + 4 - new] + fresh(rng, new))]


def test_pairs_below_the_threshold_stay(spark):
    rng = random.Random(5)
    texts = [t for _ in range(60) for t in pair(rng, 400, 60)]  # 340 of 460 shingles: 0.739
    assert all(0.7 < jaccard(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert kept(spark, texts) == set(range(120))


def test_no_similar_pair_is_missed(spark):
    rng = random.Random(6)
    texts = [t for n in (4, 5, 9, 20, 50, 200, 1000) for _ in range(12) for t in pair(rng, n - n // 9, max(1, n // 9) if n > 9 else 0)]
    for n in (4, 9, 49):  # one set is the other and n // 4 shingles more: 0.8 or just above
        for _ in range(12):
            words = fresh(rng, n + 4 + max(1, n // 4))
            texts += [" ".join(words[: n + 4]), " ".join(words)]
    texts += [" ".join(fresh(rng, 40) + ["a", "common", "passage", "that", "many", "texts", "hold"]) for _ in range(40)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    want = first_of_groups(texts)
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows(docs), SCHEMA)).select("doc_id").collect()}
    assert sum(jaccard(a, b) >= 0.8 for a, b in zip(texts[:-40:2], texts[1:-40:2], strict=True)) > 80
    assert got == want


def test_components_of_any_size(spark, monkeypatch):
    """Contraction rounds and the one task give the same groups."""
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(120)]
    df = spark.createDataFrame(edges, "a long, b long")
    groups = lambda rows: {frozenset(n for n, x in rows if x == y) for y in {x for _, x in rows}}
    whole = groups([tuple(r) for r in simhash.components(df, "t").collect()])
    monkeypatch.setattr(simhash, "EDGES", 10)
    assert groups([tuple(r) for r in simhash.components(df, "t").collect()]) == whole
    assert frozenset(range(500, 621)) in whole and sum(map(len, whole)) == len({n for e in edges if e[0] != e[1] for n in e})


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    """Many texts with common passages that no sample tells as frequent."""
    monkeypatch.setattr(simhash, "UNLIKE", 4)
    monkeypatch.setattr(simhash, "SAMPLE", 0)
    rng = random.Random(9)
    passages = [fresh(rng, 30) for _ in range(3)]
    texts = []
    for _ in range(60):
        words = fresh(rng, rng.randint(5, 60)) + rng.choice(passages) + fresh(rng, rng.randint(0, 20))
        texts += [" ".join(words), " ".join(words[: len(words) - rng.randint(0, 12)])]
    assert kept(spark, texts) == first_of_groups(texts)


def test_a_crowd_of_near_copies_meets_its_centre(spark, monkeypatch):
    """Pairs to be verified grow with the copies, not with their square, and no link is lost."""
    rng = random.Random(11)
    base, texts = fresh(rng, 150), []
    spare = [fresh(rng, 3) for _ in base]  # so that some copies share what they changed
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 4, 5, 5, 6])):
            words[at] = rng.choice(spare[at]) if rng.random() < 0.5 else fresh(rng, 1)[0]
        texts.append(" ".join(words))
        if rng.random() < 0.2:  # a copy of the copy, near it and hardly the base
            words[rng.randrange(150)] = fresh(rng, 1)[0]
            texts.append(" ".join(words))
    seen, alike = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda docs, pairs, *a: (seen.append(pairs.count()), alike(docs, pairs, *a))[1])
    assert kept(spark, texts) == first_of_groups(texts)
    assert sum(seen) < 30 * len(texts)


def test_rows_without_ids_and_repeated_ids(spark):
    rng = random.Random(10)
    a, b, c = (" ".join(fresh(rng, 30)) for _ in range(3))
    data = [(None, a, "x"), (None, a, "y"), (1, b, "x"), (1, b, "y"), (1, c, "z"), (2, b + " more", "w"), (3, None, "n"), (4, "", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, id string")
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (1, b), (1, c), (3, None)], key=str)


def test_blank_texts_are_one_group(spark):
    """Texts without words differ as texts and are alike as sets."""
    data = [(5, ""), (1, "  "), (2, "\n\t"), (4, None), (None, " "), (3, "one"), (6, "two words"), (7, "one")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 3, 6]
