"""Phrases whose words occur together more often than apart, from suffix automata of shards.

Texts are split at punctuation and line ends into pieces, pieces into words. A shard is the
words of some documents of one language, as numbers, with a list of its distinct words;
shards are written once to the shared folder. Over a shard stands a generalised suffix
automaton of bounded depth: its states are the classes of phrases with the same end
positions, each with its shortest and longest length, the number of end positions, one of
them, and a suffix link. It is built by refinement, a depth at a time: phrases that end at a
position are told apart by the word before them, so a phrase's refinements are the suffix
tree's next level, and one with as many end positions as its refinement is of its class.

Counts are reduced over shards level by level. A phrase can occur `least` times only if
both phrases of one word less can, so those that reach it are put in a Bloom filter of
BLOOM bytes, and shards leave out phrases that it excludes. What passes by chance, or
because the filter is full, is counted exactly and dropped after that: the filter's size
bounds what is broadcast and never changes the result.

A longer phrase that holds a candidate holds it through phrases of one word more or less,
each at least as frequent as itself. So a candidate is subsumed if a candidate of one word
more is frequent enough whose suffix link (or, at the other end, whose prefix) it is.

Null texts are empty; a null language is `und`. Repeated rows count each time. A text of any
length is in one shard, which ends with the document that fills it. Ties are broken by
phrase in UTF-8 byte order. An empty table, or one without frequent phrases, gives an empty
result. Columns besides text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound_batches, lean, pin, read, utf8

#: Words after which a shard ends, bytes of the filter between levels, and of a page of it.
SHARD, BLOOM, PAGE = 1_000_000, 8 << 20, 16 << 10
#: Bits of the filter that a phrase sets.
PROBES = 4
#: Rows of an Arrow batch of counts.
ROWS = 200_000

#: Lower case, every end of a piece as a full stop, and tabs as blanks.
PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b".........." + b" abcdefghijklmnopqrstuvwxyz")


class Numbers(dict):
    """Numbers words from 1 as they are met; 0 ends a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes, numbers: Numbers) -> np.ndarray:
    """The numbers of a text's words, with 0 at ends of pieces."""
    words = text.translate(PLAIN).replace(b".", b" . ").split()
    return np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))


class Automaton:
    """A generalised suffix automaton of phrases of up to `depth` words.

    For each state: `shortest` and `longest` length of its phrases, `count` of their end
    positions, `at` one of these, and `link`, the state of the longest phrase that is
    shorter by the first words and has more end positions (-1: the empty phrase).
    """

    def __init__(self, words: np.ndarray, depth: int):
        w = np.concatenate([np.zeros(depth, np.int64), words.astype(np.int64)])
        ends = np.flatnonzero(w)
        node = np.zeros(len(ends), np.int64)
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(depth):
            before = w[ends - d]
            if d:
                ends, node, before = (x[before != 0] for x in (ends, node, before))
            keys, first, node, count = np.unique(node << 32 | before, return_index=True, return_inverse=True, return_counts=True)
            levels.append((ends[first] - depth, count, keys >> 32))
        shortest = [np.ones(len(levels[0][0]), np.int64)] if levels else []
        state = [np.ones(len(x[0]), bool) for x in levels]
        for d in range(1, depth):
            _, count, up = levels[d]
            same = count == levels[d - 1][1][up]
            state[d - 1][up[same]] = False
            shortest.append(np.where(same, shortest[d - 1][up], d + 1))
        # Numbers of states over all levels; a phrase that is no state is its refinement's.
        number, total = [], 0
        for s in state:
            number.append(np.where(s, np.cumsum(s) - 1 + total, -1))
            total += int(s.sum())
        link = [np.full(len(x[0]), -1, np.int64) for x in levels]
        for d in range(1, depth):
            up = levels[d][2]
            link[d] = np.where(number[d - 1][up] >= 0, number[d - 1][up], link[d - 1][up])
        pick = lambda parts: np.concatenate([p[s] for p, s in zip(parts, state, strict=True)])
        self.words = words
        self.at, self.count = pick([x[0] for x in levels]), pick([x[1] for x in levels])
        self.longest = pick([np.full(len(s), d + 1) for d, s in enumerate(state)])
        self.shortest, self.link = pick(shortest), pick(link)

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """An end position and the count of each distinct phrase of this length."""
        has = (self.shortest <= length) & (length <= self.longest)
        return self.at[has], self.count[has]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode(), 11)
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, from those of their words in order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = _mixed(out * np.uint64(31) + p)
    return out


def places(hashes: np.ndarray, probe: int) -> np.ndarray:
    """A bit of the filter for each hash; there are PROBES."""
    step = _mixed(hashes) | np.uint64(1)
    return (hashes + np.uint64(probe) * step) % np.uint64(8 * BLOOM)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for probe in range(PROBES):
        at = places(hashes, probe)
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def shards(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, tokens (how many words), words (distinct, in the order of their numbers) and numbers (32 bits each, 0 at ends of pieces), one row a shard."""
    bound_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(text).alias("text"))
    made = pa.schema([("lang", pa.string()), ("tokens", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        press = zstandard.ZstdCompressor(level=1).compress
        stop = np.zeros(1, np.uint32)

        def shard(lang: str) -> pa.RecordBatch:
            numbers, parts = open_.pop(lang)
            flat = np.concatenate(parts)
            planes = np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            # Words hold no blanks.
            row = [lang, int((flat != 0).sum()), press(b" ".join(list(numbers)[1:])), press(planes)]
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, made, strict=True)], schema=made)

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                numbers, parts = open_.setdefault(name, (Numbers(), []))
                parts += [numbered(t.as_buffer().to_pybytes(), numbers), stop]
                sizes[name] = sizes.get(name, 0) + len(parts[-2])
                if sizes[name] >= SHARD:
                    yield shard(name)
                elif sum(sizes.values()) >= 2 * SHARD:
                    yield shard(max(sizes, key=sizes.get))
        for name in list(open_):
            yield shard(name)

    return rows.mapInArrow(lean(split), "lang string, tokens long, words binary, numbers binary")


def counted(parts: DataFrame, length: int, bits: bytes | None) -> DataFrame:
    """lang, phrase and f of phrases of this many words, over all shards; without those that have a shorter phrase outside the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        load = zstandard.ZstdDecompressor().decompress
        held = None if bits is None else np.frombuffer(bits, np.uint8)
        for b in batches:
            for lang, some, packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                names = [b"", *load(some.as_buffer()).split()]
                numbers = np.ascontiguousarray(np.frombuffer(load(packed.as_buffer()), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")
                at, f = Automaton(numbers, length).phrases(length)
                if held is not None:
                    hashes = word_hashes(lang, names)
                    word = [hashes[numbers[at - length + 1 + i]] for i in range(length)]
                    maybe = _held(held, phrase_hashes(word[1:])) & _held(held, phrase_hashes(word[:-1]))
                    at, f = at[maybe], f[maybe]
                known = pa.array(names, pa.binary()).cast(pa.string())
                for i in range(0, len(at), ROWS):
                    ends = at[i : i + ROWS]
                    words = [known.take(pa.array(numbers[ends - length + 1 + j])) for j in range(length)]
                    phrase = pc.binary_join_element_wise(*words, " ") if length > 1 else words[0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ends), pa.string()), phrase, pa.array(f[i : i + ROWS], pa.int64())], ["lang", "phrase", "f"])

    rows = parts.select("lang", "words", "numbers").mapInArrow(lean(count), "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bloom(phrases: DataFrame) -> bytes:
    """A filter of (lang, phrase). A task sends the pages in which it has set bits, packed; they are united page by page, and BLOOM / PAGE pages come to the driver."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bits = np.zeros(8 * BLOOM, bool)
        for b in batches:
            by: dict[int, list[np.ndarray]] = {}
            for lang, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = word_hashes(lang, p.encode().split(b" "))
                by.setdefault(len(words), []).append(words)
            for found in by.values():
                hashes = phrase_hashes(list(np.stack(found).T))
                for probe in range(PROBES):
                    bits[places(hashes, probe)] = True
        pages = bits.reshape(-1, 8 * PAGE)
        met = np.flatnonzero(pages.any(axis=1))
        packed = [zstandard.compress(np.packbits(pages[i], bitorder="little").tobytes()) for i in met]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(packed, pa.binary())], ["page", "bits"])

    def unite(t: pa.Table) -> pa.Table:
        import zstandard

        out = np.zeros(PAGE, np.uint8)
        for x in t["bits"]:
            out |= np.frombuffer(zstandard.decompress(x.as_py()), np.uint8)
        return pa.table({"page": t["page"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "page long, bits binary"
    pages = phrases.select("lang", "phrase").mapInArrow(lean(put), schema).groupBy("page").applyInArrow(unite, schema).collect()
    out = np.zeros((BLOOM // PAGE, PAGE), np.uint8)
    for r in pages:
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def first_words(phrase, n):
    return F.call_function("substring_index", phrase, F.lit(" "), n)


def last_words(phrase, n):
    return F.call_function("substring_index", phrase, F.lit(" "), -n)


def collocations(df: DataFrame, words: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to `words` words that occur at least `least` times. One is subsumed by a longer candidate that occurs in `percent` percent of its places."""
    parts = pin(shards(df, text, lang), "collocation-shards")
    levels, bits = [], None
    for length in range(1, words + 1):
        levels.append(pin(counted(parts, length, bits).filter(F.col("f") >= least).withColumn("words", F.lit(length)), f"collocation-{length}"))
        if length < words:
            bits = bloom(levels[-1])
    known = levels[0]
    for x in levels[1:]:
        known = known.unionByName(x)
    return ranked(known, parts.groupBy("lang").agg(F.sum("tokens").alias("n")), percent, top)


def ranked(known: DataFrame, sizes: DataFrame, percent: int, top: int) -> DataFrame:
    """The best candidates among known (lang, phrase, f, words), which holds every phrase that is frequent enough. Products are decimals of 38 digits: counts up to 10^15 are exact."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    found = known.filter("words > 1")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "k", F.col("f").alias("a"), first_words(F.col("phrase"), F.col("k")).alias("first"), last_words(F.col("phrase"), F.col("words") - F.col("k")).alias("rest")
    )
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(1000000 * cast(a AS decimal(38,0)) * cast(a AS decimal(38,0)) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0))) AS bigint)")
    cut = F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "words").agg(cut).select("lang", "phrase", "cut.*")
    longer = found.filter("words > 2").select("lang", "f", F.explode(F.array(last_words(F.col("phrase"), F.col("words") - 1), first_words(F.col("phrase"), F.col("words") - 1))).alias("phrase"))
    within = longer.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    free = scored.join(within, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (100 * wide("within") < percent * wide("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", place).filter(F.col("rank") <= top).join(sizes, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def oracle_sql() -> str:
    """By n-grams of whole pieces; only phrases of three words can hold a candidate of two."""
    return r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
i AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
u AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS no FROM i),
x AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY id ORDER BY no)),
g AS (SELECT lang, 1 AS k, w AS p FROM x UNION ALL SELECT lang, 2, w || ' ' || w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.p, c.f AS a, x.j, array_to_string(string_split(c.p, ' ')[1:x.j], ' ') AS first, array_to_string(string_split(c.p, ' ')[x.j + 1:], ' ') AS rest FROM c, (VALUES (1), (2)) x(j) WHERE x.j < c.k),
s AS (SELECT cuts.*, lf.f AS l, rf.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(lf.f AS HUGEINT) * rf.f) AS BIGINT) AS score FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.p = cuts.first JOIN f rf ON rf.lang = cuts.lang AND rf.p = cuts.rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
up AS (SELECT lang, unnest([array_to_string(string_split(p, ' ')[1:2], ' '), array_to_string(string_split(p, ' ')[2:3], ' ')]) AS p, f FROM c WHERE k = 3),
sub AS (SELECT DISTINCT best.lang, best.p FROM best JOIN up USING (lang, p) WHERE 100 * up.f >= 50 * best.a),
free AS (SELECT * FROM best ANTI JOIN sub USING (lang, p))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM free JOIN n USING (lang) QUALIFY rank <= 2000"""
