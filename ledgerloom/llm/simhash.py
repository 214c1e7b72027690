"""SimHash near-duplicates, with pivot distance tables.

A text's fingerprint is made of words of 64 bits; each bit says whether over half of the
text's shingle hashes have that bit set. For each fingerprint a table holds its Hamming
distances to PIVOTS reference fingerprints. By the triangle inequality two fingerprints
within a radius have no coordinates further apart than the radius, so a pair that meets
is discarded by its largest coordinate difference, and the survivors are verified.

Pairs meet in cells:

- `document_groups` (links of 2 bits or fewer): four blocks of 16 bits, a cell for each two
  blocks; two differing bits leave two blocks untouched, so no link is lost.
- `similar_sets` (the pipeline; links of a Jaccard similarity): two sets of similarity t have
  one of the first n - ceil(t * n) + 1 shingles in common, in any order that is the same for
  all sets, so cells of those lose no link. Shingles that a sample finds frequent come last
  in that order, and cells that still hold many unlike sets are dissolved: their shingles go
  to the end of the order too, and the sets that had them get other cells. Sets of FEW or
  more shingles are held against each other by fingerprints of several words, whose radius
  is that of the similarity and SIGMAS standard deviations more (one pair in 10^11 is
  beyond it); what is left is verified by the similarity itself, counted from the texts.

A cell of m near-duplicates would give m * m pairs. So links are found in two steps: all
members are held against the smallest of their cell, and components made of that. Then,
in cells that still hold several components, members outside the cell's largest are held
against members of other components. Before that, `similar_sets` holds the members of
crowded cells against a few hubs, some turns over, since a crowd of near copies need not
be near its smallest. What is still a crowd is held by centres: each member x by one centre
c at most, with its difference D(x), the shingles that only one of x and c has. Of two
members held by c, either both are linked to c, if |D(x)| + |D(y)| is no more than a linked
pair's sets differ by, or a link needs D(x) and D(y) to share shingles. So such pairs meet
in cells of the differences' prefixes and nowhere else. Two sets meet only at places of the order that leave enough
shingles for the overlap that the similarity asks for. A link can only be left out if both ends are known
to be connected already, so components are whole.

Components: while there are more than EDGES edges, each node is contracted into the
neighbour (or itself) that a hash of the round favours, which leaves a constant share of
the nodes; what is left is solved in one task, whose input EDGES bounds.

Nulls and empty texts have fingerprint zero and are linked like any other. Rows with
equal doc_id are each kept. A component of null ids only has a null component_id. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .shared import bound_batches, drop_pinned, lean, packed, pin, read, utf8

SEED = 42
#: Reference fingerprints.
PIVOTS = 8
#: Shingles whose bits are counted at a time.
STEP = 1 << 14
#: Edges that one task solves at most.
EDGES = 1 << 20


def hashes(text: bytes, size: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of the text's shingles of `size` words, A-Z lower-cased, joined by a space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: splits at 0x20 and 0x09-0x0D alone
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - size)])]
    cuts = map(slice, starts, ends[min(size, len(words)) - 1 :])
    pieces = set(map(line.__getitem__, cuts)) if distinct else map(line.__getitem__, cuts)
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64)


def fingerprint(h: np.ndarray, words: int = 1) -> list[int]:
    """Bits that over half of the hashes have, as signed numbers of 64 bits. Further words come from the hashes mixed anew."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), STEP):
            part = h[i : i + STEP]
            if k:
                part = _mix(part, k)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0]) if len(h) else 0)
    return out


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each k."""
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, size: int, words: int = 1, distinct: bool = False, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and fp, an array of `words` numbers, of each row."""
    bound_batches(df.sparkSession)
    schema = df.select(F.col(key).cast("long").alias(key)).schema.add("fp", ArrayType(LongType()))
    target = pa.schema([(key, pa.int64()), ("fp", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(hashes(t.as_buffer().to_pybytes(), size, distinct), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(made, target.field(1).type)], schema=target)

    return df.select(key, utf8(column).alias("_bytes")).mapInArrow(lean(run), schema)


def references(words: int) -> list[list[int]]:
    """PIVOTS fingerprints of random bits, as signed numbers."""
    return np.random.default_rng(1000 + words).integers(-(2**63), 2**63, (PIVOTS, words)).tolist()


def distance(x: list[Column], y: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, (F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)))


def table(fp: list[Column]) -> Column:
    """The distances of a fingerprint to the references, as an array."""
    return F.array(*(distance(fp, [F.lit(w).cast("long") for w in p]).cast("short") for p in references(len(fp))))


def apart(x: Column, y: Column) -> Column:
    """The largest difference of two tables' coordinates; no pair has a smaller distance."""
    return F.greatest(*(F.abs(x[i] - y[i]) for i in range(PIVOTS)))


def shared_cells(cells: DataFrame, name: str) -> DataFrame:
    """The rows (k, id, ...) of cells with several members, and h, the cell's smallest id."""
    heads = cells.groupBy("k").agg(F.min("id").alias("h"), F.max("id").alias("_m")).filter("h < _m").select("k", "h")
    return pin(cells.join(heads, "k"), name)


def star_pairs(cells: DataFrame, near: Column) -> DataFrame:
    """(a, b): each member b that is near a head, with the smallest such head."""
    return cells.filter((F.col("id") != F.col("h")) & near).groupBy(F.col("id").alias("b")).agg(F.min("h").alias("a")).select("a", "b")


def labelled(cells: DataFrame, labels: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The cells' rows with label and g, the group whose members needn't meet: the label, or the centre that holds (held: a, b) a member."""
    known = cells.drop("h").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    if held is None:
        return known.withColumn("g", F.col("label"))
    centre = held.select(F.col("b").alias("id"), F.xxhash64(F.lit("centre"), "a").alias("g"))
    return known.join(centre, "id", "left").withColumn("g", F.coalesce("g", "label"))


def pairs_across(cells: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b, la, lb): near members of a cell (k, id, label, g, ...) that have different labels and groups. Pairs inside a cell's largest group aside, all pairs of unlike groups meet."""
    held = cells.groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("k").agg(F.max(F.struct("n", "g")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("k", F.col("top.g").alias("top"))
    inside = cells.join(mixed, "k").select("k", "top", F.struct(*(c for c in cells.columns if c != "k")).alias("m"))
    x, y = (inside.select("k", F.col("top").alias(f"{c}top"), F.col("m").alias(c)) for c in "xy")
    once = (F.col("y.g") == F.col("ytop")) | (F.col("x.id") < F.col("y.id"))
    unlike = (F.col("x.g") != F.col("y.g")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.filter(F.col("x.g") != F.col("xtop")).join(y, "k").filter(unlike & once & near(F.col("x"), F.col("y")))
    side = lambda c: F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.label").alias("label"))
    return pairs.select(F.least(side("x"), side("y")).alias("p"), F.greatest(side("x"), side("y")).alias("q")).distinct().select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.label").alias("la"), F.col("q.label").alias("lb"))


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        for side in (label[x], label[y], x, y):  # heads and members alike take the smaller label
            np.minimum.at(label, side, low)
        label = label[label]
        if (label == old).all():
            return nodes, nodes[label]


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label: a node that stands for all that are reachable, for every node of the edges (a, b)."""
    bound_batches(edges.sparkSession)
    live = pin(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    into: list[DataFrame] = []
    while live.count() > EDGES:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(into)), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        favoured = both.groupBy("a").agg(F.min(F.least(order("a"), order("b"))).alias("m"))
        into.append(pin(favoured.select(F.col("a").alias("node"), F.col("m.v").alias("into")), f"{name}-{len(into)}"))
        for c in "ab":
            live = live.join(into[-1].select(F.col("node").alias(c), F.col("into").alias(f"_{c}")), c)
        live = pin(live.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), f"{name}-live")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            for part in _sliced(*solve(*(np.concatenate(c) for c in zip(*got, strict=True)))):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["node", "label"])

    labels = pin(live.coalesce(1).mapInArrow(lean(run), "node long, label long"), f"{name}-labels")
    for level in reversed(into):
        known = level.join(labels.select(F.col("node").alias("into"), "label"), "into", "left")
        labels = pin(known.select("node", F.coalesce("label", "into").alias("label")), f"{name}-labels")
    return labels


def _sliced(*columns: np.ndarray, rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(columns[0]), rows):
        yield [c[i : i + rows] for c in columns]


def relabelled(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """node, label, once links between labels (la, lb) join them. Nodes that had no label are their own."""
    joined = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")), name).withColumnRenamed("label", "last")
    known = labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    fresh = joined.join(labels, "node", "left_anti").select("node", F.col("last").alias("label"))
    return pin(known.unionByName(fresh), f"{name}-known")


def linked(nodes: DataFrame, radius: int) -> DataFrame:
    """node, label of all nodes (id: a fingerprint of one word) that have links: equal labels for nodes that links of radius (2 at most) bits connect."""
    quarters = [F.shiftrightunsigned("id", lo).bitwiseAND(F.lit(0xFFFF).cast("long")) for lo in range(0, 64, 16)]
    keys = [F.xxhash64(F.lit(n), *which) for n, which in enumerate(combinations(quarters, 2))]
    cells = shared_cells(nodes.select("id", table([F.col("id")]).alias("t")).select(F.explode(F.array(*keys)).alias("k"), "id", "t"), "simhash-cells")
    near = lambda x, y: (apart(x["t"], y["t"]) <= radius) & (distance([x["id"]], [y["id"]]) <= radius)
    head = {"id": F.col("h"), "t": table([F.col("h")])}
    labels = components(star_pairs(cells, near({"id": F.col("id"), "t": F.col("t")}, head)), "simhash-stars")
    return relabelled(labels, pairs_across(labelled(cells, labels), near), "simhash-joined")


def near_duplicates(df: DataFrame, size: int, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of those linked, directly or over others) of each row."""
    prints = pin(fingerprints(df, size), "simhash-prints")
    nodes = pin(prints.groupBy(F.col("fp")[0].alias("id")).agg(F.min("doc_id").alias("first")), "simhash-nodes")
    labels = linked(nodes.select("id"), radius).withColumnRenamed("node", "id")
    labels = nodes.join(labels, "id", "left").select("id", "first", F.coalesce("label", "id").alias("label"))
    heads = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    known = pin(labels.join(heads, "label").select("id", "component_id"), "simhash-known")
    return prints.join(known, F.col("fp")[0] == F.col("id")).select("doc_id", "fp", "component_id")


def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles with repeats, one word of 64 bits, links at 2 bits or fewer, none lost."""
    found = near_duplicates(read(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a fingerprint of a set, standard deviations that its radius has more than the similarity's angle, and shingles under which it decides nothing.
WIDE, SIGMAS, FEW = 4, 7, 64
#: Share of the documents whose shingles are counted to tell frequent ones, and how many of these (8 bytes each) are told at most. A share, so that what is frequent doesn't depend on the corpus's size.
SAMPLE, FREQUENT = 0.2, 1 << 20
#: Unlike sets that a cell may hold before it is dissolved, and how many times that is done.
UNLIKE, DISSOLVE = 100, 2
#: Unlike sets beyond which a cell's members are first held against hubs, how many of its members are hubs, and how often that is done.
CROWD, HUBS, ROUNDS = 32, 8, 3
#: Similarity with a centre from which it holds a set.
HELD = 0.5
#: Ids that may be broadcast (8 bytes each).
MOST_IDS = 1 << 18


def radius_for(similarity: float, bits: int, sigmas: float = SIGMAS) -> int:
    """Differing bits to expect of two sets with this Jaccard similarity, and so many standard deviations more."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * angle + sigmas * math.sqrt(bits * angle * (1 - angle)))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets of hashes; of two empty sets 1."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _named(docs: DataFrame) -> DataFrame:
    """id, the XXH64 of the text, and _bytes, the text."""
    return docs.select("doc_id", utf8("text").alias("_bytes")).select("doc_id", F.xxhash64("_bytes").alias("id"), "_bytes")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and _bytes, once for each of the ids."""
    ids = pin(ids.distinct(), "simhash-ids")
    few = ids.count() <= MOST_IDS
    found = _named(docs).select("id", "_bytes").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return found.groupBy("id").agg(F.first("_bytes").alias("_bytes"))


def both_texts(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, ...) of ids with their texts _x and _y, and the table of texts."""
    pairs = pin(pairs, "simhash-pairs")
    texts = pin(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "simhash-texts")
    x, y = (texts.select(F.col("id").alias(c), F.col("_bytes").alias(n)) for c, n in (("a", "_x"), ("b", "_y")))
    return pairs.join(y, "b").join(x, "a").select(*pairs.columns, "_x", "_y"), texts


def alike(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) of ids whose sets of shingles have the Jaccard similarity, counted from their texts."""
    bound_batches(docs.sparkSession)
    names, schema = pairs.columns, pairs.schema
    found, texts = both_texts(docs, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, x = None, None
        for b in batches:
            keep = []
            for a, p, q in zip(b.column(names.index("a")).to_pylist(), b.column(len(names)), b.column(len(names) + 1), strict=True):
                if a != name:  # pairs come in the order of a
                    name, x = a, hashes(p.as_buffer().to_pybytes(), size, True)
                keep.append(jaccard(x, hashes(q.as_buffer().to_pybytes(), size, True)) >= similarity)
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(keep, pa.bool_()))

    found = pin(found.mapInArrow(lean(run), schema), "simhash-alike")
    drop_pinned(texts)
    return found


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that several documents of a sample have, sorted. They only order shingles: no result depends on them."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(t.as_buffer().to_pybytes(), size, True).view(np.int64))], names=["k"])

    some = docs.select(utf8("text").alias("_bytes")).sample(float(SAMPLE), SEED)
    counts = some.mapInArrow(lean(run), "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "k").limit(FREQUENT).select("k").toArrow().column(0).to_numpy()
    return np.sort(top.view(np.uint64))


def prefix_length(n: int, similarity: float) -> int:
    """So many of a set's shingles, in one order for all sets, that two sets with the similarity have one of them in common: an overlap of ceil(similarity * n) can't avoid n - ceil(similarity * n) + 1 of n."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def among(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of h the sorted array `last` holds."""
    return last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)


def prefix(h: np.ndarray, similarity: float, last: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    rare = ~among(h, last)
    return np.concatenate([h[rare], h[~rare]])[: prefix_length(len(h), similarity)]


def set_nodes(docs: DataFrame, size: int, similarity: float, last: np.ndarray) -> DataFrame:
    """One row for each text: id, first (its smallest doc_id), and of its set of shingles n, fp, t and prefix."""
    schema = "doc_id long, id long, n int, fp array<long>, prefix array<long>"
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [hashes(t.as_buffer().to_pybytes(), size, True) for t in b.column(2)]
            made = [len(h) for h in sets], [fingerprint(h, WIDE) for h in sets], [prefix(h, similarity, last).view(np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["doc_id", "id", "n", "fp", "prefix"])

    prints = _named(docs).mapInArrow(lean(run), schema)
    nodes = prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    return pin(nodes.withColumn("t", table([F.col("fp")[w] for w in range(WIDE)])), "simhash-nodes")


def sized(x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-9


def meeting(x: Column, y: Column, similarity: float) -> Column:
    """Whether sets that share the shingle at places x.p and y.p of their orders can have the similarity if it is the first they share: no more shingles follow than the overlap needs."""
    needed = similarity / (1 + similarity) * (x["n"] + y["n"]) - 1e-9
    return sized(x, y, similarity) & (F.least(x["n"] - x["p"], y["n"] - y["p"]) >= needed)


def placed(prefix: Column) -> Column:
    """k, a prefix's shingle, and p, its place."""
    return F.posexplode(prefix).alias("p", "k")


def crowds(cells: DataFrame) -> DataFrame:
    """k of cells with over CROWD labels."""
    return cells.select("k", "label").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CROWD).select("k")


def hub_pairs(cells: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b, la, lb): members b of crowded cells and the cell's hubs a of another label. Hubs are members that a hash of the turn favours, so that cells of the same sets mostly have the same ones."""
    order = F.xxhash64(F.lit(turn), "id")
    hubs = cells.join(crowds(cells), "k").groupBy("k", F.pmod(order, F.lit(HUBS)).alias("slot")).agg(F.min(F.struct(order.alias("o"), "id", "label", "n", "p")).alias("x")).select("k", "x")
    members = cells.select("k", F.struct("id", "label", "n", "p").alias("y"))
    met = members.join(hubs, "k").filter((F.col("x.label") != F.col("y.label")) & meeting(F.col("x"), F.col("y"), similarity))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()


def by_hubs(docs: DataFrame, nodes: DataFrame, cells: DataFrame, labels: DataFrame, size: int, similarity: float) -> DataFrame:
    """The labels, once links to hubs join them. A crowd of near copies becomes one label, or nearly so, without meeting pair by pair; what it leaves meets in pairs_across."""
    for turn in range(ROUNDS):
        held = pin(labelled(cells, labels), "simhash-held")
        links = alike(docs, plausible(hub_pairs(held, turn, similarity), nodes, similarity), size, similarity)
        drop_pinned(held)
        if not links.limit(1).count():
            break
        labels = relabelled(labels, links, "simhash-hubs")
    return labels


def centre_pairs(cells: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each member b of crowded cells, with the centre a that its fingerprint is nearest to. A cell has a centre for each class of sizes, open to the next classes: the member with the fewest shingles before the cell's own, so the fewest rare ones."""
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity)).cast("int")
    inside = pin(cells.join(crowds(cells), "k").select("k", "id", "p", kind.alias("c")), "simhash-crowd")
    centres = inside.groupBy("k", "c").agg(F.min(F.struct("p", "id")).alias("x")).select("k", F.col("x.id").alias("a"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    met = inside.join(centres, ["k", "c"]).select("a", F.col("id").alias("b")).distinct()
    x, y = (nodes.select(F.col("id").alias(c), F.col("fp").alias(f"_{c}")) for c in "ab")
    far = distance(*([F.col(f"_{c}")[w] for w in range(WIDE)] for c in "ab"))
    return met.join(x, "a").join(y, "b").groupBy("b").agg(F.min(F.struct(far.alias("d"), "a")).alias("m")).select("m.a", "b")


def differences(docs: DataFrame, pairs: DataFrame, size: int, similarity: float, last: np.ndarray) -> DataFrame:
    """Of each pair (a, b) with the similarity HELD: n and r, the sizes of b and of its difference to a, whether it is linked to a, and the difference's prefix.

    Linked sets of t's sizes differ by (1 - t) / t * n shingles at most, so a linked set's difference to a shares all but so many of r. Shingles that a lacks come first, rare ones before the others: those of a would meet all that lost them.
    """
    bound_batches(docs.sparkSession)
    schema = "a long, b long, n int, r int, linked boolean, prefix array<long>"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
    found, texts = both_texts(docs, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, x = None, None
        for batch in batches:
            made = []
            for a, b, p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != name:  # pairs come in the order of a
                    name, x = a, hashes(p.as_buffer().to_pybytes(), size, True)
                y = hashes(q.as_buffer().to_pybytes(), size, True)
                if (near := jaccard(x, y)) >= HELD:
                    more, less = np.sort(np.setdiff1d(y, x, True)), np.sort(np.setdiff1d(x, y, True))
                    late, r = among(more, last), len(more) + len(less)
                    first = r - max(1, math.ceil(r - (1 - similarity) / similarity * len(y) - 1e-9)) + 1
                    made.append((a, b, len(y), r, near >= similarity, np.concatenate([more[~late], more[late], less])[:first].view(np.int64)))
            columns = zip(*made, strict=True) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "n", "r", "linked", "prefix"])

    found = pin(found.select("a", "b", "_x", "_y").mapInArrow(lean(run), schema), "simhash-differences")
    drop_pinned(texts)
    return found


def by_centres(docs: DataFrame, nodes: DataFrame, cells: DataFrame, labels: DataFrame, size: int, similarity: float, last: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The differences of what centres hold, and the labels, once links to centres join them."""
    cells = pin(labelled(cells, labels), "simhash-held")
    held = differences(docs, centre_pairs(cells, nodes, similarity), size, similarity, last)
    drop_pinned(cells)
    links = held.filter("linked and a <> b")
    for c in "ab":
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"_{c}", c))
    return held, relabelled(labels, links.select("la", "lb"), "simhash-centres")


def pairs_held(held: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b, la, lb): sets held by one centre, with different labels, whose differences share a shingle of their prefixes and have enough left for a link."""
    spread = held.select("a", F.col("b").alias("id"), "n", "r", F.posexplode("prefix").alias("p", "e"))
    cells = shared_cells(spread.select(F.xxhash64("a", "e").alias("k"), "id", "n", "r", "p"), "simhash-spread")

    def near(x: Column, y: Column) -> Column:
        shared = (x["r"] + y["r"] - (1 - similarity) / (1 + similarity) * (x["n"] + y["n"])) / 2 - 1e-9
        return sized(x, y, similarity) & (F.least(x["r"] - x["p"], y["r"] - y["p"]) >= shared)

    return pairs_across(labelled(cells, labels), near)


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, ...) that sizes, pivots and fingerprints leave. Pivots and fingerprints leave all pairs of small sets."""
    x, y = (nodes.select(F.col("id").alias(c), F.struct("n", "fp", "t").alias(f"_{c}")) for c in "ab")
    p, q = F.col("_a"), F.col("_b")
    words = lambda c: [c["fp"][w] for w in range(WIDE)]
    radius = radius_for(similarity, 64 * WIDE)
    close = (apart(p["t"], q["t"]) <= radius) & (distance(words(p), words(q)) <= radius)
    return pairs.join(x, "a").join(y, "b").filter(sized(p, q, similarity) & ((F.least(p["n"], q["n"]) < FEW) | close)).select(pairs.columns)


def dissolved(docs: DataFrame, nodes: DataFrame, cells: DataFrame, labels: DataFrame, held: DataFrame, size: int, similarity: float, last: np.ndarray) -> DataFrame:
    """Cells (k, id, n, p, label, g) in which no more unlike sets meet than need be. Shingles of cells with over UNLIKE groups go to the end of the order; sets that have one in their prefix get the next shingles instead. Other sets keep theirs, which the new order doesn't change."""
    unlike = lambda c: c.groupBy("k").agg(F.approx_count_distinct("g").alias("m")).filter(F.col("m") > UNLIKE).select("k")
    cells = pin(labelled(cells, labels, held), "simhash-labelled")
    crowded, hit = None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hashes(t.as_buffer().to_pybytes(), size, True)
                for part in _sliced(h.view(np.int64), among(h, last)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), i)), *map(pa.array, part)], names=["id", "k", "late"])

    for _ in range(DISSOLVE):
        more = unlike(cells)
        more = pin(more.join(crowded, "k", "left_anti") if crowded else more, "simhash-crowds")
        if not more.limit(1).count():
            break
        new = cells.join(more, "k").select("id")
        crowded = pin(crowded.unionByName(more), "simhash-crowded") if crowded else more
        hit = pin((hit.unionByName(new) if hit else new).distinct(), "simhash-hit")
        each = texts_of(docs, hit).mapInArrow(lean(run), "id long, k long, late boolean").join(crowded.withColumn("_c", F.lit(True)), "k", "left")
        # One row a text, as long as the text itself. Hashes are ordered without sign, as prefix() has it.
        rank = F.struct(F.col("_c").isNotNull().alias("crowded"), "late", F.expr("k ^ (-9223372036854775807L - 1)").alias("u"), "k")
        whole = each.groupBy("id").agg(F.array_sort(F.collect_list(rank)).alias("all")).withColumn("n", F.size("all"))
        first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
        again = whole.select("id", "n", placed(F.transform(F.slice("all", F.lit(1), first), lambda s: s["k"])))
        rest = nodes.join(hit, "id", "left_anti").select("id", "n", placed(F.col("prefix")))
        cells = pin(labelled(shared_cells(rest.unionByName(again), "simhash-refined"), labels, held), "simhash-labelled")
    return cells


def similar_sets(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """id (of the text), first (its smallest doc_id) and label of each different text: equal labels for those that links connect. A link is a pair whose sets of shingles have the Jaccard similarity."""
    last = frequent(docs, size)
    nodes = set_nodes(docs, size, similarity, last)
    cells = shared_cells(nodes.select("id", "n", placed(F.col("prefix"))), "simhash-cells")
    stars = alike(docs, plausible(star_pairs(cells, F.lit(True)), nodes, similarity), size, similarity)
    labels = components(stars, "simhash-stars")
    labels = by_hubs(docs, nodes, cells, labels, size, similarity)
    held, labels = by_centres(docs, nodes, cells, labels, size, similarity, last)
    cells = dissolved(docs, nodes, cells, labels, held, size, similarity, last)
    met = pairs_across(cells, lambda x, y: meeting(x, y, similarity)).unionByName(pairs_held(held, labels, similarity))
    pairs = alike(docs, plausible(met, nodes, similarity), size, similarity)
    labels = relabelled(labels, pairs, "simhash-joined").withColumnRenamed("node", "id")
    # Sets of nothing are alike and in no cell: they take the empty text's label.
    own = F.when(F.col("n") == 0, F.xxhash64(F.lit("").cast("binary"))).otherwise(F.col("id"))
    return nodes.select("id", "first", "n").join(labels, "id", "left").select("id", "first", F.coalesce("label", own).alias("label"))


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates (sets of five-word shingles of the similarity), the one with the smallest doc_id; of rows that share it, one. Groups without any doc_id keep one row too."""
    head = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "id")).alias("h")
    stays = similar_sets(docs.select("doc_id", "text"), 5, similarity).groupBy("label").agg(head).select("h.first", "h.id")
    stays = pin(stays, "simhash-stays")
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(utf8("text")).alias("_text"))
    kept = rows.join(stays, (F.col("_text") == F.col("id")) & F.col("_own").eqNullSafe(F.col("first")))
    again = docs.groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_again")
    if not again.limit(1).count():
        return kept.select("row.*")
    known = F.col("_own").eqNullSafe(F.col("_again"))
    one = kept.join(again, known, "left_semi").groupBy("_own", "_text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(again, known, "left_anti").select("row.*").unionByName(one.select("row.*"))
