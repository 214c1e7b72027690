"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become FEATURES numbers, numbers become bins. The model is a sum of lookup tables,
one over the bins of each feature and one over the bins of each of a few pairs of
features. The tables are learned by boosting in turns: each round fits a shallow tree
(up to four leaves) to the gradient of the logistic loss over one table's bins and adds
it to the table, feature after feature; the pairs whose tables would lower the loss most
are then boosted in the same way. Scoring adds up bins, for a batch of rows at a time.

Labels come from a sample of at most SAMPLE labelled rows, those with the smallest hash
of doc_id, so it is the same on every run; all rows are scored. Only the sample's feature
numbers go to the driver.

Nulls and empty texts score like a text without words. Labels other than 0 and 1 are
ignored; of a doc_id's several labels the larger counts. Without labels of both kinds the
score is the share of ones, smoothed, for all rows. Repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, lean, packed, read, utf8

#: Labelled rows that are used at most.
SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 60, 8, 30, 0.15
THRESHOLD = 0.7

# Frequent short words of the corpus's languages.
COMMON = {
    w.encode()
    for w in (
        "the of and to in a is that it for was on are with as be by this from "
        "de la le et les des un une du en que est pour dans qui sur par au "
        "der die das und ist den von zu mit ein dem nicht sich auch für als "
        "el los las y del por con una no se es para su al"
    ).split()
}
MARKS = b"!?.,;:'\"|#$%&*@<>{}[]()=+_/\\~^-"
FEATURES = ("bytes", "words", "upper", "digit", "space", "line", "high", "entropy", "word_length", "distinct", "repeated", "common", "short", "marked", "inner_case", "line_length", "same_lines", "longest", *(f"mark_{chr(c)}" for c in MARKS))


def features(text: bytes) -> list[float]:
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    share = seen[seen > 0] / n
    kinds = set(words)
    known = sum(w in COMMON for w in map(bytes.lower, words))
    lengths = list(map(len, words))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        upper / max(1, upper + lower),
        seen[48:58].sum() / n,
        (seen[32] + seen[9:14].sum()) / n,
        seen[10] / m,
        seen[128:].sum() / n,
        float(-(share * np.log2(share)).sum()),
        sum(lengths) / m,
        len(kinds) / m,
        sum(map(eq, words, words[1:])) / m,
        known / m,
        sum(x <= 3 for x in lengths) / m,
        sum(1 for w in words if not w.isalpha()) / m,
        sum(1 for w in words if w.isupper()) / m,
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log1p(max(lengths, default=0)),
        *(seen[list(MARKS)] / m),
    ]


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.tables is not None and len(x):
            b = self.bins(x)
            total += self.tables[np.arange(b.shape[1]), b].sum(1)
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a row of bins, and the first bin on its right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < 1) | (hr < 1)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree with up to four leaves over bins in order."""
    cuts = {0, len(g)}
    gain, k = _split(g, h)
    if gain > 0:
        cuts.add(k)
        for lo, hi in ((0, k), (k, len(g))):
            inner, at = _split(g[lo:hi], h[lo:hi])
            if inner > 0:
                cuts.add(lo + at)
    out, at = np.zeros(len(g)), sorted(cuts)
    for lo, hi in zip(at, at[1:], strict=False):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts the rows of a grid and then the columns of both parts."""
    best, steps = 0.0, np.zeros_like(g)
    rows_g, rows_h = np.cumsum(g, 0), np.cumsum(h, 0)
    for k in range(1, len(g)):
        gain, made = 0.0, np.zeros_like(g)
        for part, gg, hh in ((slice(0, k), rows_g[k - 1], rows_h[k - 1]), (slice(k, None), rows_g[-1] - rows_g[k - 1], rows_h[-1] - rows_h[k - 1])):
            _, at = _split(gg, hh)
            for cols in (slice(0, at), slice(at, None)):
                a, b = gg[cols].sum(), hh[cols].sum()
                gain += a * a / (b + 1)
                made[part, cols] = -a / (b + 1)
        if gain > best:
            best, steps = gain, made
    return best, steps


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n, ones = len(y), float(y.sum())
    model = Model(base=float(np.log((ones + 1) / (n - ones + 1))))
    if not 0 < ones < n:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b, d = model.bins(x), x.shape[1]
    model.tables, total = np.zeros((d, BINS)), np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS))
            model.tables[j] += step
            total += step[b[:, j]]
    g, h = slopes()
    grid = lambda i, j, v: np.bincount(b[:, i] * BINS + b[:, j], v, BINS * BINS).reshape(BINS, BINS)
    strong = np.argsort(-model.tables.std(1))[:12].tolist()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in strong for j in strong if i < j), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            total += step[b[:, i], b[:, j]]
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(t.as_buffer().to_pybytes()) for t in column], dtype=np.float64).reshape(-1, len(FEATURES))


def _fold():
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, quality. Rows of fold 2 are held out."""
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(_matrix(b.column(2)).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), x], ["doc_id", "quality", "x"])

    # `known` has `sample` rows at most.
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "quality", utf8().alias("_bytes")).mapInArrow(lean(run), "doc_id long, quality int, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("r.*", "doc_id").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got["quality"].to_pylist(), dtype=np.float64))


def score(docs: DataFrame, model: Model, without: tuple[str, ...] = ()) -> DataFrame:
    """row, all columns but those named as a struct, and score."""
    bound_batches(docs.sparkSession)
    rows = docs.select(packed(docs, without), utf8().alias("_bytes"))
    schema = rows.select("row").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["row", "score"])

    return rows.mapInArrow(lean(run), schema)


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, ("text",)).select("row.doc_id", "score").select("doc_id", (_fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Rows that the classifier accepts."""
    return score(docs, model).filter(F.col("score") >= THRESHOLD).select("row.*")
