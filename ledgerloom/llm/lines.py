"""Line dedup over sharded minimal perfect hashes of line hashes.

Texts are gathered in blocks, which are written to the shared folder with each block's
distinct line hashes (128 bits of the line's key), the smallest and the largest doc_id of the
block that has the line, and how many documents do. A line that every document has is thus
one row a block and not one a document. Hashes are counted over blocks and dealt into
shards; a shard's distinct hashes get a minimal perfect hash: levels of bit arrays, where a
hash that has a bit of its level for itself is numbered by the set bits before it, and the
others go to the next level. By these numbers a shard holds arrays of fingerprints (32 bits),
counts (a byte, up to 255) and, where a line is in several documents, the smallest doc_id.

Blocks probe the arrays with their hashes: a shard's arrays and the hashes that ask for it
meet in one task, arrays first, and the hashes stream by. What goes back to a block are the
lines that it has to drop from at least one document. Texts and these stream through a task
sorted by block, so a task holds one shard or one block's drops at a time.

Null and empty texts are one empty line, which is too short to drop. A line is dropped from
every document but that with the smallest doc_id, where all its repetitions stay. Rows with
equal doc_ids are the same document, each of which keeps or drops a line alike; a null doc_id
is one document that comes after all others. A text of any length is in one block. Two
lines whose keys differ and whose 128 bits agree would be taken for the same. Columns besides
doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, lean, pin, read, utf8

#: Bytes of text after which a block ends; distinct hashes of a shard, about.
BLOCK, SHARD = 16 << 20, 100_000
#: Bits of a level for each hash that is left.
SPREAD = 2
#: Code points that a key needs.
LEAST = 10
WHITE = b" \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1


def line_hashes(text: bytes) -> list[bytes | None]:
    """For each line the 128 bits of its key, none if the key is shorter than LEAST code points."""
    from xxhash import xxh3_128_digest

    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # of bytes, lower() is that of A-Z
        key = line.strip(WHITE)
        n = len(key)
        # A code point has four bytes at most.
        long = n >= LEAST and (n >= 4 * LEAST or key.isascii() or len(key.decode()) >= LEAST)
        out.append(xxh3_128_digest(key) if long else None)
    return out


def _number(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit, of `size`, that a hash asks for in a level."""
    x = lo.view(np.uint64) ^ (hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class Perfect:
    """A minimal perfect hash of distinct pairs of 64-bit numbers: each has its own number of 0 to n - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Perfect:
        sizes, bits = [], [np.zeros(0, np.uint8)]
        while len(hi):
            size = -(-max(64, SPREAD * len(hi)) // 8) * 8
            at = _number(hi, lo, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone.astype(np.uint8))
            hi, lo = hi[~alone[at]], lo[~alone[at]]
        return cls(sizes, np.concatenate(bits))

    @classmethod
    def load(cls, sizes: list[int], packed: bytes) -> Perfect:
        return cls(sizes, np.unpackbits(np.frombuffer(packed, np.uint8))[: sum(sizes)])

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Of each pair; some number or -1 for pairs that it was not built of."""
        out, left, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = base + _number(hi[left], lo[left], level, size)
            here = self.bits[at] == 1
            out[left[here]] = self.before[at[here]]
            left, base = left[~here], base + size
        return out


def fingerprints(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return ((hi.view(np.uint64) ^ (lo.view(np.uint64) >> np.uint64(7))) & np.uint64(0xFFFFFFFF)).astype("<u4")


HELD = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("text", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64())])
HELD_SQL = "block long, doc long, text binary, hi long, lo long, first long, last long, docs long"


def blocks(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Rows of texts (block, doc, text) and of each block's distinct line hashes (block, hi, lo, first, last, docs)."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("doc"), utf8(column).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, size = TaskContext.get().partitionId() << 24, 0, 0
        seen: dict[bytes, list[int]] = {}

        def lines() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
            docs = np.array(list(seen.values()), np.int64).reshape(-1, 3)
            none = pa.nulls(len(flat))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), base | n)), none.cast(pa.int64()), none.cast(pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in (flat[:, 0], flat[:, 1], docs[:, 0], docs[:, 1], docs[:, 2]))], schema=HELD)

        for b in batches:
            # A batch is in one block: BATCH_BYTES and a text more, at most.
            nothing = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, base | n)), b.column(0), b.column(1), *[nothing] * 5], schema=HELD)
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_buffer().to_pybytes()
                size += len(raw)
                doc = LAST_ID if doc is None else doc
                for h in {*line_hashes(raw)}:
                    if h is None:
                        continue
                    if (was := seen.get(h)) is None:
                        seen[h] = [doc, doc, 1]
                    else:
                        was[:] = min(was[0], doc), max(was[1], doc), was[2] + 1
            if size >= BLOCK:
                yield lines()
                n, size = n + 1, 0
                seen.clear()
        if seen:
            yield lines()

    return rows.mapInArrow(lean(gather), HELD_SQL)


INDEX = "shard long, sizes array<long>, bits binary, marks binary, counts binary, firsts binary"


def index(lines: DataFrame) -> tuple[DataFrame, int]:
    """The shards' arrays over all distinct hashes, and how many shards there are."""
    counts = pin(lines.groupBy("hi", "lo").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("docs").alias("docs")), "line-counts")
    shards = max(1, math.ceil(counts.count() / SHARD))

    def build(t: pa.Table) -> pa.Table:
        hi, lo, first, last, docs = (t[c].to_numpy() for c in ("hi", "lo", "first", "last", "docs"))
        hash_ = Perfect.of(hi, lo)
        place = hash_.numbers(hi, lo)
        count = np.zeros(len(hi), np.uint8)
        count[place] = np.where(first < last, np.clip(docs, 2, 255), 1)
        marks, least = np.zeros(len(hi), "<u4"), np.zeros(len(hi), "<i8")
        marks[place], least[place] = fingerprints(hi, lo), first
        row = {"shard": t["shard"][:1], "sizes": pa.array([hash_.sizes], pa.list_(pa.int64()))}
        row |= {k: pa.array([v], pa.binary()) for k, v in (("bits", hash_.packed()), ("marks", marks.tobytes()), ("counts", count.tobytes()), ("firsts", least[count > 1].tobytes()))}
        return pa.table(row)

    dealt = counts.withColumn("shard", F.pmod("hi", F.lit(shards)))
    return pin(dealt.groupBy("shard").applyInArrow(build, INDEX), "line-index"), shards


def probed(lines: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """block, hi, lo and first of each line of a block that another document has and that is not the block's alone to keep."""
    asks = lines.select("hi", "lo", "block", "last", F.pmod("hi", F.lit(shards)).alias("shard"))
    both = held.unionByName(asks, allowMissingColumns=True).withColumn("ask", F.col("block").isNotNull())
    near = both.repartition("shard").sortWithinPartitions("shard", "ask")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asking = b["ask"].to_numpy(zero_copy_only=False)
            for start, end in _runs(np.stack([b["shard"].to_numpy(), asking])):
                some = b.slice(start, end - start)
                if not asking[start]:
                    (row,) = some.select(["sizes", "bits", "marks", "counts", "firsts"]).to_pylist()
                    hash_ = Perfect.load(row["sizes"], row["bits"])
                    marks, count = np.frombuffer(row["marks"], "<u4"), np.frombuffer(row["counts"], np.uint8)
                    firsts, rank = np.frombuffer(row["firsts"], "<i8"), np.cumsum(count > 1) - 1
                    continue
                hi, lo, last = (some[c].to_numpy() for c in ("hi", "lo", "last"))
                at = hash_.numbers(hi, lo)
                hit = (at >= 0) & (marks[at] == fingerprints(hi, lo)) & (count[at] > 1)
                first = firsts[rank[at[hit]]]
                gone = last[hit] > first
                yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (some["block"].to_numpy()[hit], hi[hit], lo[hit], first)], ["block", "hi", "lo", "first"])

    return near.mapInArrow(lean(probe), "block long, hi long, lo long, first long")


def _runs(columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of equal columns."""
    cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
    ends = [0, *cuts.tolist(), columns.shape[1]]
    return ((a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b)


def drop_repeated(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_lines, n_dropped and kept, the text of the lines that stay."""
    held = pin(blocks(df, key, column), "line-blocks")
    lines = held.filter("hi IS NOT NULL").select("block", "hi", "lo", "first", "last", "docs")
    arrays, shards = index(lines)
    drops = probed(lines, arrays, shards)
    texts = held.filter("hi IS NULL").select("block", "doc", "text")
    both = texts.unionByName(drops, allowMissingColumns=True).withColumn("body", F.col("text").isNotNull())
    near = both.repartition("block").sortWithinPartitions("block", "body")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gone = None, {}
        for b in batches:
            body = b["body"].to_numpy(zero_copy_only=False)
            ids = b["block"].to_numpy()
            for start, end in _runs(np.stack([ids, body])):
                if ids[start] != block:
                    block, gone = ids[start], {}
                some = b.slice(start, end - start)
                if not body[start]:
                    pairs = np.stack([some["hi"].to_numpy(), some["lo"].to_numpy()], axis=1).astype("<i8").tobytes()
                    gone |= {pairs[16 * i : 16 * i + 16]: f for i, f in enumerate(some["first"].to_pylist())}
                    continue
                docs, out = some["doc"].to_pylist(), []
                for doc, t in zip(docs, some["text"], strict=True):
                    raw = t.as_buffer().to_pybytes()
                    at = LAST_ID if doc is None else doc
                    split = raw.split(b"\n")
                    stay = [x for x, h in zip(split, line_hashes(raw), strict=True) if h is None or gone.get(h, at) == at]
                    out.append((len(split), len(split) - len(stay), b"\n".join(stay).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], [key, "n_lines", "n_dropped", "kept"])

    return near.mapInArrow(lean(apply), f"`{key}` long, n_lines long, n_dropped long, kept string")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    return r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM t),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(m.first <> k.doc_id, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1"""
