"""Token ids in files of bit planes.

`write` encodes documents in ascending doc_id order (ties by their text's CRC-32, then
the text; nulls first) and stores the ids in chunks of CHUNK ids. A chunk's ids are
transposed into planes, plane k holding bit k of every id (or byte k, with
planes="byte"); each plane is compressed with zstandard on its own. A chunk's row holds
the planes one after another, an index of where each ends, and which documents have ids
in it: their number in the part, doc_id, start, length, and the run of ids here. Parts
are ranges of doc_id, so part by part and chunk by chunk the files hold all ids in order.
Texts are encoded by BLOCK bytes, each different piece between white space once.

`read_documents` decodes chunks where they lie, in any order, and takes the CRC-32 of each
run; runs of one document are put together by the CRC of joined strings.

Null and empty texts have the end id alone. Rows with equal doc_id are each stored.
Ids must be below 2^32. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .shared import bound_batches, lean, new_path, read, utf8
from .words import Encoded, splitter

CHUNK = 1 << 16
#: Bytes of text whose words are looked up together; a longer text goes by itself.
BLOCK = 8 << 20
END = 2
INDEX = ("number", "doc_id", "start", "n", "run")
CHUNKS = "part int, chunk int, n_ids int, planes string, ends array<int>, data binary, " + ", ".join(f"{c} array<long>" for c in INDEX)


def to_planes(ids: np.ndarray, planes: str = "bit") -> tuple[list[int], bytes]:
    """Where each plane ends, and the compressed planes."""
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    wide = max(1, -(-top // 8))
    raw = ids.view(np.uint8).reshape(-1, 4)[:, :wide]
    if planes == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : max(1, top)]
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(raw.T)
    pack = zstandard.ZstdCompressor(level=1)
    parts = [pack.compress(p.tobytes()) for p in raw]
    return np.cumsum(list(map(len, parts))).tolist(), b"".join(parts)


def from_planes(n: int, ends: list[int], data: bytes, planes: str = "bit") -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    rows = (np.frombuffer(unpack.decompress(data[a:b]), np.uint8) for a, b in zip([0, *ends], ends, strict=False))
    out = np.zeros((4, n), np.uint8)
    for k, row in enumerate(rows):
        if planes == "bit":
            out[k // 8] |= np.unpackbits(row, count=n, bitorder="little") << (k % 8)
        else:
            out[k] = row
    out = np.ascontiguousarray(out.T)
    return out.reshape(-1).view("<u4")


def join_crc(first: int, second: int, n: int) -> int:
    """CRC-32 of two strings one after the other, of theirs and the second's length."""
    step = bytes(1 << 16)
    zero = 0
    while n:
        k = min(n, len(step))
        first, zero, n = zlib.crc32(step[:k], first), zlib.crc32(step[:k], zero), n - k
    return first ^ zero ^ second


def write(df: DataFrame, folder: str, path: str, planes: str = "bit", block_bytes: int = BLOCK) -> None:
    """df: doc_id, text."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_bytes")).withColumn("_crc", F.crc32("_bytes"))
    rows = rows.repartitionByRange("doc_id", "_crc").sortWithinPartitions("doc_id", "_crc", "_bytes")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        known = Encoded(splitter(path))
        end = np.array([END], "<u4")
        keys, texts, held = [], [], 0

        def block() -> Iterator[tuple[int | None, np.ndarray]]:
            for key, ids in zip(keys, known.texts(texts), strict=True):
                yield key, np.concatenate((ids, end))

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                size = t.as_buffer().size
                if texts and held + size > block_bytes:
                    yield from block()
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(t.as_buffer().to_pybytes().decode())
                held += size
        if texts:
            yield from block()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, number, total = TaskContext.get().partitionId(), 0, 0, 0
        ids, runs, free = [], [], CHUNK

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            ends, data = to_planes(flat, planes)
            index = [pa.array([list(c)], pa.list_(pa.int64())) for c in zip(*runs, strict=True)]
            head = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(flat)], pa.int32()), pa.array([planes]), pa.array([ends], pa.list_(pa.int32())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays([*head, *index], [c.split()[0] for c in CHUNKS.split(", ")])

        for key, own in coded(batches):
            at = 0
            while at < len(own):
                take = own[at : at + free]
                ids.append(take)
                runs.append((number, key, total, len(own), len(take)))
                at, free = at + len(take), free - len(take)
                if not free:
                    yield row()
                    chunk, ids, runs, free = chunk + 1, [], [], CHUNK
            number, total = number + 1, total + len(own)
        if ids:
            yield row()

    rows.select("doc_id", "_bytes").mapInArrow(lean(run), CHUNKS).write.option("compression", "none").parquet(folder)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files."""
    bound_batches(spark)
    stored = chunks(spark, folder)
    # One number for each part; parts are as many as the writing job's tasks.
    sizes = sorted(tuple(r) for r in stored.groupBy("part").agg(F.sum("n_ids").cast("long").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before long")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "chunk", "number", "doc_id", "start", "n", "run", "crc"]
        for b in batches:
            cols = [[] for _ in names]
            for r in b.to_pylist():
                ids = from_planes(r["n_ids"], r["ends"], r["data"], r["planes"])
                at = np.cumsum([0, *r["run"]]).tolist()
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(at, at[1:], strict=False)]
                k = len(crcs)
                for c, own in zip(cols, [[r["part"]] * k, [r["chunk"]] * k, r["number"], r["doc_id"], r["start"], r["n"], r["run"], crcs], strict=True):
                    c += own
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    found = stored.mapInArrow(lean(runs), "part long, chunk long, number long, doc_id long, start long, n long, run long, crc long")
    # A document's runs are as many as the chunks that it reaches over.
    each = found.groupBy("part", "number", "doc_id", "start", "n").agg(F.array_sort(F.collect_list(F.struct("chunk", "run", "crc"))).alias("runs"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rs in b.column(4).to_pylist():
                crc = rs[0]["crc"]
                for r in rs[1:]:
                    crc = join_crc(crc, r["crc"], 4 * r["run"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    whole = each.select(F.col("part").cast("int"), "doc_id", "start", "n", "runs").mapInArrow(lean(joined), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def document_file(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    folder = new_path(spark, "token-file")
    write(read(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path(tokenizer))
    return read_documents(spark, folder)
