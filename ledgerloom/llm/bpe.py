"""BPE encoding and decoding over a table of distinct words.

Texts are split once into words, which the tokenizer encodes independently. Documents
are gathered in blocks; a block numbers its different words, and keeps of its documents
the word's number at each position. These, and the blocks' words dealt by a hash into
buckets, are written to the shared folder, as a table in buckets by block. In a bucket each distinct word is encoded once,
however many blocks ask for it (a task keeps CACHE words at a time), and the word table's
part that a block needs goes back to it, where ids are joined to positions by the words'
numbers. So what is shuffled is each block's different words, their ids and numbers, and no
text. There is a row for each block and bucket that has one of its words; blocks are large
(BLOCK) so that these rows are.

Decoding joins the table of pieces, one for each id of the vocabulary, and puts the pieces
at the documents' ids together. The table is broadcast: the vocabulary bounds it.

Tasks hold one block at a time, and a text of any length. Null texts count as empty; empty
texts have no ids. Repeated rows, null and equal keys are each kept. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import bound_batches, lean, packed, pin_buckets, read, trim, utf8
from .words import Encoded, splitter

#: Bytes of text and different words after which a block ends.
BLOCK, WORDS = 16 << 20, 300_000
#: Bytes of text in one row of a block.
ROW = 2 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, byte by byte of all, compressed."""
    import zstandard

    flat = np.concatenate([np.array([*map(len, arrays)], "<u4"), *(np.asarray(a, "<u4") for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    flat = np.ascontiguousarray(flat.T).reshape(-1).view("<u4")
    ends = np.cumsum([n, *flat[:n].astype(np.int64)])
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _packed_strings(items: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items))


def _strings(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)]) + 4 + 4 * n
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def placed(left: pa.Table, right: pa.Table, key: str) -> pa.Table:
    """Joins ids back by the words' numbers, in the order of positions. left: a block's documents, right: its words' ids. A batch goes on for each row of documents, so that neither the worker nor the JVM holds a block's ids as one piece. The worker's tokenizer has no more to do."""
    if splitter.cache_info().currsize:
        splitter.cache_clear()
        trim()
    parts = [_unpacked(d.as_py(), 3) for d in right["ids"]]
    empty = [np.zeros(0, "<u4")]
    numbers, many, flat = (np.concatenate([p[i] for p in parts] or empty) for i in range(3))
    del parts
    many, flat = many.astype(np.int64), flat.view(np.int32)
    start, length = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    start[numbers], length[numbers] = np.cumsum(many) - many, many
    schema, out = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))]), []
    for keys, data in zip(left["keys"], left["data"], strict=True):
        words, at = _unpacked(data.as_py(), 2) if len(keys) else empty * 2
        n = length[at]
        after = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[at] - after[:-1], n) + np.arange(after[-1])]
        # Lists of 32-bit offsets hold up to 2^31 ids; a row has fewer.
        ends = after[np.concatenate([[0], np.cumsum(words, dtype=np.int64)])]
        out.append(pa.record_batch([keys.values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], schema=schema))
    trim()
    return pa.Table.from_batches(out, schema)


MADE = "block long, bucket int, keys array<long>, data binary, words binary"


def encode(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and ids, an array of int, of each row."""
    spark = df.sparkSession
    bound_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias(key), utf8(column).alias("_bytes"))
    names = [c.split()[0] for c in MADE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def made(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (keys; their numbers of words, and the words' numbers in the block) and, for each block, rows of its words (their numbers, and the words)."""
        s, base = splitter(path), TaskContext.get().partitionId() << 24
        block, held, size, numbers = 0, 0, 0, Numbers()
        keys: list[int | None] = []
        at: list[np.ndarray] = []

        def documents() -> pa.RecordBatch:
            return made([base | block], [None], [keys], [_packed(np.array([*map(len, at)]), *([np.concatenate(at)] if at else []))], [None])

        def table() -> Iterator[pa.RecordBatch]:
            dealt: list[list[tuple[int, bytes]]] = [[] for _ in range(buckets)]
            for n, w in enumerate(map(str.encode, numbers)):
                dealt[zlib.crc32(w) % buckets].append((n, w))
            for b, words in enumerate(dealt):
                if words:
                    yield made([base | block], [b], [None], [_packed(np.array([n for n, _ in words]))], [_packed_strings([w for _, w in words])])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_buffer().to_pybytes()
                words = s.words(t.decode())
                keys.append(k)
                at.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
                size += len(t) + 16
                if size >= ROW:
                    yield documents()
                    held, size, keys, at = held + size, 0, [], []
                    if held >= BLOCK or len(numbers) >= WORDS:
                        yield from table()
                        block, held, numbers = block + 1, 0, Numbers()
        if keys:
            yield documents()
        if numbers:
            yield from table()

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word table's part that each block asks for: the words' numbers there, how many ids each has, and the ids."""
        known = Encoded(splitter(path))
        for b in batches:
            for block, numbers, words in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ids = [known.ids([w.decode()]) for w in _strings(words.as_py())]
                flat = np.frombuffer(b"".join(ids), "<u4")
                data = _packed(*_unpacked(numbers.as_py(), 1), np.array([len(x) // 4 for x in ids]), flat)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([data], pa.binary())], ["block", "ids"])

    # In buckets by block: documents' positions are stored once, and not shuffled.
    split_once = pin_buckets(rows.mapInArrow(lean(split), MADE), "bpe-blocks", "block", buckets)
    asked = split_once.filter("bucket IS NOT NULL").select("block", "data", "words", "bucket").repartition(buckets, "bucket")
    parts = asked.select("block", "data", "words").mapInArrow(lean(table), "block long, ids binary")
    texts = split_once.filter("bucket IS NULL").select("block", "keys", "data")
    return texts.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(lambda left, right: placed(left, right, key), f"{key} long, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row: the pieces' bytes in hexadecimal digits, in the order of ids. Its size is the vocabulary's."""
    # From Arrow, which Spark keeps in the plan: of Python rows, workers on all executors would make it.
    return spark.createDataFrame(pa.table({"_known": [True], "_pieces": [[p.hex() for p in splitter(path).pieces()]]}))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids; a column of this name is replaced. Each document joins the table of pieces, and each of its ids the piece at its place; ids that the vocabulary lacks have none, null ids no text. Bytes that are no UTF-8 become U+FFFD."""
    rows = df.select(packed(df, ("decoded",)), F.isnotnull(ids).alias("_known"))
    joined = rows.join(F.broadcast(pieces(df.sparkSession, path)), "_known", "left")
    text = F.array_join(F.transform(F.col(f"row.{ids}"), lambda i: F.get("_pieces", i)), "")
    return joined.select("row.*", F.make_valid_utf8(F.unhex(text).cast("string")).alias("decoded"))


def document_ids(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    path = tokenizer_path(tokenizer)
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return digests(decode(coded, path))


def digests(decoded: DataFrame) -> DataFrame:
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
