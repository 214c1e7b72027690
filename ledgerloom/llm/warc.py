r"""A content-addressed WARC archive.

`write` makes two tables in a folder. `payloads` holds the bytes of each distinct payload
once, under its SHA-256; `headers` holds each record's header block to the byte, with
the digest that its payload is stored under. A digest stands for one payload only if all
rows under it agree in length, SHA-1 and XXH64, which is verified while writing. Of
records with equal payloads the one with the largest page_id is the response, the others
are revisits of it; payloads of under `least` bytes are all responses. Both tables are
bucketed by digest, so that joining them moves no payload.

`records` joins headers and payloads back into the original records: header block, the
payload's bytes if it is a response, and the two line ends. `parsed` reads those bytes:
it cuts a record after its header block, holds the body against the header's length and
digest, and fails if they differ. What a revisit says of its payload is taken from the
response that it refers to.

Null html is empty. Null urls are left out of the header; of others all but printable
ASCII is percent-encoded, so no url can end a line. Null page_ids are the smallest.
Rows that share page_id and payload: one of them is a response for each, as they can't be
told apart; the others refer to that id. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, read

END = "\r\n"
#: Date of all records; the tables hold none.
DATE = "2024-01-01T00:00:00Z"


def base32(hex40: Column) -> Column:
    """Upper-case base 32 of 40 hex digits: ten digits are 40 bits, eight digits of base 32."""
    parts = (F.lpad(F.conv(F.substring(hex40, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4))
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def safe(url: Column) -> Column:
    """The url with all but printable ASCII percent-encoded. url_encode takes more than is needed, so it is used on the rest alone."""
    parts = F.regexp_extract_all(url, F.lit(r"([\x21-\x7e]+|[^\x21-\x7e]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^[\x21-\x7e]"), p).otherwise(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))), "")


def header(kind: Column, page: Column, url: Column, sha1: Column, length: Column, refers: Column) -> Column:
    """The header block of a record, its empty line included."""
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), safe(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(refers))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END)).cast("binary")


def stored(held: DataFrame) -> DataFrame:
    """One row for each payload (digest, payload, n). Fails if a digest doesn't stand for one payload alone; the check is part of the payload's value, so that no plan can leave it out."""
    same = (F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1")) & (F.min("other") == F.max("other"))
    checked = F.when(same, F.max("payload")).otherwise(F.raise_error(F.lit("two payloads under one digest")).cast("binary"))
    return held.groupBy("digest").agg(checked.alias("payload"), F.max("n").alias("n"))


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """pages: page_id, url, html."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    held = rows.withColumns({"sha1": F.sha1("payload"), "other": F.xxhash64("payload")})

    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _put(stored(held), f"{folder}/payloads", buckets)

    # Headers: digests only, never payloads, go by the shuffle.
    thin = held.select("page_id", "url", "digest", "n", "sha1")
    owners = thin.groupBy("digest").agg(F.max("page_id").alias("owner"))
    named = thin.join(owners, "digest")
    first = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("n") < least)
    kind, refers = F.when(first, "response").otherwise("revisit"), F.when(~first, F.col("owner"))
    block = header(kind, F.col("page_id"), F.col("url"), base32(F.col("sha1")), F.col("n"), refers)
    _put(named.select("page_id", "digest", block.alias("header")), f"{folder}/headers", buckets)


def _put(df: DataFrame, folder: str, buckets: int) -> None:
    """Writes df in buckets by digest."""
    name = "warc_" + uuid.uuid4().hex
    df.write.bucketBy(buckets, "digest").option("compression", "zstd").option("path", f"{folder}/{buckets}").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def _get(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """A bucketed table of this folder, as a table of the session, so that joins know of the buckets."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(conf).listStatus(at)[0].getPath()
    name = "warc_" + uuid.uuid5(uuid.NAMESPACE_URL, found.toString()).hex
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (digest) INTO {found.getName()} BUCKETS LOCATION '{found.toString()}'")
    return spark.table(name)


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    return _get(spark, f"{folder}/payloads", "digest string, payload binary, n long")


def headers(spark: SparkSession, folder: str) -> DataFrame:
    return _get(spark, f"{folder}/headers", "page_id long, digest string, header binary")


def field(block: Column, name: str) -> Column:
    """A header's field; lines end at a line feed alone."""
    return F.nullif(F.regexp_extract(block.cast("string"), f"(?md)^{name}: (.*?)\r?$", 1), F.lit(""))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and record, the original bytes of each record, and the digest that its payload is stored under."""
    joined = headers(spark, folder).join(payloads(spark, folder), "digest")
    body = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat("header", body, F.lit(f"{END}{END}").cast("binary")).alias("record"), "digest")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive's records say, read from their bytes."""
    cut = F.instr(F.col("record").cast("string"), END + END) + 3  # header blocks are ASCII: characters are bytes
    split = records(spark, folder).select("digest", F.substring("record", F.lit(1), cut).alias("block"), F.substring("record", cut + 1, F.octet_length("record") - cut - 4).alias("body"))
    block, said = F.col("block"), field(F.col("block"), "WARC-Payload-Digest")
    page = lambda name: F.nullif(F.regexp_extract(field(block, name), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    kind, length, own = field(block, "WARC-Type"), F.octet_length("body").cast("long"), base32(F.sha1("body"))
    fits = (length == field(block, "Content-Length").cast("long")) & ((kind == "revisit") | (said == F.concat(F.lit("sha1:"), own)))
    whole = F.when(fits, length).otherwise(F.raise_error(F.lit("the archive is damaged")).cast("long"))
    read_ = split.select("digest", page("WARC-Record-ID").alias("page_id"), kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"), F.substring(said, 6, 32).alias("payload_digest"), whole.alias("n"))
    # Of each payload, the response's length; a window over thin rows in the buckets that they lie in.
    n = F.max(F.when(F.col("record_type") == "response", F.col("n"))).over(Window.partitionBy("digest"))
    return read_.withColumn("payload_bytes", n).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return parsed(spark, folder)
