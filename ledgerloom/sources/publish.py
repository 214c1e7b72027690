"""Sinks: publication that is staged, verified and never overwrites; manifests; read-back checks; delimited outputs and documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import csv_records


#: How a null is written, so that empty texts stay texts. A text that is this one can't be told from null: its publication fails.
NULL = "\\N"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows as a multiset, whatever their order and partitions."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    # Sums of two independent halves, so that repeated rows count.
    halves = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("a"), F.sum(F.shiftrightunsigned("h", 32)).alias("b")).first()
    return f"{halves['n']}-{halves['a'] or 0:x}-{halves['b'] or 0:x}"


def publish(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Writes the tables beside path, reads them back, and renames the folder to path if all agree. An existing path is refused."""
    spark = next(iter(tables.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    manifest = {}
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{staged}/{name}")
            manifest[name] = fingerprint(df)
            if fingerprint(spark.read.parquet(f"{staged}/{name}")) != manifest[name]:
                raise ValueError(f"{name} differs after it was written")
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{staged}/manifest")
        if not fs.rename(_fs(spark, staged)[1], target):
            raise FileExistsError(path)
    finally:
        fs.delete(_fs(spark, staged)[1], True)
    return manifest


def verify(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether each table of a publication still has the rows that its manifest tells."""
    told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: fingerprint(spark.read.parquet(f"{path}/{name}")) == mark for name, mark in told.items()}


def write_json(spark: SparkSession, path: str, value) -> None:
    """Writes a document beside path and puts it there in one step, in place of what was there: readers see the old or the new one, whole."""
    fs, target = _fs(spark, path)
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    target = fs.makeQualified(target)
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1, allow_nan=False).encode()))
        finally:
            out.close()
        over = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(beside, target, over)
    finally:
        fs.delete(beside, False)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of the stored parts of a publication's outputs, digested where they lie."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/*.csv")
    return parts.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish_csv(outputs: dict[str, DataFrame], path: str, about: dict, invariants: dict[str, str] | None = None, rows_a_file: int = 1_000_000) -> dict:
    """Writes outputs as gzip CSV in files of rows_a_file rows at most, and commits them as one folder with a manifest.

    What is read back must have the rows that were written and meet the invariants (SQL
    conditions on each row, by name); ValueError tells what doesn't. An existing path is refused, and a
    publication that fails leaves nothing. Parts are listed with size and digest in a table of
    their own, which the manifest seals, so that the driver holds a line for each output only.
    An output without rows is a header. Values with line breaks are kept (quoted).
    """
    spark = next(iter(outputs.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    manifest = {"about": about, "outputs": {}}
    try:
        for name, df in outputs.items():
            df.write.mode("errorifexists").options(header=True, compression="gzip", maxRecordsPerFile=rows_a_file, escape='"', nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8").csv(f"{staged}/{name}.csv")
            back = csv_records(spark, f"{staged}/{name}.csv", df.schema, NULL)
            mark = fingerprint(df)
            if fingerprint(back) != mark:
                raise ValueError(f"{name} differs after it was written")
            rules = invariants or {}
            broken = back.agg(F.count(F.lit(1)), *(F.count_if(~F.coalesce(F.expr(c), F.lit(False))) for c in rules.values())).first()
            if bad := [f"{rule}: {n}" for rule, n in zip(rules, broken[1:], strict=True) if n]:
                raise ValueError(f"{name} breaks " + ", ".join(bad))
            manifest["outputs"][name] = {"rows": broken[0], "fingerprint": mark, "schema": df.schema.simpleString()}
        stored_files(spark, staged).write.json(f"{staged}/files")
        manifest["files"] = fingerprint(spark.read.schema("file string, bytes long, sha256 string").json(f"{staged}/files"))
        write_json(spark, f"{staged}/manifest.json", manifest)
        if faults := publication_faults(spark, staged).limit(5).collect():
            raise ValueError(f"files differ: {faults}")
        if fs.exists(target) or not fs.rename(_fs(spark, staged)[1], target):
            raise FileExistsError(path)
    finally:
        fs.delete(_fs(spark, staged)[1], True)
    return manifest


def publication_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, fault: parts that are missing, altered, or unknown to the list; no rows for a sound publication. A list that the manifest doesn't seal is refused."""
    told = spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/files")
    if fingerprint(told) != read_json(spark, f"{path}/manifest.json")["files"]:
        raise ValueError("the list of files isn't the manifest's")
    both = told.alias("t").join(stored_files(spark, path).alias("s"), F.col("t.file") == F.col("s.file"), "full_outer")
    same = (F.col("t.bytes") == F.col("s.bytes")) & (F.col("t.sha256") == F.col("s.sha256"))
    fault = F.when(F.col("s.file").isNull(), "missing").when(F.col("t.file").isNull(), "unknown").when(~same, "altered")
    return both.select(F.coalesce("t.file", "s.file").alias("file"), fault.alias("fault")).filter("fault is not null")


def differences(left: DataFrame, right: DataFrame, keys: list[str], rtol: float = 1e-12, atol: float = 0.0) -> DataFrame:
    """Cells in which two tables of one form differ: the keys, column, left and right as text; column '*' for rows of one side only.

    Numbers agree within atol + rtol * the larger size; nulls agree with nulls, NaN with NaN.
    Keys may hold nulls and must be unique on both sides. Tables with other columns are refused.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    kinds = dict(left.dtypes)
    both = left.withColumn("_in", F.lit(True)).alias("l").join(right.withColumn("_in", F.lit(True)).alias("r"), [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys], "full_outer")
    alone = F.col("l._in").isNull() | F.col("r._in").isNull()
    text = lambda c: c.cast("string")
    cells = [F.when(alone, F.struct(F.lit("*").alias("column"), F.when(F.col("l._in"), "row").alias("left"), F.when(F.col("r._in"), "row").alias("right")))]
    for c in (c for c in left.columns if c not in keys):
        a, b = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        same = a.eqNullSafe(b)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(a - b) <= atol + rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(False)) & ~F.isnan(a) & ~F.isnan(b)
        cells.append(F.when(~alone & ~same, F.struct(F.lit(c).alias("column"), text(a).alias("left"), text(b).alias("right"))))
    return both.select(*(F.when(F.col("l._in"), F.col(f"l.`{k}`")).otherwise(F.col(f"r.`{k}`")).alias(k) for k in keys), F.inline(F.array_compact(F.array(*cells))))
