"""Connected components of an entity graph, and balanced folds of whole groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: checkpointed in the folder of spark.checkpoint.dir. Where there is none, as in a session of one process, df as it is."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share; in a session of one process that has none, one of our own."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once, as a table in the shared folder, and read back; where there is no such folder, kept by the executors."""
    spark, base = df.sparkSession, _folder(df.sparkSession)
    if not base:
        return df.persist()
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component: the smallest node reachable over edges (a, b).

    The smallest label spreads over edges and then jumps to its own label's label, so the
    rounds are about the logarithm of the longest path. Each round is a table in the shared
    folder: a checkpoint would keep its plan's estimate of size, a product over joins whose
    digits grow fourfold a round. Joins are by sorting, as files say little of rows in memory.
    """
    spark = edges.sparkSession
    base = _folder(spark)

    def safe(df: DataFrame) -> DataFrame:
        return stored(df, "components")

    def gone(df: DataFrame) -> None:
        if not base:
            return
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    both = safe(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = safe(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    labels = held
    for _ in range(most):
        heard = both.join(labels.withColumnRenamed("node", "a").hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        spread = labels.join(heard.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        far = spread.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = safe(spread.join(far.hint("merge"), "component").select("node", "was", F.col("far").alias("component")))
        gone(held)
        held, labels = moved, moved.select("node", "component")
        if not moved.filter("component <> was").limit(1).count():
            gone(both)
            return labels
    raise RuntimeError("components didn't settle")


def family_links(rows: DataFrame, families: DataFrame, key: str, node: str) -> DataFrame:
    """Edges (a, b) between the nodes of records that are known to be one family: families holds pairs of keys (left, right). Pairs of which a record is missing link nothing."""
    side = lambda name, end: rows.select(F.col(key).alias(name), F.col(node).alias(end))
    return families.select("left", "right").join(side("left", "a"), "left").join(side("right", "b"), "right").select("a", "b").distinct()


def _turns(loads: list[int], size: int, n: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How n groups of one size go to the least loaded folds, one after another, and the loads after that.

    A fold takes its j-th group at load + j * size, so the groups go through all folds' loads in
    ascending order. These are levels of `size` above the smallest load: a fold takes part from
    the level that its load has reached, and within a level folds come in the order of what
    their load is above it. So between two such levels folds take turns, and a turn's order is
    told by its first group's rank.
    """
    low = min(loads)
    since, over = [(x - low) // size for x in loads], [(x - low) % size for x in loads]
    levels, start, turns, out = sorted(set(since)), 0, [], loads[:]
    for i, level in enumerate(levels):
        if start >= n:
            break
        order = sorted((f for f in range(len(loads)) if since[f] <= level), key=lambda f: (over[f], f))
        left = n - start
        here = min(left, len(order) * (levels[i + 1] - level)) if i + 1 < len(levels) else left
        turns.append((start, order))
        for place, f in enumerate(order):
            out[f] += size * (here // len(order) + (place < here % len(order)))
        start += here
    return turns, out


def balanced_folds(sizes: DataFrame, k: int) -> DataFrame:
    """fold of each group (name, size): groups by size, largest first (ties by name), each to the fold with the fewest rows so far (ties: the first).

    Equal to placing groups one by one, but the running state goes over sizes: the driver holds a
    row for each different size, of which n rows in groups have at most sqrt(2 n). A group's
    rank is that of its range, sorted, and its place there.
    """
    spark = sizes.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("size"), F.asc("name"))
    near = sizes.select("name", F.col("size").cast("long").alias("size")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # Ranges are those of one run: what is counted and what is joined must be the same.
    near = cut(near.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = near.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    loads, first, rows = [0] * k, 0, []
    for r in near.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():
        turns, loads = _turns(loads, r["size"], r["n"])
        rows.append((r["size"], first, turns))
        first += r["n"]
    classes = spark.createDataFrame(rows, "size long, _first long, _turns array<struct<start:long,folds:array<int>>>")
    # A row for each range, as many as there are partitions.
    ranked = near.join(F.broadcast(offsets), "_range").join(classes, "size").withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first"))
    turn = F.element_at(F.filter("_turns", lambda t: t["start"] <= F.col("_rank")), -1)
    at = (F.col("_rank") - turn["start"]) % F.size(turn["folds"])
    return ranked.select("name", "size", F.element_at(turn["folds"], (at + 1).cast("int")).alias("fold"))
