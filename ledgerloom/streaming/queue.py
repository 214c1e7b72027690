"""The incremental work queue: items not yet done, or done with other content or other rules.

The state is a table of (key, content, signature, attempts, done). A batch is the pending
items with the fewest attempts; finished items are merged into the state. The same merge
serves a stream of micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(items: DataFrame, state: DataFrame, signature: str, limit: int | None = None) -> DataFrame:
    """items: key, content. Those whose content or rule signature differs from what was done, by attempts and key."""
    done = state.filter("done").select("key", "content", F.col("signature").alias("_s"))
    fresh = items.join(done.filter(F.col("_s") == signature).drop("_s"), ["key", "content"], "left_anti")
    tried = state.groupBy("key").agg(F.max("attempts").alias("attempts"))
    out = fresh.join(tried, "key", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return out.orderBy("attempts", "key").limit(limit) if limit is not None else out


def merged(state: DataFrame, results: DataFrame, signature: str) -> DataFrame:
    """State after results (key, content, done): the last result of a key replaces what was known of it."""
    news = results.withColumn("signature", F.lit(signature))
    tried = state.groupBy("key").agg(F.max("attempts").alias("_a"))
    news = news.join(tried, "key", "left").withColumn("attempts", F.coalesce("_a", F.lit(0)) + 1).drop("_a")
    return state.join(news.select("key"), "key", "left_anti").unionByName(news.select(state.columns))


def follow(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs work on each micro-batch of (key, content) and appends its results to a table; a batch that is run again after a failure replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
