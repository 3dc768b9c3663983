"""A stream of queries against a static lexicon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonosearch.operators.word_search import batch_search
from phonosearch.plans.request import Request


def start(stream: DataFrame, lexicon: DataFrame, request_of: Callable[[str], Request], sink: Callable[[DataFrame, int, int], None], checkpoint: str, block: int = 64, top: int = 10):
    """Answers each micro-batch of queries (column query) with the best words of each.

    Queries are what users type in one trigger interval. Blocks of them share one pass over the lexicon;
    the sink gets (results, batch id, block) and replaces what it has of that block, which makes retries exact.
    Distinct queries of a batch are dealt to blocks by their hash, and only one block's at a time come to the driver.
    """

    def answer(batch: DataFrame, number: int) -> None:
        asked = batch.select("query").where("query is not null").distinct().persist()
        try:
            parts = -(-asked.count() // block)
            for part in range(parts):
                words = sorted(r.query for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect())  # about `block` rows
                requests = {w: r for w in words if (r := request_of(w)).native}
                if requests:
                    sink(batch_search(lexicon, requests, top), number, part)
        finally:
            asked.unpersist()

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_log(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """How often each query was asked in each window, within what may come late."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), "query").agg(F.count("*").alias("n"))


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files below a path as a stream, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
