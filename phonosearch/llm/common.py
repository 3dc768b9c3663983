"""What the operators share: reading columns, the shared folder, Arrow maps and text bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z; every other ASCII byte but a-z and 0-9 to a space; bytes from 0x80 stay.
ALNUM = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words of lower-cased ASCII letters, digits and bytes of other characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where neither the session nor its context names one, as in tests on one machine, a temporary one is set.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="phonosearch-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder; their lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers up to which a join broadcasts them.
SMALL = 1_000_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df as a join's side: broadcast if it has `most` rows at most, which are counted in the shared folder, else as it is."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def rows_of(docs: DataFrame, own: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and hash of the text (th) are kept, once each, with all their columns.

    own has doc_id and th of every row, kept those that stay. Rows are judged where they are if few go; of docs only equal rows are ever
    brought together.
    """
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    rows = cut(own.groupBy("doc_id", "th").agg(F.count("*").alias("times")))
    gone = small(rows.join(kept, same(rows, kept), "left_anti").select("doc_id", "th"))
    again = small(rows.where("times > 1").join(kept, same(rows, kept), "left_semi").select("doc_id", "th"))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    out = out.join(gone, same(out, gone), "left_anti")
    if not again.isEmpty():
        more = out.join(again, same(out, again), "left_semi").dropDuplicates(["doc_id", "th"])
        out = out.join(again, same(out, again), "left_anti").unionByName(more)
    return out.select("own.*")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows in an Arrow batch of whole texts: with texts of a few thousand characters, a few megabytes on either side.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands whole texts to Python in batches of BATCH_ROWS rows at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (bigint) and text (string) of a documents table, without any other column."""
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def arrow_map(df: DataFrame, rows: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str, size: int = 2048) -> DataFrame:
    """Runs rows() over each partition's rows as tuples; size rows at most go into one output batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        held: list[tuple] = []
        for row in rows(read()):
            held.append(row)
            if len(held) >= size:
                yield batch(held, out)
                held = []
        if held:
            yield batch(held, out)

    return df.mapInArrow(run, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
