"""Topic vectors: signed four-bit values, two to a byte, and their similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value) with the value computed once: inside a lambda a column would be computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normed(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(n, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))


def quantized(v: Column, bits: int = 4) -> Column:
    """Whole values by the row's largest, from -7 to 7 for four bits, halves rounded to even."""
    levels = (1 << (bits - 1)) - 1

    def by_top(v: Column) -> Column:
        top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        return let(top, lambda top: F.transform(v, lambda x: F.when(top > 0, F.bround(x / (top / levels))).otherwise(0).cast("int")))

    return let(v, by_top)


def packed(q: Column) -> Column:
    """Hexadecimal digits of the bytes: value + 8, an even dimension in the high half."""
    return F.array_join(F.transform(q, lambda x: F.lower(F.hex(x + 8))), "")


def unpacked(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.conv(c, 16, 10).cast("int") - 8)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def inverse_norm(q: Column) -> Column:
    return let(q, lambda q: let(dot(q, q), lambda n: F.when(n > 0, 1 / F.sqrt(n)).otherwise(0.0)))


def vectors(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row_id, q (integers), inv_norm, from float vectors."""
    q = embeddings.select(F.col(id_column).alias("row_id"), quantized(normed(F.col(vector).cast("array<double>"))).alias("q"))
    return q.withColumn("inv_norm", inverse_norm(F.col("q")))


def cosine(a: str, b: str) -> Column:
    """Cosine of the rows under two prefixes."""
    return dot(F.col(f"{a}q"), F.col(f"{b}q")) * F.col(f"{a}inv_norm") * F.col(f"{b}inv_norm")


def similarity_to(table: DataFrame, row_id: int) -> DataFrame:
    """row_id, similarity of every row with one: that row is broadcast, the table is scanned once."""
    one = table.where(F.col("row_id") == row_id).select(F.col("q").alias("t_q"), F.col("inv_norm").alias("t_inv_norm"))
    return table.join(F.broadcast(one), how="cross").select("row_id", (dot(F.col("q"), F.col("t_q")) * F.col("inv_norm") * F.col("t_inv_norm")).alias("similarity"))


def appended(table: DataFrame, more: DataFrame) -> DataFrame:
    """Further rows under the ids that follow the table's."""
    last = table.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("base"))
    return table.unionByName(more.join(F.broadcast(last), how="cross").withColumn("row_id", F.col("row_id") + F.col("base")).drop("base"))


def projected(embeddings: DataFrame, dims: int, id_column: str = "vec_id", vector: str = "embedding", keep: tuple = ()) -> DataFrame:
    """row_id and the principal components of centred vectors, by Spark ML; and further columns that are kept."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = embeddings.select(F.col(id_column).alias("row_id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"), *keep)
    mean = v.select(Summarizer.mean(F.col("v")).alias("m")).select(vector_to_array("m").alias("m"))
    centred = v.join(F.broadcast(mean), how="cross").select("row_id", array_to_vector(F.zip_with(vector_to_array("v"), F.col("m"), lambda x, y: x - y)).alias("v"), *keep)
    return PCA(k=dims, inputCol="v", outputCol="p").fit(centred).transform(centred).select("row_id", vector_to_array("p").alias("embedding"), *keep)


def product_quantized(vectors: DataFrame, dims: int, parts: int, centres: int = 256, seed: int = 0, keep: tuple = ()) -> DataFrame:
    """row_id, embedding and columns that are kept: each of `parts` equal slices of a vector (row_id, embedding of dims values) replaced by the nearest of its slice's centres (k-means of Spark ML)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width, out = dims // parts, vectors
    for j in range(parts):
        at = out.withColumn("_s", array_to_vector(F.slice("embedding", j * width + 1, width)))
        model = KMeans(k=centres, seed=seed + j, featuresCol="_s", predictionCol=f"_c{j}", maxIter=20).fit(at)
        books = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))  # centres x width numbers
        out = model.transform(at).withColumn(f"_v{j}", F.get(books, F.col(f"_c{j}"))).drop("_s", f"_c{j}")
    return out.select("row_id", F.concat(*(F.col(f"_v{j}") for j in range(parts))).alias("embedding"), *keep)


#: Schemes of the study: components, then bits a value, or slices of a product quantiser.
SCHEMES = (("pca", 8, 4), ("pca", 16, 4), ("pca", 32, 4), ("pca", 16, 8), ("pq", 16, 4))


def quantization_study(embeddings: DataFrame, schemes: tuple = SCHEMES, top: int = 10, centres: int = 16, block: int = 2000, rows: int = 8192) -> DataFrame:
    """scheme, bytes (a row's), corr, p99 (of the absolute error), kept: how well a scheme keeps the similarities of topics with all rows, and their best `top`.

    Topics are the rows whose id is divisible by 50, one for each such row. They meet all rows in blocks of `block`, and no pair leaves its task: of `rows`
    rows a topic gets sums, its best rows and how many errors lie in each narrow range; a second pass fetches the errors of the one range that holds the
    99th percentile, which is exact (the smallest error that 99 % of the errors don't exceed).
    """
    from phonosearch.operators import study

    dims = max(d for _, d, _ in schemes)
    exact = embeddings.withColumn("_exact", normed(F.col("embedding").cast("array<double>")))
    at = whole = projected(exact, dims, keep=("_exact",)).withColumnRenamed("embedding", "_whole").persist()
    made, out = ["_exact"], []
    for i, (kind, d, size) in enumerate(schemes):
        at = at.withColumn("embedding", F.slice("_whole", 1, d))
        if kind == "pca":
            small, held = F.transform(quantized(normed(F.col("embedding")), size), lambda x: x.cast("double")), d * size // 8
        else:
            at, small, held = product_quantized(at, d, size, centres, keep=("_whole", *made)), F.col("embedding"), size
        at = at.withColumn(f"_small{i}", normed(small)).drop("embedding")
        made.append(f"_small{i}")
        out.append([f"{kind}{d}/{size}", held])
    vectors = at.select("row_id", *made).persist()
    found = study.summed(vectors, len(schemes), top, block, rows)
    vectors.unpersist()
    whole.unpersist()
    return embeddings.sparkSession.createDataFrame([(*o, *f) for o, f in zip(out, found)], "scheme string, bytes int, corr double, p99 double, kept double")


def against_topics(v: DataFrame, name: str) -> DataFrame:
    """t, row_id, similarity of every row with every topic, the rows whose id is divisible by 50; v has row_id and v of length one."""
    dot = F.aggregate(F.zip_with("v", "t_v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    t = v.where(F.col("row_id") % 50 == 0).select(F.col("row_id").alias("t"), F.col("v").alias("t_v"))
    return by_blocks(v, t).select("t", "row_id", dot.alias(name))


def by_blocks(rows: DataFrame, topics: DataFrame, block: int = 2000) -> DataFrame:
    """Every row with every topic (column t): topics are broadcast in blocks of about `block`, as many as it takes."""
    blocks = max(1, -(-topics.count() // block))
    out = None
    for b in range(blocks):
        part = rows.join(F.broadcast(topics.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)), how="cross")
        out = part if out is None else out.unionByName(part)
    return out


def vectors_exact(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = embeddings.select(F.col(id_column).alias("row_id"), normed(F.col(vector).cast("array<double>")).alias("v"))
    return against_topics(v, "exact")


def looked_up(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, topic_row: each word's row by its script's language (Hangul is Korean, all else English); null where it has none, so that a search goes on without a topic."""
    from phonosearch.functions.text import HANGUL

    asked = words.select("word", F.lower(F.trim("word")).alias("_key"), F.when(F.col("word").rlike(HANGUL), "ko").otherwise("en").alias("lang"))
    rows = lexicon.where("topic_row >= 0").groupBy("lang", F.lower("word").alias("_key")).agg(F.min("topic_row").alias("topic_row"))
    return asked.join(rows, ["lang", "_key"], "left").select("word", "topic_row")
