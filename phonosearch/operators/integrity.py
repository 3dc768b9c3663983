"""Digests, manifests, allow-lists, artifact checks and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_digest(page: DataFrame, rank: str, *columns: str) -> DataFrame:
    """digest: SHA-256 of a ranked page's lines `a:b:c` in order. A page is a bounded number of rows."""
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in columns))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("x"))))
    return page.agg(F.sha2(F.array_join(F.transform(rows, lambda s: s["x"]), "\n"), 256).alias("digest"))


def compared(one: DataFrame, other: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """rank, same: two rankings side by side; words must be equal and scores within the tolerance."""
    a = one.select("rank", F.col("word").alias("wa"), F.col("score").alias("sa"))
    b = other.select("rank", F.col("word").alias("wb"), F.col("score").alias("sb"))
    return a.join(b, "rank", "full").select("rank", F.coalesce((F.col("wa") == F.col("wb")) & (F.abs(F.col("sa") - F.col("sb")) <= tolerance), F.lit(False)).alias("same"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name (relative to path), bytes, sha256 of the files below a path, hidden ones left out."""
    from phonosearch.sources.store import listing

    return listing(spark, path)


def differences(found: DataFrame, listed: DataFrame) -> DataFrame:
    """name, problem: missing, extra, size or digest, of files against a list."""
    a, b = found.select("name", F.col("bytes").alias("fb"), F.col("sha256").alias("fs")), listed.select("name", F.col("bytes").alias("lb"), F.col("sha256").alias("ls"))
    problem = F.when(F.col("fb").isNull(), "missing").when(F.col("lb").isNull(), "extra").when(F.col("fb") != F.col("lb"), "size").when(F.col("fs") != F.col("ls"), "digest")
    return a.join(b, "name", "full").withColumn("problem", problem).where("problem is not null").select("name", "problem")


def over_budget(found: DataFrame, total: int = 900 << 20, each: int = 95 << 20) -> DataFrame:
    """n_files, total_bytes, largest, and whether the budgets hold."""
    out = found.agg(F.count("*").alias("n_files"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("largest"))
    return out.withColumn("fits", (F.col("total_bytes") <= total) & (F.col("largest") <= each))


def publish(df: DataFrame, path: str, check) -> None:
    """Writes a new version beside the one in use, checks what was written, and only then moves the pointer; see sources/store."""
    from phonosearch.sources.store import write

    write(df, path, "published", check=check)


#: Names that are never published; what a page may not load from elsewhere.
DENIED = (r"(^|/)\.", r"\.(onnx|pt|safetensors|map|pem|key)$", r"(^|/)(node_modules|data/source|scripts|tests)/")
CALL = r"(?i)(?:fetch|importScripts|import)\s*\(\s*[\"'`]https?://([^/\"'`]+)|<(?:script|iframe)[^>]+src\s*=\s*[\"']?(?:https?:)?//([^/\"' >]+)"


def artifact_problems(files: DataFrame, allowed: list[str], total: int = 900 << 20, each: int = 95 << 20, denied: tuple[str, ...] = DENIED, hosts: tuple[str, ...] = ()) -> DataFrame:
    """name, problem of an artifact's files (name, bytes, text of pages and scripts or null) against an allow-list and its budgets.

    denied, unlisted, missing, too_large (one file), over_budget (all, once, without a name), external (a call to a host that is not allowed).
    """
    spark = files.sparkSession
    listed = spark.createDataFrame([(a,) for a in allowed], "name string").withColumn("_listed", F.lit(True))
    at = files.join(F.broadcast(listed), "name", "left")
    found = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)), F.regexp_extract_all("text", F.lit(CALL), F.lit(2))))
    strange = F.filter(found, lambda h: (h != "") & ~(h.isin(*hosts) if hosts else F.lit(False)))
    bad = F.lit(False)
    for pattern in denied:
        bad = bad | F.col("name").rlike(pattern)
    kinds = F.array_compact(F.array(F.when(bad, "denied"), F.when(F.col("_listed").isNull(), "unlisted"), F.when(F.col("bytes") > each, "too_large"), F.when(F.coalesce(F.size(strange) > 0, F.lit(False)), "external")))
    out = at.select("name", F.explode(kinds).alias("problem"))
    lost = listed.join(files, "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    whole = files.agg(F.sum("bytes").alias("n")).where(F.col("n") > total).select(F.lit(None).cast("string").alias("name"), F.lit("over_budget").alias("problem"))
    return out.unionByName(lost).unionByName(whole)


def review_draft(files: DataFrame, sources: list[dict], manifests: dict[str, str]) -> dict:
    """A policy that someone has to review before anything is published: reviewed is false. files are name, bytes, sha256 of an artifact, a bounded list."""
    rows = sorted((r.name, r.bytes, r.sha256) for r in files.select("name", "bytes", "sha256").collect())
    return {"schema_version": 2, "reviewed": False, "allowed_files": [n for n, _, _ in rows], "manifests": dict(sorted(manifests.items())), "sources": sources, "files": [{"path": n, "bytes": b, "sha256": h} for n, b, h in rows]}
