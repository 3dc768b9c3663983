"""Tables written once and read many times: versions beside each other, a manifest, a pointer that is replaced in one step.

A folder holds versions of a table and `current.json`. A version is parquet files and `_manifest.json`: kind and format version, rows, schema,
path, bytes and SHA-256 of every file, and the digests of the tables that it was built from (pins). The pointer names
the version in use and is replaced by one rename, so a reader sees the old table or the new one, and a crash leaves the old one.
Everything goes through Hadoop's file systems, so any store works; files are hashed whole by one task each (2 GB at most).
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, POINTER, MANIFEST = 1, "current.json", "_manifest.json"


class IntegrityError(RuntimeError):
    """What is stored is not what its manifest says."""


class Folder:
    """A path on any store that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first; the rename replaces what is there in one step."""
        new = f".{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(new), True)
        out.write(bytearray(text.encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
        options[0] = option.OVERWRITE
        files.rename(self.at(new), self.at(name), options)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at())] if self.exists() else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """name (relative to path), bytes, sha256 of the files below a path, hidden ones and manifests left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = Folder(spark, path)
    base = root.fs.makeQualified(root.at()).toUri().getPath().rstrip("/")
    own = F.regexp_replace("path", r"^[a-z0-9+.-]+:(//[^/]*)?(?=/)", "")
    name = F.when(F.startswith(own, F.lit(base + "/")), F.substr(own, F.lit(len(base) + 2))).otherwise(F.regexp_extract("path", "([^/]+)$", 1))
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(~F.col("name").isin(POINTER, MANIFEST))


def digest_of(files: list[dict]) -> str:
    return hashlib.sha256("\n".join(f"{f['name']}:{f['bytes']}:{f['sha256']}" for f in sorted(files, key=lambda f: f["name"])).encode()).hexdigest()


def write(df: DataFrame, path: str, kind: str, pins: dict[str, str] | None = None, partition_by: tuple[str, ...] = (), check=None, keep: int = 1) -> dict:
    """Writes a new version, checks it (check(df) of what was read back), and makes it the current one; gives its manifest.

    A folder that holds anything but versions of such a table is never touched. Older versions but the last `keep` go once the pointer has moved.
    """
    spark = df.sparkSession
    folder = Folder(spark, path)
    if any(not n.startswith((".", "v-")) and n != POINTER for n in folder.names()):
        raise FileExistsError(f"{path} holds other files")
    version = f"v-{uuid.uuid4().hex}"
    at = f"{folder.path}/{version}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    rows = back.count()
    if check is not None and not check(back):
        folder.delete(version)
        raise ValueError("what was written does not pass its check")
    files = [r.asDict() for r in listing(spark, at).collect()]  # a row for each file
    manifest = {"format": FORMAT, "kind": kind, "rows": rows, "schema": json.loads(df.schema.json()), "files": files, "digest": digest_of(files), "pins": pins or {}}
    Folder(spark, at).write(MANIFEST, json.dumps(manifest))
    before = json.loads(folder.read(POINTER))["versions"] if folder.exists(POINTER) else []
    stays = [version, *before][: keep + 1]
    folder.write(POINTER, json.dumps({"versions": stays}))
    for old in folder.names():
        if old.startswith("v-") and old not in stays:
            folder.delete(old)
    return manifest


def manifest_of(spark: SparkSession, path: str) -> tuple[str, dict]:
    """(folder of the current version, its manifest)."""
    folder = Folder(spark, path)
    if not folder.exists(POINTER):
        raise FileNotFoundError(path)
    at = f"{folder.path}/{json.loads(folder.read(POINTER))['versions'][0]}"
    try:
        return at, json.loads(Folder(spark, at).read(MANIFEST))
    except Exception as e:
        raise IntegrityError(f"{at} has no manifest that can be read") from e


def problems(spark: SparkSession, path: str, kind: str | None = None, pins: dict[str, str] | None = None) -> list[str]:
    """What is wrong with a stored table: its kind or format, a file that is missing, too much, of another size or digest, a pin of another table."""
    from pyspark.sql import types as T

    from phonosearch.operators.integrity import differences

    at, manifest = manifest_of(spark, path)
    out = []
    if manifest["format"] != FORMAT:
        out.append(f"format {manifest['format']}")
    if kind is not None and manifest["kind"] != kind:
        out.append(f"kind {manifest['kind']}")
    out += [f"pin {k}" for k, v in (pins or {}).items() if manifest["pins"].get(k) != v]
    if digest_of(manifest["files"]) != manifest["digest"]:
        out.append("digest of the list")
    listed = spark.createDataFrame([(f["name"], f["bytes"], f["sha256"]) for f in manifest["files"]], "name string, bytes bigint, sha256 string")
    out += sorted(f"{r.problem} {r.name}" for r in differences(listing(spark, at), listed).collect())
    assert T.StructType.fromJson(manifest["schema"]) is not None
    return out


def read(spark: SparkSession, path: str, kind: str | None = None, pins: dict[str, str] | None = None, verify: bool = True) -> DataFrame:
    """The current version of a table, with its schema; an IntegrityError says what is wrong with it."""
    from pyspark.sql import types as T

    at, manifest = manifest_of(spark, path)
    if verify and (found := problems(spark, path, kind, pins)):
        raise IntegrityError(f"{path}: " + ", ".join(found[:5]))
    return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(at)


def append_vectors(spark: SparkSession, path: str, more: DataFrame) -> dict:
    """Further topic rows under the ids that follow; they must have the dimensions of those that are there."""
    from phonosearch.operators.topic import appended

    table = read(spark, path, "topics")
    sizes = table.unionByName(more).agg(F.min(F.size("q")).alias("low"), F.max(F.size("q")).alias("high")).first()
    if sizes.low != sizes.high:
        raise ValueError(f"vectors of {sizes.low} and of {sizes.high} values")
    return write(appended(table, more), path, "topics", manifest_of(spark, path)[1]["pins"])
