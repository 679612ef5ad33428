"""Writers: versions behind a pointer, writes that skip what hasn't changed, slices replaced whole, and manifests."""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one table of a version that ``publish`` writes.
ROWS = "rows"


class Conflict(Exception):
    """Another writer published in between."""


def rows_digest(columns: list[str], condition: Column | None = None) -> list[Column]:
    """Aggregates that together are a digest of a multiset of rows, whatever their order: the count, and sums of the quarters of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    quarters = [F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    return [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).cast("string").alias(f"q{k}") for k, x in enumerate(quarters))]


def _joined() -> Column:
    return F.sha2(F.concat_ws(":", "n", *(f"q{k}" for k in range(4))), 256)


def content_version(df: DataFrame) -> str:
    """A digest of the rows, whatever their order: equal for equal multisets of rows, in one pass that aggregates before the shuffle."""
    return df.agg(*rows_digest(df.columns)).select(_joined().alias("x")).first()["x"]


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The names in a folder and when each was last changed, in milliseconds; none if it isn't there."""
    files, place = _file_system(spark, path)
    return [(x.getPath().getName(), x.getModificationTime()) for x in files.listStatus(place)] if files.exists(place) else []


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def _current(spark: SparkSession, root: str) -> dict | None:
    numbers = [x for x, _ in _names(spark, f"{root}/pointer") if x.endswith(".json") and not x.startswith(("_", "."))]
    if not numbers:
        return None
    files, place = _file_system(spark, f"{root}/pointer/{max(numbers)}")
    stream = files.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, pointer: dict) -> None:
    """Create the pointer of its number, whole, if there is none: it is written aside and renamed, which fails where the name is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, aside = _file_system(spark, f"{root}/pointer/_{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(pointer).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/pointer/{pointer['number']:012d}.json")
    rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), conf).rename
    try:
        rename(files.makeQualified(aside), files.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {pointer['number']} of {root} was published by another writer") from error
        raise


def current_version(spark: SparkSession, root: str) -> tuple[str, int] | None:
    last = _current(spark, root)
    return (last["version"], last["number"]) if last else None


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version, all of the same one."""
    found = _current(spark, root)
    if not found:
        raise ValueError(f"nothing is published in {root}")
    return {name: spark.read.parquet(f"{root}/versions/{found['folder']}/{name}") for name in found["tables"]}


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return read_tables(spark, root)[ROWS]


def drifted(df: DataFrame, root: str) -> bool:
    """Whether what would be published isn't what is."""
    now = current_version(df.sparkSession, root)
    return not now or now[0] != tables_version({ROWS: df})


def tables_version(tables: dict[str, DataFrame]) -> str:
    """A digest of several tables by name, as ``content_version`` is of one."""
    parts = sorted((name, content_version(df)) for name, df in tables.items())
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def publish_tables(tables: dict[str, DataFrame], root: str, findings: Callable[[dict[str, DataFrame]], DataFrame] | None = None, expected: int | None = None) -> bool:
    """Write tables to a folder of their own, check them, and point to all of them at once; false if their rows are the current ones.

    Rows are computed once: their digest and the findings are of what was written. Readers see the
    old version until the pointer moves, so a run that fails half way changes nothing for them, and
    publishing earlier rows again never touches the folder that they had. ``findings`` gets what was
    written and returns what is wrong with it. The pointer is compared and set: it is created for the
    number after ``expected`` (the one that is current when the call begins), and if another writer
    has created that, this one raises ``Conflict`` and leaves nothing. A writer that dies leaves at
    most a folder that nothing points to; see ``recover``.
    """
    spark, folder = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    now = _current(spark, root)
    known = expected if expected is not None else now["number"] if now else 0
    path = f"{root}/versions/{folder}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}")
        written = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}
        version = tables_version(written)
        wrong = findings(written).take(5) if findings is not None else []
        if wrong:
            raise ValueError(f"not published: {wrong}")
        if now and now["version"] == version and now["number"] == known:
            _remove(spark, path)
            return False
        _point(spark, root, {"number": known + 1, "version": version, "folder": folder, "tables": sorted(tables)})
    except Exception:
        _remove(spark, path)
        raise
    return True


def publish(df: DataFrame, root: str, findings: Callable[[DataFrame], DataFrame] | None = None, expected: int | None = None) -> bool:
    """``publish_tables`` for one table."""
    return publish_tables({ROWS: df}, root, (lambda tables: findings(tables[ROWS])) if findings is not None else None, expected)


def recover(spark: SparkSession, root: str, keep: int | None = None, idle_seconds: float = 86_400) -> list[str]:
    """Remove what writers that died left: folders that no pointer names and pointers that never got their name, unchanged for ``idle_seconds``; and the folders and pointers of all but the newest ``keep`` versions. Returns their names.

    A version that readers may still have open should not be among those: keep as many as a reader's time spans.
    """
    pointers = sorted((x, at) for x, at in _names(spark, f"{root}/pointer") if x.endswith(".json") and not x.startswith(("_", ".")))
    old = pointers[:-keep] if keep else []
    named = set()
    for name, _ in pointers[len(old) :]:
        files, place = _file_system(spark, f"{root}/pointer/{name}")
        stream = files.open(place)
        named.add(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folder"])
        stream.close()
    before = (time.time() - idle_seconds) * 1000
    gone = [f"pointer/{x}" for x, _ in old]
    gone += [f"pointer/{x}" for x, at in _names(spark, f"{root}/pointer") if x.startswith("_") and at <= before]
    gone += [f"versions/{x}" for x, at in _names(spark, f"{root}/versions") if x not in named and at <= before]
    for name in gone:
        _remove(spark, f"{root}/{name}")
    return sorted(gone)


def replace_slices(df: DataFrame, path: str, keys: list[str], cleared: list[dict[str, object]] | None = None) -> None:
    """Replace the partitions of ``keys`` that ``df`` has rows for; the others stay, but for those ``cleared``: what was asked for and came back empty."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    for values in cleared or []:
        files, place = _file_system(df.sparkSession, "/".join([path, *(f"{k}={values[k]}" for k in keys)]))
        files.delete(place, True)


def manifest(df: DataFrame, file: Column, text: str = "text") -> DataFrame:
    """(file, rows, bytes, digest) for each file: the digest is that of its multiset of texts, so no file's rows ever meet in one place."""
    listed = df.select(file.alias("file"), F.coalesce(text, F.lit("")).alias("text")).groupBy("file").agg(*rows_digest(["text"]), F.sum(F.octet_length("text")).alias("bytes"))
    return listed.select("file", F.col("n").alias("rows"), "bytes", F.concat(F.lit("sha256:"), _joined()).alias("digest"))


def cached_documents(cache: DataFrame, incoming: DataFrame, keys: list[str], version: int) -> DataFrame:
    """A cache (keys, ``schema_version``, ``document``) after documents of a schema's version were written over it by key."""
    fresh = incoming.withColumn("schema_version", F.lit(version)).select(*cache.columns)
    return cache.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def readable_documents(cache: DataFrame, version: int) -> DataFrame:
    """Documents of that schema version; others read as absent."""
    return cache.filter(F.col("schema_version") == version)


def rendered(rows: DataFrame, order: str, line: Column, head: str, tail: str) -> str:
    """A registry's rows as source text, one line each in order; for registries, which are small."""
    lines = rows.select(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n").alias("x")).first()["x"]
    return f"{head}\n{lines}\n{tail}\n"


def safe_path(root: str, name: str) -> str:
    """The path of a file below the root; names that would leave it fail."""
    if not name or name.startswith("/") or "\\" in name or "\0" in name or ".." in name.split("/"):
        raise ValueError(f"unsafe name: {name!r}")
    return posixpath.join(root, posixpath.normpath(name))


def journal(spark: SparkSession, path: str, job: str, digest: str, status: str) -> None:
    """Add one receipt to a run table."""
    row = spark.createDataFrame([(job, digest, status)], "job string, digest string, status string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
