"""Folders whose contents change in versions: stage tables, score stores, best pairs.

A version is a folder ``v<number>-<id>`` under the path; it counts from the moment its empty
file ``_COMMITTED`` exists, which is written last. Creating one file is atomic on every
store, nothing that a reader may have open is ever overwritten, and a writer that dies
leaves a folder that no reader looks at. Every version has a manifest: a flat JSON object
that says what the contents belong to.

``publish`` keeps the newest ``keep`` committed versions (None: all of them, for stores that
grow by increments) and deletes older ones of its own kind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, MANIFEST, DATA = "_COMMITTED", "manifest.json", "data"


class StageMismatch(ValueError):
    """A stage table belongs to other inputs, another model or other parameters."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _write_file(spark: SparkSession, path: str, text: str = "") -> None:
    fs, path_of = _fs(spark, path)
    out = fs.create(path_of(path), False)
    out.write(bytearray(text.encode()))
    out.close()


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """Manifest of a version (a small file, read on the driver)."""
    rows = spark.read.option("wholetext", True).text(f"{folder}/{MANIFEST}").collect()
    return json.loads(rows[0]["value"])


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed versions, oldest first."""
    fs, path_of = _fs(spark, path)
    if not fs.exists(path_of(path)):
        return []
    out = []
    for s in fs.listStatus(path_of(path)):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("v") and fs.exists(path_of(f"{path.rstrip('/')}/{name}/{MARK}")):
            out.append(name)
    return [f"{path.rstrip('/')}/{name}" for name in sorted(out)]


def latest(spark: SparkSession, path: str) -> str | None:
    folders = committed(spark, path)
    return folders[-1] if folders else None


def publish(df: DataFrame, path: str, manifest: dict | None = None, keep: int | None = 2) -> str:
    """Write ``df`` as the next version and commit it. ``df`` may read earlier versions."""
    spark = df.sparkSession
    last = latest(spark, path)
    number = int(last.rsplit("/v", 1)[1].split("-")[0]) + 1 if last else 1
    folder = f"{path.rstrip('/')}/v{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{DATA}")
    _write_file(spark, f"{folder}/{MANIFEST}", json.dumps(manifest or {}, sort_keys=True))
    _write_file(spark, f"{folder}/{MARK}")
    if keep is not None:
        fs, path_of = _fs(spark, path)
        for old in committed(spark, path)[:-keep]:
            fs.delete(path_of(old), True)
    return folder


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    folder = latest(spark, path)
    return spark.read.parquet(f"{folder}/{DATA}") if folder else None


def read_all(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed versions together (a store that grows by increments)."""
    folders = committed(spark, path)
    return spark.read.parquet(*[f"{f}/{DATA}" for f in folders]) if folders else None


def identity(df: DataFrame, *cols: str) -> str:
    """Identity of a table's rows, whatever their order and partitions: row count, and the
    sums of two independent hashes of the columns (one aggregate)."""
    cols = cols or tuple(df.columns)
    # A null hashes as nothing at all, so its place is hashed, too.
    values = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), wide(F.xxhash64(*values)).alias("a"),
               wide(F.xxhash64(F.lit("second"), *values)).alias("b")).first()
    return f"{r['n']}:{r['a']}:{r['b']}"


def check_manifest(found: dict, expected: dict, path: str) -> None:
    """Raise unless every entry of ``expected`` is in the manifest with the same value."""
    other = sorted(k for k, v in expected.items() if found.get(k) != v)
    if other:
        raise StageMismatch(f"{path} belongs to another run: " + ", ".join(
            f"{k} is {found.get(k)!r}, not {expected[k]!r}" for k in other))
