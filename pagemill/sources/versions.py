"""State kept as versions: a reader sees one whole version, a failed writer leaves none, and of two writers one loses.

A version's rows are written to a folder of their own. Only then a small marker, written under another name, is renamed to the
version's number, which fails if another writer has that number already. Readers follow the highest marker; the rows
of older versions stay readable until ``vacuum`` takes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class StateConflict(RuntimeError):
    """Another writer has committed since this one looked."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    hadoop, at, files = _files(spark, f"{path}/versions")
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit())


def _marker(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version:012d}").first()[0])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version's rows, the newest by default; None where there is no state yet."""
    found = versions(spark, path)
    if version is None and not found:
        return None
    about = _marker(spark, path, version or found[-1])
    return spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{path}/{about['folder']}")


def write_version(df: DataFrame, path: str, based_on: int | None = None) -> int:
    """Commit df as the next version and return its number. ``based_on``: the version that df was made from (0: none), by
    default the newest as the write starts; if another has been committed since, StateConflict is raised and nothing changes."""
    spark = df.sparkSession
    base = based_on if based_on is not None else max(versions(spark, path), default=0)
    folder = f"rows-{base + 1:012d}-{uuid.uuid4().hex}"
    hadoop, rows, files = _files(spark, f"{path}/{folder}")
    marker = hadoop.Path(f"{path}/versions/.{folder}")
    done = False
    try:
        df.write.parquet(f"{path}/{folder}")
        if max(versions(spark, path), default=0) != base:
            raise StateConflict(f"{path} has moved on from version {base}")
        out = files.create(marker, False)
        try:
            out.write(bytearray(json.dumps({"folder": folder, "schema": json.loads(df.schema.json())}).encode()))
        finally:
            out.close()
        _rename(spark, marker, hadoop.Path(f"{path}/versions/{base + 1:012d}"), base)
        done = True
    finally:
        if not done:
            files.delete(marker, False)
            files.delete(rows, True)
    return base + 1


def _rename(spark: SparkSession, source, target, base: int) -> None:
    """Rename that never replaces: the file system's own exclusive rename."""
    from py4j.protocol import Py4JJavaError

    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(source, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise StateConflict(f"{target} was committed by another writer after version {base}") from e
        raise


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Take away all but the newest ``keep`` versions, markers first."""
    for version in versions(spark, path)[:-keep]:
        folder = _marker(spark, path, version)["folder"]
        for old in (f"{path}/versions/{version:012d}", f"{path}/{folder}"):
            _, at, files = _files(spark, old)
            files.delete(at, True)
