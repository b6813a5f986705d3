"""A table that grows and is replaced by versions.

The rows of a version are a Parquet folder of their own; a version is there once its
small JSON file, written aside and renamed, stands in ``_versions``.  A reader takes
the newest version and reads the folders that it names, so it sees all of a version or
nothing of it, and a writer that dies leaves what was there before.  A version either
adds to those before it or replaces them.  ``key`` names what a version was made of: a
key that is there already is not written again.  One writer at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import remove

_FIELDS = "version long, folder string, first long, count long, replaces boolean, key string"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[dict]:
    """All versions in order; one small file each."""
    jvm, fs = _files(spark, path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/*.json"))
    if not found:
        return []
    rows = spark.read.schema(_FIELDS).json([str(x.getPath()) for x in found]).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["version"])


def current(spark: SparkSession, path: str) -> list[dict]:
    """The versions that make up the table now."""
    every = versions(spark, path)
    start = max((k for k, v in enumerate(every) if v["replaces"]), default=0)
    return every[start:]


def commit(spark: SparkSession, path: str, make: Callable[[int], DataFrame], *, count: Callable[[DataFrame], int], replaces: bool, key: str | None = None) -> dict:
    """Write ``make(first id)`` as a new version.  ``count`` tells from the written
    rows how many ids they take."""
    every = versions(spark, path)
    if key is not None and (old := next((v for v in every if v["key"] == key), None)):
        return old
    last = every[-1] if every else None
    first = 0 if replaces or last is None else last["first"] + last["count"]
    folder = f"rows-{uuid.uuid4().hex}"
    make(first).write.parquet(f"{path}/{folder}")
    new = {"version": last["version"] + 1 if last else 0, "folder": folder, "first": first, "count": count(spark.read.parquet(f"{path}/{folder}")), "replaces": replaces, "key": key}
    jvm, fs = _files(spark, path)
    aside, goal = (jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{name}") for name in (f".{folder}", f"{new['version']:012d}.json"))
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(goal) or not fs.rename(aside, goal):
        raise RuntimeError(f"version {new['version']} of {path} was written by another")
    return new


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of its newest version, or of ``version``; None without any."""
    own = current(spark, path) if version is None else [v for v in versions(spark, path) if v["version"] <= version]
    if version is not None:
        own = own[max((k for k, v in enumerate(own) if v["replaces"]), default=0) :]
    return spark.read.parquet(*[f"{path}/{v['folder']}" for v in own]) if own else None


def tidy(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete rows of versions that were replaced, but for the ``keep`` tables before
    the present one, which readers may still hold."""
    every = versions(spark, path)
    starts = [k for k, v in enumerate(every) if v["replaces"] or not k]
    for v in every[: starts[-keep - 1]] if len(starts) > keep else []:
        remove(spark, f"{path}/{v['folder']}")
        remove(spark, f"{path}/_versions/{v['version']:012d}.json")
