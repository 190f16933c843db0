"""Tables with versions: a log of committed folders, and reads as of any version.

A version is one file of the log, which names the folders of rows it adds and says whether
they replace what was there. Data is written before its log entry and never changed, so a
reader sees whole versions only, and an old one as long as its folders are kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOG = "_log"


def _log_folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_LOG}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def history(spark: SparkSession, path: str) -> list[dict]:
    """The log's entries in order, with their number from 1; none where nothing was committed."""
    fs, folder = _log_folder(spark, path)
    if not fs.exists(folder):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
    rows = {r.name: r.value for r in spark.read.text(f"{path}/{_LOG}", wholetext=True, pathGlobFilter="*.json").selectExpr("_metadata.file_name AS name", "value").collect()} if names else {}  # a line for each version
    return [{"version": int(n[:-5])} | json.loads(rows[n]) for n in names]


def commit(df: DataFrame, path: str, *, replace: bool = False) -> int:
    """Write ``df`` as a new version: rows beside those there are, or instead of them. Returns its number.

    The log entry is created under the next free number and never over another one, so of
    writers at the same time each gets a version of its own.
    """
    spark, name = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs, folder = _log_folder(spark, path)
    fs.mkdirs(folder)
    entry = bytearray(json.dumps({"folder": name, "replace": replace}).encode())
    version = len([f for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")]) + 1
    while True:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}.json")
        if not fs.exists(target):
            try:
                out = fs.create(target, False)
                out.write(entry)
                out.close()
                return version
            except Exception:
                if not fs.exists(target):
                    raise
        version += 1


def as_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one if none is given; an unknown one is an error."""
    log = history(spark, path)
    known = [e["version"] for e in log]
    version = known[-1] if version is None and known else version
    if version not in known:
        raise ValueError(f"{path} has no version {version}; it has {known[:1]} to {known[-1:]}")
    folders: list[str] = []
    for e in log[: known.index(version) + 1]:
        folders = [e["folder"]] if e["replace"] else [*folders, e["folder"]]
    return spark.read.parquet(*[f"{path}/{f}" for f in folders])
