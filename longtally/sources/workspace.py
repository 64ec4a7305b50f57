"""Tables written once per application and read by many queries.

A clean table is built from a full pass over its inputs; the queries on it then
read the small result instead of repeating that pass. The folder is the shared
one the cluster names in ``spark.checkpoint.dir``. A private temporary folder is
used in local mode only, where driver and executors share a disk.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="longtally-")
    return _LOCAL[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{folder(spark)}/longtally-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, lengths and times of the input files, two levels deep; a driver-side listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for entry in files.listStatus(path):
        inner = files.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        seen += [f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in inner]
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def written(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """The table built by ``build``, written on first use and read until an input file changes."""
    key = (spark.sparkContext.applicationId, f"{name}@{sf_dir}@{_state(spark, sf_dir)}")
    if key not in _WRITTEN:
        tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:8]
        path = new_path(spark, f"{name}-{tag}")
        writer = build().write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
