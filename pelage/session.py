"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "pelage") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


# Folders made for local masters that name none, by application.
_local_roots: dict[str, str] = {}
# Folders made inside each open scope.
_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may leave it unset; a folder on this machine is made
    for it, once per application, and goes when the driver ends. Any other
    master raises: its executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        folder = tempfile.mkdtemp(prefix="pelage-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_roots[app] = f"file://{folder}"
    return _local_roots[app]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch folders that were made inside; results that read them must be used up by then."""
    from pelage.sources.files import delete_folder

    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_folder(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files behind what is written inside go with the write; Spark otherwise keeps them until the
    driver's JVM happens to collect their handles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df, name: str):
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of executors."""
    path = scratch_dir(df.sparkSession, name)
    # zstd halves keys of hex digits, which snappy leaves as they are.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
