"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_open = threading.local()  # .scopes: what each open scratch of this thread has to remove


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Where it is unset, a local session (tests) gets one temporary folder, removed when Python ends;
    a cluster gets an error, since no folder of the driver's is known to be shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-chatframe-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def store(df: DataFrame, name: str, keep: bool = False, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, so a
    lost executor costs a re-read, not a recomputation, and ids made while writing are fixed. With
    ``keep`` the ``scratch`` it is in doesn't remove it, but one around that does. ``level`` is that of zstd."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chatframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    scopes = getattr(_open, "scopes", [])[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored inside. What is read from there must be written by then."""
    _open.scopes = [*getattr(_open, "scopes", []), []]
    try:
        yield
    finally:
        for path in _open.scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
