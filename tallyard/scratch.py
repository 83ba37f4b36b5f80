"""Intermediate tables in the folder that all executors share.

Lineage is cut with written tables, never with localCheckpoint: an executor may be lost at any time. The folder is
``spark.checkpoint.dir`` of the session; a folder of our own is set only where that is unset and the master is local.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; also makes it the context's checkpoint folder."""
    sc = spark.sparkContext
    place = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallyard-")
        atexit.register(shutil.rmtree, own, True)
        place = f"file://{own}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Paths in the shared folder that are still there, each with the context's file system settings.
_LEFT: dict[str, tuple] = {}


def release() -> None:
    """Delete every table and file that this process has put into the shared folder: to be called once the results that
    read them are written. Also runs at the end of the process."""
    for path, conf in list(_LEFT.items()):
        try:
            p = conf[0].org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf[1]).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone: then nothing can be deleted from here
            pass
        _LEFT.pop(path, None)


atexit.register(release)


def _remember(spark: SparkSession, path: str) -> None:
    _LEFT[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


class Stored:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing reads it any more; ``release`` deletes what
    a result still reads."""

    def __init__(self, df: DataFrame, label: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{label}-{uuid.uuid4().hex}"
        _remember(self.spark, self.path)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)
        _LEFT.pop(self.path, None)


def at_most(df: DataFrame, n: int) -> DataFrame:
    """The table, for a broadcast: an error if it has more than ``n`` rows."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"over {n} rows: too many to send to every task")
    return df


def own_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted at ``release``."""
    path = f"{shared_dir(spark)}/files/{label}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def put_file(spark: SparkSession, data: bytes, label: str) -> str:
    """Write bytes into the shared folder and register the file with the context, so that every executor, also a
    later one, fetches it. Returns the name for ``SparkFiles.get``."""
    sc, name = spark.sparkContext, f"{label}-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{name}")
    _remember(spark, p.toString())
    _write(spark, p, data)
    sc.addFile(p.toString())
    return name


def _write(spark: SparkSession, path, data: bytes) -> None:
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.writestr(f"{home.name}/{p.relative_to(home)}", p.read_text())
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{home.name}-{uuid.uuid4().hex}.zip")
    _write(spark, p, data.getvalue())
    sc.addPyFile(p.toString())
    _SHIPPED.add(sc.applicationId)


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, preceded by ``ship_package``."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    return run
