"""Feature tables kept up to date from a stream. An extension: the keys and rules are those of the batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..scratch import drop_path
from ..sources.sinks import upsert_last_wins


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """The complete versions of each part of a table, oldest first: ``target/v=<batch>/__part=<part>``. A version is
    complete once its writer has committed it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for v in fs.listStatus(root) if fs.exists(root) else []:
        name = v.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
            for part in fs.listStatus(v.getPath()):
                if part.getPath().getName().startswith("__part="):
                    found.setdefault(int(part.getPath().getName()[7:]), []).append(int(name[2:]))
    return {p: sorted(v) for p, v in found.items()}


def _read(spark: SparkSession, target: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{target}/v={v}/__part={p}" for p, v in versions.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(stream: DataFrame, target: str, state: str, keys: list[str], arrival: str, parts: int = 64) -> StreamingQuery:
    """Upsert each micro-batch into a Parquet table of ``parts`` parts by key hash, read by ``latest``.

    The last write stays (B2): a batch replaces the rows of its keys, whatever their arrival; inside a batch the newest
    arrival wins. A batch reads and writes only the parts that its keys fall into, as a version of its own, and may be
    repeated after a failure: it overwrites its own version only. Of each part the two newest versions are kept.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        touched = sorted(r[0] for r in batch.select(part.alias("p")).distinct().collect())  # at most ``parts``
        before = {p: [x for x in v if x < n] for p, v in _versions(spark, target).items()}
        old = _read(spark, target, {p: before[p][-1] for p in touched if before.get(p)}, schema)
        merged = upsert_last_wins(old, batch, keys, [F.desc(arrival)]).withColumn("__part", part)
        merged.repartition(max(1, len(touched)), "__part").write.mode("overwrite").partitionBy("__part").parquet(f"{target}/v={n}")
        for p in touched:
            for v in before.get(p, [])[:-1]:
                drop_path(spark, f"{target}/v={v}/__part={p}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete version of every part."""
    versions = {p: v[-1] for p, v in _versions(spark, target).items()}
    if not versions:
        raise FileNotFoundError(f"no version at {target}")
    p, v = next(iter(versions.items()))
    return _read(spark, target, versions, spark.read.parquet(f"{target}/v={v}/__part={p}").schema)


def windowed_counts(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in event-time windows; rows later than ``late`` are dropped once a stream has moved past them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
