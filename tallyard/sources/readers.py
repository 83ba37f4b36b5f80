"""Sources: tables, text logs, listings and outside stores as DataFrames. All are lazy; filters are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import running_sums
from ..operators.skew import join_unique
from ..scratch import path_exists


def table(spark: SparkSession, place: str, where: list[Column] = (), columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with optional filters and columns, which reach the scan (A1, A2)."""
    df = spark.read.parquet(place)
    for c in where:
        df = df.where(c)
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of ``key`` (A1). The driver's jar must be on the class path."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options or {})


def lookup(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows of the ids in the order asked for, with ``position``; missing ids are dropped, repeated ids repeat (A3, A4)."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, {key} bigint")
    return df.join(F.broadcast(wanted), key).orderBy("position")  # the request is a list in memory


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a stated schema; a malformed line gives nulls, not a failure."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def in_list(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is in a list of the driver's (C3): a broadcast semi-join, so that a long list is no long expression.
    An empty list keeps no row, and null is in no list."""
    kind = df.schema[key].dataType.simpleString()
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values if v is not None], f"{key} {kind}").distinct()), key, "left_semi")


def first_matching(df: DataFrame, wanted: Column, by: list[Column], n: int | None = None) -> DataFrame:
    """The first ``n`` rows that match, in a stated order (A5, A11); all that match without ``n``."""
    rows = df.where(wanted)
    return rows if n is None else rows.orderBy(*by).limit(n)


def json_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """``{"id": id, "buckets": {bucket: [ids]}}``, one object a line, as rows ``id, bucket, other`` (A12): the form of
    ``json_id_map`` for maps that are too large for one document, read in as many tasks as there are splits."""
    lines = json_lines(spark, path, "id bigint, buckets map<string, array<bigint>>")
    return lines.select("id", F.explode("buckets").alias("bucket", "ids")).select("id", "bucket", F.explode("ids").alias("other"))


def tree(groups: DataFrame, key: str, list_files: Callable[[str], list[str]], suffix: str = ".py") -> DataFrame:
    """``key, path`` of the files with a suffix in each group's tree (A18). ``list_files`` is the seam to the repositories:
    it gets a key and gives its paths; a group whose listing fails has no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k in p[key]:
                try:
                    rows += [(k, x) for x in list_files(k) if x.endswith(suffix)]
                except Exception:  # noqa: BLE001  a missing repository is no failure of the others
                    continue
            yield pd.DataFrame(rows, columns=[key, "path"])

    return groups.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(run, f"{key} string, path string")


def blobs(files: DataFrame, key: str, commit: str, path: str, fetch: Callable[[str, str, str], bytes | None]) -> DataFrame:
    """The rows with ``content``: each file's text at its commit (A17), undecodable bytes replaced. ``fetch`` is the seam
    to the repositories; null where it gives None or fails."""

    @F.pandas_udf("string")
    def content(k: pd.Series, c: pd.Series, f: pd.Series) -> pd.Series:
        def one(*asked: str) -> str | None:
            try:
                raw = fetch(*asked)
            except Exception:  # noqa: BLE001
                return None
            return None if raw is None else raw.decode("utf-8", "replace")

        return pd.Series([one(*x) for x in zip(k, c, f)], dtype=object)

    return files.withColumn("content", content(key, commit, path))


def json_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``{id: {bucket: [ids]}}`` as rows ``id, bucket, other``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, array<bigint>>>").alias("m"))
    return whole.select(F.explode("m").alias("id", "b")).select("id", F.explode("b").alias("bucket", "ids")).select(F.col("id").cast("bigint"), "bucket", F.explode("ids").alias("other"))


def list_file(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """Lines of a list file without blanks."""
    lines = spark.read.text(path).select(F.trim("value").alias("item")).where("item != ''")
    return lines.limit(head) if head else lines


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """``number, owner, name`` of folders called ``number__owner__name`` under files that match the pattern."""
    parts = F.split(F.element_at(F.split("path", "/"), -2), "__")
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.where(F.size(parts) >= 3).select(F.get(parts, F.lit(0)).alias("number"), F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("name")).distinct()


def marked_sessions(lines: DataFrame, log: str, order: str, text: str, mark: str = "@@@") -> DataFrame:
    """``log, session, hash, author, line`` of text logs in which a marked line opens a session.

    Sessions are numbered by running counts in the global order of log and line, so a long log spans partitions. Lines
    before the first mark of their log and blank lines are dropped. ``order`` is unique in a log.
    """
    flat = lines.select(F.col(log).alias("log"), F.col(order).alias("at"), F.col(text).alias("line"), F.col(text).startswith(mark).cast("bigint").alias("mark"))
    run = running_sums(flat.where("line is not null"), [F.col("log"), F.col("at")], ["mark"])
    first = run.groupBy("log").agg(F.min(F.col("run_mark") - F.col("mark")).alias("before"))
    parts = F.split(F.substring("line", len(mark) + 1, 1 << 30), "\t", 2)
    heads = run.where("mark = 1").select(F.struct("log", "run_mark").alias("key"), F.get(parts, F.lit(0)).alias("hash"), F.get(parts, F.lit(1)).alias("author"))
    kept = run.where((F.col("mark") == 0) & (F.trim("line") != "")).select("log", F.struct("log", "run_mark").alias("key"), "run_mark", F.trim("line").alias("line"))
    found = join_unique(join_unique(kept, heads, "key"), first, "log")
    return found.select(F.col("log").alias(log), (F.col("run_mark") - F.col("before")).alias("session"), "hash", "author", F.col("line").alias(text))


def or_example(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """The table, or a built-in sample where it is empty."""
    return df.sparkSession.createDataFrame(rows, schema) if df.isEmpty() else df


def cached_table(spark: SparkSession, place: str, make: Callable[[], DataFrame], fingerprint: str) -> DataFrame:
    """A written table if it is there under the same fingerprint, else made and written (A13). Its rows are found by
    key, not by place, so records and cache can't slip (D-20)."""
    path = f"{place.rstrip('/')}/{fingerprint}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
