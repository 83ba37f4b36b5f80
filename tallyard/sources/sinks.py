"""Sinks: keyed writes as table to table, and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_last_wins(target: DataFrame, new: DataFrame, keys: list[str], arrival: list[Column]) -> DataFrame:
    """The target after an upsert: each key's newest row of ``new``, else its old row (B2). ``arrival``: newest first,
    and unique within a key. Null keys are keys."""
    both = new.withColumn("__new", F.lit(1)).unionByName(target.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *arrival)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], arrival: list[Column]) -> DataFrame:
    """The target and, of keys that it lacks, the first row of ``new``."""
    w = Window.partitionBy(*keys).orderBy(*arrival)
    fresh = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    known = target.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    lacking = fresh.join(known, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return target.unionByName(lacking, allowMissingColumns=True)


def keyed_ids(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """A stable id from the natural key, so that a row and what depends on it can be written apart."""
    return df.withColumn(name, F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]))


def update_by_key(target: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns replaced where ``new`` has the key and a value; columns that the target lacks are added."""
    one = new.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    joined = target.join(one, key, "left")
    old = lambda c: F.col(c) if c in target.columns else F.lit(None)
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), old(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key isn't done yet (H1, D-3): resumable processing."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def write_json_lines(df: DataFrame, path: str, drop: list[str] = (), lengths: list[str] = (), mode: str = "errorifexists", flush_rows: int = 0) -> None:
    """JSON lines without bulky columns, with the lengths of some instead (B8 to B10). A file is closed every
    ``flush_rows`` rows, and at a task's end (B7); 0: at the end only."""
    out = df.withColumns({f"{c}_len": F.length(c) for c in lengths}).drop(*drop) if lengths or drop else df
    out.write.mode(mode).option("maxRecordsPerFile", flush_rows).json(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet in folders by column, in place of a secondary index."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def as_document(df: DataFrame) -> Column:
    """A row as one JSON document."""
    return F.to_json(F.struct(*df.columns))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table."""
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    rows = [f"| {' | '.join(df.columns)} |", f"|{'-|' * len(df.columns)}"]
    return "\n".join(rows + [f"| {' | '.join(cell(x) for x in r)} |" for r in df.limit(limit).collect()])
