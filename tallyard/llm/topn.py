"""Leaders of every group, exactly, however large a group is (problem 1).

One range-partitioned sort on (group, scores, identifier) puts the rows of all groups into one global order; a group of
any size spans as many partitions as it needs. Each partition keeps the first N rows of its groups with their place
inside the partition and, of its first and its last group, the row count: only these two can reach into other
partitions. The counts, two a partition, are prefix-summed and turn the places into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Stored


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns agree; null agrees with null and NaN with NaN."""
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return same.to_numpy(zero_copy_only=False)


def _leaders(n_top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place = None, 0  # the row before, and how many different rows its group has so far
        began, first_rows, first_group = 0, 0, None  # groups begun; the first group and, once it has ended, its rows

        def out(groups, items, places, leading, counts):
            n = len(counts)
            return pa.RecordBatch.from_arrays(
                [groups, items, pa.array(places, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.asarray(leading, bool)), pa.array(counts, pa.int64())],
                names=["grp", "item", "place", "part", "leading", "n"],
            )

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if last is None:
                first_group = b.column(0).slice(0, 1)
            before = b.slice(0, 1) if last is None else last
            agree = [np.concatenate([_same(c.slice(0, 1), p), _same(c.slice(1), c.slice(0, n - 1))]) for c, p in zip(b.columns, before.columns)]
            new = ~agree[0]
            new[0] |= last is None
            fresh = new | ~np.logical_and.reduce(agree)  # not a repetition of the row before
            seen = np.cumsum(fresh)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            at = seen - np.where(start >= 0, seen[start] - 1, -place)
            order = began + np.cumsum(new)  # number of each row's group
            if began < 2 <= order[-1]:
                end = int(np.searchsorted(order, 2))
                first_rows = int(at[end - 1]) if end else place
            keep = np.flatnonzero((at <= n_top) & fresh)
            if keep.size:
                pick = pa.array(keep)
                yield out(b.column(0).take(pick), b.column(b.num_columns - 1).take(pick), at[keep], order[keep] == 1, np.zeros(keep.size, np.int64))
            began, place, last = int(order[-1]), int(at[-1]), b.slice(n - 1, 1)
        if last is not None:
            none = pa.nulls(1, last.column(last.num_columns - 1).type)
            if began > 1:
                yield out(first_group, none, [0], [True], [first_rows])
            yield out(last.column(0), none, [0], [began == 1], [place])

    return run


def _offsets(edges: list[tuple]) -> list[tuple[int, int]]:
    """(partition, rows that its first group has in earlier partitions), where there are any. ``edges``: for each
    partition in order (number, whether it is the first group's count, group, rows)."""
    found, group, rows = [], None, 0
    for part, leading, g, n in edges:
        same = leading and group is not None and (g == group or g != g and group != group)
        if same:
            found.append((part, rows))
        group, rows = g, n + (rows if same else 0)
    return found


def top_n(df: DataFrame, group: str, scores: list[tuple[str, str]], item: str, n: int) -> DataFrame:
    """The first ``n`` items of every group: ``grp, item, position bigint``; grp and item keep their columns' types.

    ``scores``: (column, "desc" or "asc") in order of weight, of any ordered type, nulls last; NaN is above every number.
    Ties go to the smaller ``item``. Rows with a null group, item or first score aren't ranked. Rows equal in group,
    scores and item count once. A group of fewer than ``n`` rows gives all of them; an empty table gives none. Other
    columns are not read. The driver gets two counts of each partition.
    """
    flat = df.select(F.col(group).alias("grp"), *[F.col(c).alias(f"s{i}") for i, (c, _) in enumerate(scores)], F.col(item).alias("item"))
    flat = flat.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("s0").isNotNull())
    by = [F.col("grp"), *[F.col(f"s{i}").desc_nulls_last() if way == "desc" else F.col(f"s{i}").asc_nulls_last() for i, (_, way) in enumerate(scores)], F.col("item")]
    kinds = {c: flat.schema[c].dataType.simpleString() for c in ("grp", "item")}
    schema = f"grp {kinds['grp']}, item {kinds['item']}, place bigint, part int, leading boolean, n bigint"
    stored = Stored(flat.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_leaders(n), schema), "leaders").df
    edges = stored.where("item is null").select("part", "leading", "grp", "n").collect()
    offsets = _offsets(sorted((tuple(e) for e in edges), key=lambda e: (e[0], not e[1])))
    position = F.col("place")
    if offsets:
        before = F.broadcast(df.sparkSession.createDataFrame(offsets, "part int, earlier bigint"))  # at most a row a partition
        stored = stored.join(before, "part", "left")
        position = position + F.when(F.col("leading"), F.coalesce("earlier", F.lit(0))).otherwise(0)
    return stored.where("item is not null").select("grp", "item", position.alias("position")).where(F.col("position") <= n)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    functions = top_n(
        spark.read.parquet(f"{d}/function_static_props.parquet"), "feature_function", [("cyclomatic_complexity", "desc"), ("loc", "desc")], "id", 3
    )
    crawls = top_n(
        spark.read.parquet(f"{d}/prs_copy.parquet"), "instance_id", [("total_comments", "desc"), ("total_review_threads", "desc")], "id", 3
    )
    tag = lambda df, src: df.select(F.lit(src).alias("src"), F.col("grp").alias("group_key"), F.col("item").alias("item_id"))
    return tag(functions, "function_static_props").unionByName(tag(crawls, "prs_copy"))


QUERIES = {"p1_found": p1_found}

_RANKED = """SELECT '{t}' AS src, {g} AS group_key, id AS item_id FROM (
    SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {a} DESC, {b} DESC NULLS LAST, id) AS rn
    FROM (SELECT DISTINCT {g}, {a}, {b}, id FROM {t}) WHERE {g} IS NOT NULL AND {a} IS NOT NULL) WHERE rn <= 3"""
SQL = {
    "p1_found": _RANKED.format(t="function_static_props", g="feature_function", a="cyclomatic_complexity", b="loc")
    + " UNION ALL "
    + _RANKED.format(t="prs_copy", g="instance_id", a="total_comments", b="total_review_threads")
}
