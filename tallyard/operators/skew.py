"""Per-key results without the imbalance of heavy keys (problem 6).

Exact offset chunking: rows are range-partitioned and sorted on (key, order columns), so one heavy key spans as many
partitions as its size needs. The sorted rows are checkpointed; keys are counted per partition; prefix sums over the
partitions give the offset at which a partition's share of a key starts; rows are numbered from it; equal-sized chunks
of the numbering are reduced to states; the states are merged in chunk order, where two neighbours compare what lies at
their common boundary. A key's rows are never in one task, and the merge sees one state per ``chunk_rows`` rows.
The input should be a scan or a written table: ties are spread by the running number of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import shared_dir

_KEY, _ORD, _PID, _TIE = "__key", "__ord", "__pid", "__tie"


def key_chunks(df: DataFrame, key: str, order: list[str], measures: list[str], chunk_rows: int = 20_000) -> DataFrame:
    """One state per (key, chunk, partition): ``key, chunk, part, n_rows, n_distinct, first_ord, last_ord`` and for
    each measure ``sum_<m>, cnt_<m>, min_<m>, max_<m>``.

    ``n_distinct`` counts the different values of the order columns inside the piece; pieces of one key are ordered by
    (chunk, part), and a value can be shared by two neighbours only at ``last_ord`` = ``first_ord``. Null keys form a
    key of their own. Measures are cast to double; nulls don't count; an empty input gives no state.
    """
    spark = df.sparkSession
    shared_dir(spark)
    order_text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in order])
    flat = df.select(
        F.col(key).cast("string").alias(_KEY),
        order_text.alias(_ORD),
        *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(measures)],
        F.monotonically_increasing_id().alias(_TIE),
    )
    # the running number breaks ties, so that copies of one row spread too; it is stable where ``df`` is a scan
    by = [F.col(_KEY).asc_nulls_first(), F.col(_ORD), F.col(_TIE)]
    ordered = flat.repartitionByRange(*by).sortWithinPartitions(*by).checkpoint().withColumn(_PID, F.spark_partition_id())

    counts = ordered.groupBy(_PID, _KEY).agg(F.count(F.lit(1)).alias("n"))
    prefix = Window.partitionBy(_KEY).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # in sorted order only the first key of a partition can have rows in an earlier one: at most one row a partition
    starts = counts.withColumn("start", F.sum("n").over(prefix)).where(F.col("start").isNotNull()).select(_PID, F.col("start"))
    offsets = {r[_PID]: int(r["start"]) for r in starts.toLocalIterator()}

    names = [f"{a}_m{i}" for i in range(len(measures)) for a in ("sum", "cnt", "min", "max")]
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType())]
        + [T.StructField("n_rows", T.LongType()), T.StructField("n_distinct", T.LongType())]
        + [T.StructField("first_ord", T.StringType()), T.StructField("last_ord", T.StringType())]
        + [T.StructField(n, T.LongType() if n.startswith("cnt") else T.DoubleType()) for n in names]
    )
    n_measures = len(measures)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, position, begun = None, 0, False
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys, ords, pid = b.column(0), b.column(1), b.column(2)[0].as_py()
            # null is a key: compare with a mark in its place
            marked = pc.fill_null(keys, "\x00null")
            changed = np.empty(n, bool)
            changed[0] = not (begun and marked[0].as_py() == last_key)
            changed[1:] = pc.not_equal(marked.slice(1), marked.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if not begun:
                base0 = offsets.get(pid, 0)
            elif changed[0]:
                base0 = 0
            else:
                base0 = position
            at = np.arange(n)
            run = np.maximum.accumulate(np.where(changed, at, 0))
            run[: np.argmax(changed[1:]) + 1 if changed[1:].any() else n] = 0
            pos = at - run + np.where(run == 0, base0, 0)
            chunk = pos // chunk_rows
            cut = changed.copy()
            cut[0] = True
            cut[1:] |= chunk[1:] != chunk[:-1]
            fresh = cut.copy()
            fresh[1:] |= pc.not_equal(ords.slice(1), ords.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            s = np.flatnonzero(cut)
            e = np.append(s[1:], n) - 1
            out = [keys.take(pa.array(s)), pa.array(chunk[s], pa.int64()), pa.array(np.full(len(s), pid, np.int32))]
            out += [pa.array(e - s + 1, pa.int64()), pa.array(np.add.reduceat(fresh.astype(np.int64), s))]
            out += [ords.take(pa.array(s)), ords.take(pa.array(e))]
            for i in range(n_measures):
                v = b.column(3 + i).to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(v)
                out.append(pa.array(np.add.reduceat(np.where(ok, v, 0), s)))
                cnt = np.add.reduceat(ok.astype(np.int64), s)
                out.append(pa.array(cnt))
                for f, fill in ((np.minimum, np.inf), (np.maximum, -np.inf)):
                    out.append(pa.array(f.reduceat(np.where(ok, v, fill), s), mask=cnt == 0))
            last_key, position, begun = marked[n - 1].as_py(), int(pos[-1]) + 1, True
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    pieces = ordered.select(_KEY, _ORD, _PID, *[f"m{i}" for i in range(n_measures)]).mapInArrow(reduce, schema)
    return pieces.select(
        "key", "chunk", "part", "n_rows", "n_distinct", "first_ord", "last_ord",
        *[F.col(f"{a}_m{i}").alias(f"{a}_{m}") for i, m in enumerate(measures) for a in ("sum", "cnt", "min", "max")],
    )


def merge_chunks(pieces: DataFrame, measures: list[str]) -> DataFrame:
    """Merge the ordered states of each key: ``key, n_rows, n_chunks, n_distinct``, and ``sum_, cnt_, min_, max_``.

    A value that lies on both sides of a boundary is counted once.
    """
    w = Window.partitionBy("key").orderBy("first_ord", "chunk", "part", "last_ord")
    same = F.coalesce((F.lag("last_ord").over(w) == F.col("first_ord")).cast("long"), F.lit(0))
    return (
        pieces.withColumn("shared", same)
        .groupBy("key")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.countDistinct("chunk").alias("n_chunks"),
            (F.sum("n_distinct") - F.sum("shared")).alias("n_distinct"),
            *[f(f"{a}_{m}").alias(f"{a}_{m}") for m in measures for a, f in (("sum", F.sum), ("cnt", F.sum), ("min", F.min), ("max", F.max))],
        )
    )


def skewed_group_metrics(df: DataFrame, key: str, order: list[str], measures: list[str], chunk_rows: int = 20_000) -> DataFrame:
    """Rows, different anchors (values of ``order``) and sums, counts, minima, maxima of ``measures`` for each key."""
    return merge_chunks(key_chunks(df, key, order, measures, chunk_rows), measures)


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", heavy_share: int = 200) -> DataFrame:
    """Join rows to a table with one row for each key, although a few keys may hold most rows.

    Keys with more than 1/``heavy_share`` of the rows number fewer than ``heavy_share``; their part of the table is
    broadcast, whatever the table's size, and all other rows take the ordinary join. ``how``: inner or left. Columns
    other than ``key`` must differ between the two sides. A null key matches nothing.
    """
    n = rows.count()
    heavy = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1000, n // heavy_share)).select(key)
    keys = [r[0] for r in heavy.collect()]
    if not keys:
        return rows.join(table, key, how)
    is_heavy = F.coalesce(F.col(key).isin(keys), F.lit(False))
    light = rows.where(~is_heavy).join(table, key, how)
    return light.unionByName(rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), key, how))
