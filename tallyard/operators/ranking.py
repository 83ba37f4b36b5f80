"""Positions, top k and grouped ranking metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Stored
from .skew import join_unique


def global_position(df: DataFrame, by: list[Column], name: str = "position") -> DataFrame:
    """Exact position (from 0) of each row in the order ``by``, without gathering the rows in one task.

    Rows are range-partitioned and sorted; a partition's start is the count of those before it, one number a partition.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    kept = Stored(ordered, "position").df
    start, table = 0, []
    for part, n in sorted(kept.groupBy("__part").count().collect()):  # a row for each partition
        table.append((part, start))
        start += n
    starts = df.sparkSession.createDataFrame(table, "__part int, __start bigint")
    return kept.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def running_sums(df: DataFrame, by: list[Column], columns: list[str], prefix: str = "run_") -> DataFrame:
    """``run_<c>``: sum of each column over the rows up to and with this one in the order ``by``, which must be unique.

    Each range partition sums its own rows; the partitions before it add one number each. No task sees all rows.
    """
    kept = Stored(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "running").df
    start, table = [0] * len(columns), []
    for r in sorted(kept.groupBy("__part").agg(*[F.sum(c) for c in columns]).collect()):  # a row for each partition
        table.append((r[0], *start))
        start = [a + (b or 0) for a, b in zip(start, r[1:])]
    starts = df.sparkSession.createDataFrame(table, "__part int, " + ", ".join(f"__s{i} double" if isinstance(start[i], float) else f"__s{i} bigint" for i in range(len(columns))))
    w = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(starts), "__part")
    return out.withColumns({f"{prefix}{c}": F.sum(c).over(w) + F.col(f"__s{i}") for i, c in enumerate(columns)}).drop("__part", *[f"__s{i}" for i in range(len(columns))])


def first_per_group(df: DataFrame, keys: list[str], by: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a stated order (F1, F3, D-8, G5, H7); Spark limits each group before and
    after the shuffle, so a large group never travels whole."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__rn") <= n).drop("__rn")


def ranked(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """``rank`` from 1 by falling score, ties by ``tie``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(score), tie)))


def recall_mrr(df: DataFrame, group: str, label: str, score: str, tie: str, ks: tuple[int, ...]) -> DataFrame:
    """Mean recall at each k, mean reciprocal rank, number and mean size of groups with a positive."""
    hit = F.col(label) == 1
    per = ranked(df, group, score, tie).groupBy(group).agg(
        F.count_if(hit).alias("__pos"), F.min(F.when(hit, F.col("rank"))).alias("__first"), F.count(F.lit(1)).alias("__size"),
        *[F.count_if(hit & (F.col("rank") <= k)).alias(f"__at{k}") for k in ks],
    ).where("__pos > 0")
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("__size").alias("mean_size"), F.avg(1 / F.col("__first")).alias("mrr"),
        *[F.avg(F.col(f"__at{k}") / F.col("__pos")).alias(f"recall_{k}") for k in ks],
    )


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives of each score with the running counts above it: the basis of ranking metrics.

    Rows are counted by score first; the running counts are over different scores only.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running_sums(per, [F.desc("s")], ["pos", "neg"], "c")


def auroc_ap(df: DataFrame, label: str, score: str) -> DataFrame:
    """``auroc`` with ties at half (0.5 with one class only) and ``ap`` as step sum."""
    c = score_counts(df, label, score)
    won = F.sum(F.col("neg") * (F.col("cpos") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos"))
    step = F.sum(F.col("pos") * F.col("cpos") / (F.col("cpos") + F.col("cneg")))
    p, n = F.sum("pos"), F.sum("neg")
    return c.agg(F.when((p > 0) & (n > 0), won / (p * n)).otherwise(0.5).alias("auroc"), F.when(p > 0, step / p).otherwise(0.0).alias("ap"))


def binary_quality(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """Balanced accuracy, F1 (0 where undefined) and the majority's accuracy."""
    y = F.col(label) == 1
    tp, fp, fn, tn = (F.count_if(x) for x in (y & predicted, ~y & predicted, y & ~predicted, ~y & ~predicted))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.where(F.col(label).isNotNull()).agg(
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.greatest(F.avg(y.cast("int")), 1 - F.avg(y.cast("int"))).alias("majority")
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks (F12, L5), over counts of each value; a value that many rows share takes its
    rank by broadcast. ``a`` and ``b`` must differ."""

    def ranks(c: str) -> DataFrame:
        n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return running_sums(n, [F.col(c)], ["n"]).select(c, (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2).alias(f"__r_{c}"))

    joined = join_unique(join_unique(df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), ranks(a), a), ranks(b), b)
    return joined.agg(F.corr(f"__r_{a}", f"__r_{b}").alias("spearman"))


def percentiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation (E24, E26), nulls not counted; None without values.

    Values are counted, and their running counts tell which lie at the places asked for; no task holds all of them.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(counts, [F.col("v")], ["n"])
    n = run.agg(F.max("run_n")).first()[0]
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    found = run.agg(*[F.min(F.when(F.col("run_n") > i, F.col("v"))) for x in places for i in (math.floor(x), math.ceil(x))]).first()
    return [lo + (hi - lo) * (x - math.floor(x)) for x, lo, hi in zip(places, found[::2], found[1::2])]


def r_squared(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """1 - residual over total sum of squares."""
    t = df.select(truth.cast("double").alias("y"), guess.cast("double").alias("p")).where("y is not null and p is not null")
    return t.agg((1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.count(F.lit(1)) * F.var_pop("y"))).alias("r2"))


def pack_quality(df: DataFrame, pack: str, label: str, score: str, kind: str, tie: str) -> DataFrame:
    """Of candidate packs: ``top1``, ``mrr``, and ``win_rate`` of the real one over all variants, ties lost."""
    r = ranked(df, pack, score, tie)
    real = F.max(F.when(F.col(label) == 1, F.col(score)))
    per = r.groupBy(pack).agg(F.min(F.when(F.col(label) == 1, F.col("rank"))).alias("__first"), real.alias("__real"))
    wins = df.join(per, pack).where(F.col(label) == 0).groupBy(pack).agg(F.avg((F.col("__real") > F.col(score)).cast("double")).alias("__win"))
    return per.join(wins, pack, "left").agg(F.avg((F.col("__first") == 1).cast("double")).alias("top1"), F.avg(1 / F.col("__first")).alias("mrr"), F.avg("__win").alias("win_rate"))
