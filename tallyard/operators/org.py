"""Ownership and co-change of files (E8 to E16, D-13 to D-15, C14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import top_module
from .ranking import running_sums


def ownership(touches: DataFrame, keys: list[str], author: str) -> DataFrame:
    """``keys, n_touches, n_authors, top_share, entropy, friction`` from one row for each touch.

    Two levels of partial aggregation: rows to (key, author) counts, counts to measures; no list of authors is built.
    A null author counts as ``unknown``.
    """
    counts = touches.groupBy(*keys, F.coalesce(F.col(author), F.lit("unknown")).alias("__who")).agg(F.count(F.lit(1)).alias("__n"))
    n, c = F.sum("__n"), F.col("__n").cast("double")
    # sum of p ln(p + 1e-12) needs the total first
    totals = counts.groupBy(*keys).agg(n.alias("n_touches"), F.count(F.lit(1)).alias("n_authors"), F.max("__n").alias("__top"))
    joined = counts.join(totals, keys)
    p = c / F.col("n_touches")
    measured = joined.groupBy(*keys, "n_touches", "n_authors", "__top").agg((-F.sum(p * F.log(p + 1e-12))).alias("entropy"))
    top = F.col("__top") / F.col("n_touches")
    return measured.select(*keys, "n_touches", "n_authors", top.alias("top_share"), "entropy", friction(F.col("n_authors"), top, F.col("entropy")).alias("friction"))


def friction(n_authors: Column, top_share: Column, entropy: Column) -> Column:
    """Higher the more and the more evenly authors share a file, in [0, 1]."""
    even = F.when(n_authors > 1, entropy / F.log(F.greatest(n_authors, F.lit(2)).cast("double"))).otherwise(0.0)
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * (1 - top_share) + 0.4 * even))
    return mixed * F.least(F.lit(1.0), F.log1p(n_authors.cast("double")) / math.log(10.0))


def cochange(touched: DataFrame, group: list[str], file: str, max_files: int, cross_weight: float = 1.25) -> DataFrame:
    """Directed edges ``repo columns, src, dst, weight`` of files changed together (D-15).

    ``group``: repository and change; the edges are summed per first column. A change of more than ``max_files`` files
    is too broad to say anything and counts for nothing (C14), which also bounds a group's pairs. Files of different
    top modules weigh ``cross_weight``.
    """
    repo = group[0]
    once = touched.where(F.col(file).isNotNull()).select(*group, F.col(file).alias("src")).distinct()
    narrow = once.join(once.groupBy(*group).count().where(F.col("count") <= max_files).drop("count"), group, "left_semi")
    other = narrow.select(*group, F.col("src").alias("dst"))
    weight = F.when(top_module("src") != top_module("dst"), cross_weight).otherwise(1.0)
    return narrow.join(other, group).where("src != dst").groupBy(repo, "src", "dst").agg(F.sum(weight).alias("weight"))


def coupling(edges: DataFrame, repo: str) -> DataFrame:
    """``repo, src, degree, n_neighbours, cross_ratio, stress``."""
    cross = F.when(top_module("src") != top_module("dst"), F.col("weight")).otherwise(0.0)
    degree = F.sum("weight")
    out = edges.groupBy(repo, "src").agg(degree.alias("degree"), F.count(F.lit(1)).alias("n_neighbours"), (F.sum(cross) / degree).alias("cross_ratio"))
    return out.withColumn("stress", F.log1p("degree") * F.col("cross_ratio"))


def coverage_flag(n_touches: Column, n_neighbours: Column) -> Column:
    """E14."""
    return F.when(F.coalesce(n_touches, F.lit(0)) == 0, "missing_history").when(F.coalesce(n_neighbours, F.lit(0)) == 0, "low_signal").otherwise("ok")


def upper_median(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and the middle value of each column, the upper one of two; nulls don't count.

    One pass for all columns: values are counted for each group and column, and running counts in one global order of
    group, column and value tell where a group's middle lies, so a heavy group spans partitions. A group without any
    value has no row; null keys are a group.
    """
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    group = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00null")).alias(k) for k in keys])
    counts = df.select(group.alias("g"), entry.alias("e")).select("g", "e.i", "e.v").where("v is not null").groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(counts, [F.col("g"), F.col("i"), F.col("v")], ["n"])
    span = run.groupBy("g", "i").agg(F.min(F.col("run_n") - F.col("n")).alias("before"), F.sum("n").alias("size"))
    middle = run.join(span, ["g", "i"]).where(F.col("run_n") - F.col("before") > F.floor(F.col("size") / 2)).groupBy("g").agg(
        *[F.min(F.when(F.col("i") == i, F.col("v"))).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(columns)]
    )
    name = lambda k: F.when(F.col(f"g.{k}") != "\x00null", F.col(f"g.{k}")).cast(df.schema[k].dataType).alias(k)
    return middle.select(*[name(k) for k in keys], *columns)


def fallback(sources: list[tuple[str, Column, dict[str, Column]]], default: dict[str, Column], tag: str = "metric_source") -> list[Column]:
    """Columns from the first source whose condition holds, else the defaults, and the source's name (D-13).

    A matched source's null stays null: the test is whether it matched, not whether a value is there.
    """
    out = []
    for name in default:
        c = default[name]
        for _, ok, cols in reversed(sources):
            c = F.when(ok, cols[name]).otherwise(c)
        out.append(c.alias(name))
    which = F.lit("missing")
    for label, ok, _ in reversed(sources):
        which = F.when(ok, label).otherwise(which)
    return [*out, which.alias(tag)]
