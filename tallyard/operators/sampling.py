"""Splits, samples, folds and constructed pairs. Order comes from md5 text, so it is stable everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_group, global_position


def shuffle_key(*parts: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_unit(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) from the values, the same under any partitioning."""
    return F.conv(F.substring(shuffle_key(*parts, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def group_split(groups: DataFrame, key: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``key, split``: groups in hashed order; val gets max(1, int(val n)), test max(1, n - int(train n) - n_val), the
    rest is train (K1, K5). One group gives no training part, as stated by that rule."""
    once = groups.where(F.col(key).isNotNull()).select(key).distinct()
    placed = global_position(once, [shuffle_key(F.col(key), seed=seed), F.col(key)])
    n = placed.count()
    n_val = max(1, int(val * n))
    n_test = max(1, n - int(train * n) - n_val)
    p = F.col("position")
    return placed.select(key, F.when(p < n_val, "val").when(p < n_val + n_test, "test").otherwise("train").alias("split"))


def largest_cap(df: DataFrame, stratum: str, target: int) -> int:
    """The largest whole cap with sum(min(count, cap)) <= target; the largest count if all rows fit.

    Strata are counted, and their counts counted: what reaches the driver are the different sizes.
    """
    sizes = df.groupBy(stratum).count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    total = lambda cap: sum(min(r["count"], cap) * r["n"] for r in sizes)
    lo, hi = 0, max((r["count"] for r in sizes), default=0)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if total(mid) <= target else (lo, mid - 1)
    return lo


def stratified_cap(df: DataFrame, stratum: str, key: str, target: int = 50_000, seed: int = 42) -> DataFrame:
    """At most the largest cap of rows of each stratum, by hashed order (K2, K3). ``target`` is the reference's."""
    cap = largest_cap(df, stratum, target)
    return first_per_group(df, [stratum], [shuffle_key(F.col(key), seed=seed), F.col(key)], cap)


def bounded_sample(df: DataFrame, group: str, key: str, per_group: int, total: int, seed: int) -> DataFrame:
    """``per_group`` rows of each group, then ``total`` of those."""
    order = [shuffle_key(F.col(key), seed=seed), F.col(key)]
    return first_per_group(df, [group], order, per_group).orderBy(*order).limit(total)


def newest_shuffled(df: DataFrame, newest: list[Column], key: str, n: int, seed: int, over: int = 6) -> DataFrame:
    """``n`` rows in hashed order out of the ``over`` times as many newest."""
    return df.orderBy(*newest).limit(over * n).orderBy(shuffle_key(F.col(key), seed=seed), F.col(key)).limit(n)


def round_robin(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    """Rows with a ``chunk``: dealt out one by one in a stated order, so chunks differ by one row at most."""
    return global_position(df, by).withColumn("chunk", F.pmod("position", F.lit(n)).cast("int")).drop("position")


def random_partners(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``key, partner``: each key with the one behind it in hashed order, the last with the first (I10). One key alone has
    itself for partner."""
    placed = global_position(df.where(F.col(key).isNotNull()).select(key).distinct(), [shuffle_key(F.col(key), seed=seed), F.col(key)])
    n = max(1, placed.count())
    behind = placed.select(F.pmod(F.col("position") - 1, F.lit(n)).alias("position"), F.col(key).alias("partner"))
    return placed.join(behind, "position").select(key, "partner")


def group_folds(df: DataFrame, group: str, k: int, heavy: float = 0.001, buckets: int = 1024, seed: int = 42) -> DataFrame:
    """``group, n, fold`` with whole groups and folds of like size (K6).

    Largest first to the smallest fold, as far as size matters: groups above ``heavy`` of all rows (at most 1/heavy of
    them) one by one, all others as ``buckets`` hash buckets. The driver sees only those.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bucket = F.floor(hash_unit(F.coalesce(F.col(group).cast("string"), F.lit("")), seed=seed) * buckets).cast("int")
    is_big = F.col("n") > total * heavy
    units = [(r["n"], None, r[group]) for r in sizes.where(is_big).collect()]
    units += [(r["n"], r["b"], None) for r in sizes.where(~is_big).groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()]
    load, big, small = [0] * k, [], []
    for n, b, g in sorted(units, key=lambda u: (-u[0], u[1] is not None, str(u[2]), u[1] or 0)):
        f = load.index(min(load))
        load[f] += n
        (small if b is not None else big).append((b if b is not None else g, f))
    spark = df.sparkSession
    a = sizes.where(is_big).join(F.broadcast(spark.createDataFrame(big, f"__g {df.schema[group].dataType.simpleString()}, fold int")), F.col(group).eqNullSafe(F.col("__g")))
    b = sizes.where(~is_big).withColumn("__b", bucket).join(F.broadcast(spark.createDataFrame(small, "__b int, fold int")), "__b")
    return a.select(group, "n", "fold").unionByName(b.select(group, "n", "fold"))


def class_folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Rows with a ``fold``: each class is dealt out in hashed order, so folds hold like shares of it (K7)."""
    placed = global_position(df, [F.col(label), shuffle_key(F.col(key), seed=seed), F.col(key)])
    starts = placed.groupBy(F.col(label).alias("__class")).agg(F.min("position").alias("__start"))
    own = placed.join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("__class")))  # a row for each class
    return own.withColumn("fold", F.pmod(F.col("position") - F.col("__start"), F.lit(k))).drop("position", "__start", "__class")


def pair_draws(df: DataFrame, group: str, label: str, key: str, per_group: int = 300, seed: int = 42) -> DataFrame:
    """``group, draw, pos, neg``: up to ``per_group`` pairs of a positive and a negative key, drawn with replacement (K8).
    The default is the reference's.

    Draws are numbered and each takes its two members by hash, so no group's pairs are ever built. Members are numbered
    by global position, so a large group isn't gathered either. Groups without one of both classes give none.
    """
    placed = global_position(df.where(F.col(label).isNotNull() & F.col(group).isNotNull()).select(group, label, key).distinct(), [F.col(group), F.col(label), F.col(key)])
    spans = placed.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("np"), F.count_if(F.col(label) == 0).alias("nn"), F.min(F.when(F.col(label) == 1, F.col("position"))).alias("p0"), F.min(F.when(F.col(label) == 0, F.col("position"))).alias("n0"))
    draws = spans.where("np > 0 and nn > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.least(F.lit(per_group), F.col("np") * F.col("nn")).cast("int"))))
    at = lambda side, n, start: F.col(start) + F.floor(hash_unit(F.col(group), F.col("draw"), F.lit(side), seed=seed) * F.col(n)).cast("bigint")
    want = draws.select(group, "draw", at("p", "np", "p0").alias("pp"), at("n", "nn", "n0").alias("nq"))
    # every row may be a member: the written table is small enough for an automatic broadcast long before its rows fit into the driver
    pick = lambda pos, name: placed.select(F.col("position").alias(pos), F.col(key).alias(name)).hint("merge")
    return want.join(pick("pp", "pos"), "pp").join(pick("nq", "neg"), "nq").select(group, "draw", "pos", "neg")


def variants(df: DataFrame, key: str, columns: list[str], kinds: dict[str, float], seed: int) -> DataFrame:
    """Each row as it is (``real``, label 1) and once for each kind with its columns scaled by up to that factor (K9)."""
    names = F.array(F.lit("real"), *[F.lit(k) for k in kinds])
    out = df.withColumn("kind", F.explode(names)).withColumn("label", (F.col("kind") == "real").cast("int"))
    factor = F.lit(1.0)
    for name, size in kinds.items():
        factor = F.when(F.col("kind") == name, 1 + size * hash_unit(F.col(key), F.col("kind"), seed=seed)).otherwise(factor)
    return out.withColumns({c: F.col(c).cast("double") * factor for c in columns})
