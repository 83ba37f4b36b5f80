"""TF-IDF and heads of Spark's own library, for sparse features; ``heads`` has those on a few columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardise(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None, out: str = "features") -> DataFrame:
    """Columns as one vector, each less its mean over its population deviation (L1), both of the rows ``fit_on``.

    A constant column becomes 0; a null counts as the column's mean.
    """
    fit = df if fit_on is None else df.where(fit_on)
    s = fit.agg(*[f(c).alias(f"{a}_{i}") for i, c in enumerate(columns) for a, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    names = []
    for i, c in enumerate(columns):
        mean, dev = s[f"m_{i}"] or 0.0, s[f"d_{i}"] or 0.0
        df = df.withColumn(f"__z{i}", F.coalesce((F.col(c).cast("double") - mean) / dev, F.lit(0.0)) if dev else F.lit(0.0))
        names.append(f"__z{i}")
    return VectorAssembler(inputCols=names, outputCol=out).transform(df).drop(*names)


def logistic(train: DataFrame, label: str, features: str = "features", balanced: bool = True, c: float = 1.0):
    """L2-regularised logistic regression with the strength 1/c on the summed loss (L2): ``regParam`` is 1/(c n), and a
    balanced class weighs n / (classes x its rows)."""
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # a row for each class
    total = sum(n.values())
    w = F.lit(1.0)
    if balanced:
        for k, m in n.items():
            w = F.when(F.col(label) == k, total / (len(n) * m)).otherwise(w)
    family = "binomial" if len(n) <= 2 else "multinomial"
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="__w", regParam=1 / (c * max(1, total)), elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-9, family=family).fit(train.withColumn("__w", w))


def score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of class 1."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


class TfIdf:
    """TF-IDF of one column (L8): words of two letters or more in lower case, the ``terms`` most frequent ones of the texts
    that it is fitted on, 1 + ln(count), idf ln((1 + n) / (1 + df)) + 1, length 1.

    Words and weights come from the fitted texts only; others are transformed with them. ``bias``: one more feature of
    value 1, whose weight is a penalised intercept (L3).
    """

    def __init__(self, df: DataFrame, key: str, text: str, terms: int = 5000, bias: bool = False):
        self.key, self.text, self.terms, self.bias = key, text, terms, bias
        counts = self._counts(df)
        top = counts.groupBy("w").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("n"), "w").limit(terms).collect()  # ``terms`` bounds it
        n = df.select(key).distinct().count()
        rows = [(r["w"], i, math.log((1 + n) / (1 + r["df"])) + 1) for i, r in enumerate(top)]
        self.words = df.sparkSession.createDataFrame(rows, "w string, i int, idf double")

    def _counts(self, df: DataFrame) -> DataFrame:
        words = df.select(self.key, F.explode(F.regexp_extract_all(F.lower(F.col(self.text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))).alias("w"))
        return words.groupBy(self.key, "w").agg(F.count(F.lit(1)).alias("c"))

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``key, <out>``: sparse vectors; a text without known words has no row."""
        x = self._counts(df).join(F.broadcast(self.words), "w").select(self.key, "i", ((1 + F.log("c")) * F.col("idf")).alias("x"))
        rows = x.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        size, bias = self.terms + self.bias, self.bias

        def sparse(e, norm):
            at, v = [r["i"] for r in e], [r["x"] / norm for r in e]
            return SparseVector(size, at + [size - 1] * bias, v + [1.0] * bias)

        return rows.select(self.key, F.udf(sparse, VectorUDT(), useArrow=True)("e", "norm").alias(out))


def sparse_logistic(train: DataFrame, label: str, features: str = "features", c: float = 1.0):
    """Logistic regression on sparse vectors whose last feature is the bias: no other intercept, so it is penalised (L3)."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1 / (c * max(1, train.count())), elasticNetParam=0.0, standardization=False, fitIntercept=False, maxIter=300, tol=1e-9).fit(train)
