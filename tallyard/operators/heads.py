"""Heads on a few numeric columns: logistic, softmax and ridge by Newton's method, cross-validation, a small network.

What is fitted needs sums over the rows only (gradients, second derivatives, products of columns): each task sends one
row of them, so the driver holds as many numbers as columns squared. Scoring is a column expression and stays in the
JVM. The rows that are fitted on are written once, standardised.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Stored, path_exists


@dataclass
class Head:
    """A linear head with its scaler."""

    columns: list[str]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float

    def scaled(self) -> list[Column]:
        """The columns less their mean over their deviation; null counts as the mean, a constant column as 0."""
        return [F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) if s else F.lit(0.0) for c, m, s in zip(self.columns, self.mean, self.scale)]

    def linear(self) -> Column:
        total = F.lit(float(self.intercept))
        for x, w in zip(self.scaled(), self.coef):
            total = total + x * float(w)
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.linear()))

    def write(self, spark: SparkSession, path: str) -> None:
        """As one JSON document."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Head:
        if not path_exists(spark, f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"no head at {path}")
        return cls(**json.loads(spark.read.text(path).first()[0]))


def _sums(df: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what ``part`` makes of each batch: one row a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return np.sum([np.frombuffer(r[0]) for r in df.mapInArrow(run, "total binary").collect()] or [np.zeros(size)], axis=0)


def _rows(b: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's first column, an array of ``d`` numbers a row, with a last column of ones."""
    return np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), np.ones((b.num_rows, 1))], 1)


def scaler(df: DataFrame, columns: Sequence[str]) -> Head:
    """A head without weights: means and population deviations of the rows (L1)."""
    s = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return Head(list(columns), [float(x or 0.0) for x in s[::2]], [float(x or 0.0) for x in s[1::2]], [0.0] * len(columns), 0.0)


class Table:
    """Standardised rows ``x array<double>, y double`` and further columns, written once in parts of some 50,000 rows."""

    def __init__(self, df: DataFrame, head: Head, y: Column, **more: Column):
        rows = df.select(F.array(*head.scaled()).alias("x"), y.cast("double").alias("y"), *[c.alias(n) for n, c in more.items()])
        self._stored, self.d = Stored(rows, "rows"), len(head.columns)
        n = self._stored.df.count()
        self.df = self._stored.df.coalesce(max(1, -(-n // 50_000)))

    def drop(self) -> None:
        self._stored.drop()


def _softmax(rows: DataFrame, d: int, weights: np.ndarray, c: float, penalise_intercept: bool, rounds: int = 40) -> np.ndarray:
    """Weights (d + 1, classes) of the L2-regularised softmax of rows ``x, y`` with classes 0 to k - 1, each row weighted by
    its class; two classes have one column of weights. Newton's method, with half steps where the loss would rise."""
    k = len(weights)
    cols = 1 if k == 2 else k
    w, size = np.zeros((d + 1, cols)), (d + 1) * cols
    keep = np.ones((d + 1, cols))
    if not penalise_intercept:
        keep[-1] = 0

    def part(b: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
        x, y = _rows(b, d), b.column(1).to_numpy().astype(int)
        z = x @ w
        z = np.concatenate([np.zeros_like(z), z], 1) if cols == 1 else z
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        sw = weights[y]
        loss = -(sw * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
        r = p.copy()
        r[np.arange(len(y)), y] -= 1
        r, q = (r[:, 1:], p[:, 1:]) if cols == 1 else (r, p)
        g = x.T @ (r * sw[:, None])
        h = np.zeros((cols, d + 1, cols, d + 1))
        for i in range(cols):
            for j in range(i, cols):
                h[i, :, j] = (x * (sw * q[:, i] * ((i == j) - q[:, j]))[:, None]).T @ x
                h[j, :, i] = h[i, :, j].T
        return np.concatenate([[loss], g.T.ravel(), h.ravel()])

    best, step, at = np.inf, None, w
    for _ in range(rounds):
        s = _sums(rows, 1 + size + size * size, lambda b, at=at: part(b, at))
        loss = s[0] + (keep * at * at).sum() / (2 * c)
        if loss > best + 1e-9 * abs(best):
            step = step / 2
            at = w - step
            continue
        w, drop, best = at, best - loss, loss
        g = s[1 : 1 + size] + (keep * w / c).T.ravel()
        h = s[1 + size :].reshape(size, size) + np.diag((keep / c).T.ravel() + 1e-10)
        if np.abs(g).max() < 1e-7 or drop < 1e-12 * abs(best):
            break
        step = np.linalg.solve(h, g).reshape(cols, d + 1).T
        at = w - step
    return w


def class_weights(rows: DataFrame, k: int, balanced: bool) -> np.ndarray:
    """Weight of each class 0 to k - 1: rows over classes times its rows if balanced, else 1."""
    n = np.zeros(k)
    for y, m in rows.groupBy("y").count().collect():
        n[int(y)] = m
    return np.where(n > 0, n.sum() / (max(1, (n > 0).sum()) * np.maximum(n, 1)), 1.0) if balanced else np.ones(k)


def fit_logistic(df: DataFrame, columns: Sequence[str], label: str, balanced: bool = True, c: float = 1.0, penalise_intercept: bool = False) -> Head:
    """Logistic head with L2 strength 1/c on the summed loss (L2); ``penalise_intercept``: on the intercept too, as for
    sparse text (L3). Rows with a null label aren't fitted on; with no row, or one class only, every score is that class's share."""
    df = df.where(F.col(label).isNotNull())
    head = scaler(df, columns)
    t = Table(df, head, F.col(label))
    shares = {int(y): n for y, n in t.df.groupBy("y").count().collect()}
    if len(shares) < 2:
        head.intercept = 30.0 if 1 in shares else -30.0
    else:
        w = _softmax(t.df.select("x", "y"), t.d, class_weights(t.df, 2, balanced), c, penalise_intercept)[:, 0]
        head.coef, head.intercept = w[:-1].tolist(), float(w[-1])
    t.drop()
    return head


def fit_pairwise(df: DataFrame, columns: Sequence[str], draws: DataFrame, key: str, c: float = 1.0) -> Head | None:
    """A head on differences of a positive and a negative row (L12): ``draws`` has their keys as ``pos`` and ``neg``; each
    pair counts in both signs. None without a draw, where ``fit_logistic`` stands in."""
    head = scaler(df, columns)
    one = df.dropDuplicates([key]).select(F.col(key).alias("__key"), F.array(*head.scaled()).alias("v"))
    side = lambda name: one.select(F.col("__key").alias(name), F.col("v").alias(f"{name}_v")).hint("merge")  # noqa: E731  never all rows by way of the driver
    kept = Stored(draws.join(side("pos"), "pos").join(side("neg"), "neg").select(F.zip_with("pos_v", "neg_v", lambda a, b: a - b).alias("d")), "differences")
    n = 2 * kept.df.count()
    if not n:
        kept.drop()
        return None
    both = kept.df.select(F.inline(F.array(F.struct(F.col("d").alias("x"), F.lit(1.0).alias("y")), F.struct(F.transform("d", lambda x: -x).alias("x"), F.lit(0.0).alias("y")))))
    w = _softmax(both.coalesce(max(1, -(-n // 50_000))), len(columns), np.ones(2), c, False)[:, 0]
    kept.drop()
    head.coef, head.intercept = w[:-1].tolist(), float(w[-1])
    return head


def _solve_ridge(gram: np.ndarray, d: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, deviation, weights and intercept of a ridge fit, from the products of (columns, target, 1)."""
    n = gram[-1, -1]
    mean, var = gram[:d, -1] / n, gram[np.arange(d), np.arange(d)] / n - (gram[:d, -1] / n) ** 2
    scale = np.sqrt(np.maximum(var, 0))
    scale[scale < 1e-12 * (1 + np.abs(mean))] = 0
    inv = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
    xx = (gram[:d, :d] - n * np.outer(mean, mean)) * np.outer(inv, inv)
    xy = (gram[:d, d] - mean * gram[-1, d]) * inv
    return mean, scale, np.linalg.solve(xx + (alpha if alpha else 1e-12) * np.eye(d), xy), gram[-1, d] / n


def _grams(df: DataFrame, columns: Sequence[str], target: str, fold: str | None, k: int) -> np.ndarray:
    """(fold, products of (columns, target, 1)), columns less a common origin so that no digits are lost."""
    d = len(columns)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in [*columns, target]]).alias("x"), (F.lit(0) if fold is None else F.col(fold)).cast("int").alias("fold"))

    def part(b: pa.RecordBatch) -> np.ndarray:
        x, f = _rows(b, d + 1), b.column(1).to_numpy()
        return np.concatenate([(x[f == i].T @ x[f == i]).ravel() for i in range(k)])

    return _sums(rows, k * (d + 2) ** 2, part).reshape(k, d + 2, d + 2)


def fit_ridge(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 1.0) -> Head:
    """Ridge head with penalty ``alpha`` on the summed squares of standardised columns (L4). Rows with a null are left out."""
    gram = _grams(df.dropna(subset=[*columns, target]), columns, target, None, 1)[0]
    if not gram[-1, -1]:
        return Head(list(columns), [0.0] * len(columns), [0.0] * len(columns), [0.0] * len(columns), 0.0)
    mean, scale, w, b = _solve_ridge(gram, len(columns), alpha)
    return Head(list(columns), mean.tolist(), scale.tolist(), w.tolist(), float(b))


def cross_validated_ridge(df: DataFrame, columns: Sequence[str], target: str, fold: str, k: int, alpha: float = 1.0) -> list[float]:
    """R2 on each of ``k`` folds of a ridge head fitted on the others (L7), all from one pass: the products of a fold's
    columns serve the fits without it and its own test. Scalers are fitted on training rows only. A fold without rows or with a
    constant target has none."""
    d, grams = len(columns), _grams(df.dropna(subset=[*columns, target]), columns, target, fold, k)
    out = []
    for i in range(k):
        rest, own = grams.sum(0) - grams[i], grams[i]
        n = own[-1, -1]
        total = own[d, d] - own[d, -1] ** 2 / n if n else 0.0
        if not n or not rest[-1, -1] or total <= 1e-12 * max(1.0, own[d, d]):
            continue
        mean, scale, w, b = _solve_ridge(rest, d, alpha)
        w = np.where(scale > 0, w / np.where(scale > 0, scale, 1), 0)
        guess = np.concatenate([w, [-1.0], [b - w @ mean]])  # of the residual, by the products' order
        out.append(1 - guess @ own @ guess / total)
    return out


def cross_validated_classes(df: DataFrame, columns: Sequence[str], label: str, k_classes: int, fold: str, k: int, c: float = 1.0) -> list[float]:
    """Balanced accuracy on each of ``k`` folds of a balanced softmax head fitted on the others (L6). Classes are 0 to
    ``k_classes`` - 1; a class that a fold lacks doesn't count there. Scalers are fitted on training rows only."""
    df, out, d = df.where(F.col(label).isNotNull()), [], len(columns)
    for i in range(k):
        head = scaler(df.where(F.col(fold) != i), columns)
        t = Table(df, head, F.col(label), fold=F.col(fold).cast("int"))
        train, test = t.df.where(F.col("fold") != i).select("x", "y"), t.df.where(F.col("fold") == i).select("x", "y")
        w = _softmax(train, d, class_weights(train, k_classes, True), c, False)

        def confusion(b: pa.RecordBatch, w=w) -> np.ndarray:
            z, y = _rows(b, d) @ w, b.column(1).to_numpy().astype(int)
            guess = (z[:, 0] > 0).astype(int) if z.shape[1] == 1 else z.argmax(1)
            return np.bincount(y * k_classes + guess, minlength=k_classes**2).astype(float)

        m = _sums(test, k_classes**2, confusion).reshape(k_classes, k_classes)
        t.drop()
        seen = m.sum(1) > 0
        if seen.any():
            out.append(float(np.mean(np.diag(m)[seen] / m.sum(1)[seen])))
    return out


def small_network(df: DataFrame, columns: Sequence[str], label: str, hidden: int = 128, max_rows: int = 20_000, rounds: int = 60, rate: float = 1e-3, seed: int = 42) -> tuple[Head, list[np.ndarray]]:
    """Scaler and weights of a network with one layer of ``hidden`` rectified units and a logistic output (L9), fitted by
    Adam on at most ``max_rows`` rows, chosen by hash of the values: the one bounded sample here."""
    df = df.where(F.col(label).isNotNull())
    head = scaler(df, columns)
    rows = df.select(F.array(*head.scaled()).alias("x"), F.col(label).cast("double").alias("y"))
    t = rows.orderBy(F.xxhash64(F.lit(seed), "x", "y"), "y").limit(max_rows).toArrow()
    d, rng = len(columns), np.random.default_rng(seed)
    x, y = np.array(t.column("x").to_pylist(), float).reshape(-1, d), t.column("y").to_numpy()
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / max(1, d)), np.zeros(hidden), rng.standard_normal(hidden) * np.sqrt(1 / hidden), np.zeros(1)]
    m, u, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 200):
            at = order[lo : lo + 200]
            a = np.maximum(x[at] @ p[0] + p[1], 0)
            r = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -30, 30))) - y[at]) / len(at)
            back = np.outer(r, p[2]) * (a > 0)
            step += 1
            for v, g, mi, ui in zip(p, [x[at].T @ back, back.sum(0), a.T @ r, np.array([r.sum()])], m, u):
                mi += 0.1 * (g - mi)
                ui += 0.001 * (g * g - ui)
                v -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(ui / (1 - 0.999**step)) + 1e-8)
    return head, p


def network_score(df: DataFrame, head: Head, weights: list[np.ndarray], out: str = "score") -> DataFrame:
    """The rows with the network's probability: matrix products over Arrow batches."""
    d = len(head.columns)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        a = np.maximum(np.array(x.tolist(), float).reshape(-1, d) @ weights[0] + weights[1], 0)
        return pd.Series(1 / (1 + np.exp(-np.clip(a @ weights[2] + weights[3][0], -30, 30))))

    return df.withColumn(out, score(F.array(*head.scaled())))


def covered(df: DataFrame, column: str, least: float = 0.05) -> bool:
    """Whether so large a part of the rows has the column that it may be used as a channel."""
    n, have = df.agg(F.count(F.lit(1)), F.count(column)).first()
    return bool(n) and have / n >= least
