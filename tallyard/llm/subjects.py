"""Subject areas of documents (problem 9).

A segment (sentence or line) is the average of the embeddings of its words, their subwords and joined neighbours, and
goes into one logistic output for each subject, independent of the others. What the segments say for a subject, in all
and as a part of the document, gives the document's probability. Embeddings and outputs are trained through that
probability, by full-batch steps whose gradients are summed in the executors, and every document is scored by the very
same function. From what probability on a subject counts is set on labelled documents that took no part in the training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Stored

_RUN = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÄÖÜ])(?=[A-ZÄÖÜ])")
_SEGMENT = re.compile(r"[.!?]\s+|[\r\n]+")


@lru_cache(200_000)
def _parts(run: str) -> tuple[str, ...]:
    """Words of a run of letters, in lower case."""
    return tuple(p.lower() for p in (_CAMEL.split(run) if not (run.islower() or run.isupper()) else (run,)))


def segments(text: str | None) -> list[list[str]]:
    """Words of each sentence or line; identifiers fall into their words."""
    out = []
    for s in _SEGMENT.split(text or ""):
        w = [p for x in _RUN.findall(s) for p in _parts(x)]
        if w:
            out.append(w)
    return out


def word_features(w: str) -> list[str]:
    """The word and its subwords of four to six letters."""
    if len(w) < 5:
        return [w]
    z = f"<{w}>"
    return [w, *{"#" + z[i : i + n] for n in (4, 5, 6) for i in range(len(z) - n + 1)}]


def segment_features(w: list[str]) -> list[str]:
    """Features of a segment: of each different word, and each pair of neighbours written as one word."""
    return [f for x in dict.fromkeys(w) for f in word_features(x)] + [a + b for a, b in dict.fromkeys(zip(w, w[1:]))]


#: A segment's average is scaled by SCALE, and counts at least LEAST words, so that a lone word doesn't decide alone.
SCALE, LEAST = 16.0, 4
#: A subject is certain once some two segments and a fifth of all speak for it; GAIN turns that into a probability.
ENOUGH, PART, GAIN = 2.0, 0.2, 0.7


def segment_scale(words: np.ndarray) -> np.ndarray:
    return (SCALE / np.maximum(words, LEAST)).astype(np.float32)


def certainty(count: np.ndarray, n_segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Harmonic mean of how far the segments that speak for a subject are enough by number and as a part, and what a
    change of the number changes in it."""
    a, b = np.maximum(count / ENOUGH, 1e-6), np.maximum(count / (PART * n_segments[:, None]), 1e-6)
    m = 2 * a * b / (a + b)
    slope = 2 * (b * b / ENOUGH + a * a / (PART * n_segments[:, None])) / (a + b) ** 2
    return m, slope, 1 - np.exp(-GAIN * m)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def per_document(values: np.ndarray, n_segments: np.ndarray) -> np.ndarray:
    """Sums of the rows of each document; zeros for one without segments."""
    out = np.zeros((len(n_segments), values.shape[1]), values.dtype)
    full = np.flatnonzero(n_segments)
    if full.size:
        out[full] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(n_segments)])[full])
    return out


class Model:
    """``evidence``: what each feature adds to a segment's outputs (its embedding times the outputs' weights), and the
    outputs' ``offsets``; ``limit``: the probability from which on a subject counts."""

    def __init__(self, subjects: list[str], features: list[str], evidence: np.ndarray, offsets: np.ndarray, limit: float):
        self.subjects, self.features, self.evidence, self.offsets, self.limit = subjects, features, evidence, offsets, limit
        self._number = {f: i for i, f in enumerate(features)}
        self._clear()

    def __reduce__(self):
        return Model, (self.subjects, self.features, self.evidence, self.offsets, self.limit)

    def _clear(self) -> None:
        """Forget the words met so far: numbers of runs' words, the words, and their evidence (row 0: none)."""
        self._runs: dict[str, tuple[int, ...]] = {}
        self._words: dict[str, int] = {}
        self._row_of: list[int] = []
        self._rows = [np.zeros(len(self.subjects), np.float32)]

    def _learn(self, run: str) -> tuple[int, ...]:
        found = []
        for w in _parts(run):
            if w not in self._words:
                self._words[w] = len(self._words)
                e = [i for f in word_features(w) if (i := self._number.get(f)) is not None]
                self._row_of.append(len(self._rows) if e else 0)
                if e:
                    self._rows.append(self.evidence[e].sum(0))
            found.append(self._words[w])
        self._runs[run] = numbers = tuple(found)
        return numbers

    def outputs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logistic outputs of each segment for each subject, and how many segments each text has. Words are numbered as they
        come; what lies in a segment once, and which neighbours are a feature, is found for all texts together."""
        if len(self._runs) > 200_000:
            self._clear()
        runs, learn, flat, size, per_text = self._runs, self._learn, [], [], []
        for t in texts:
            before = len(size)
            for part in _SEGMENT.split(t or ""):
                at = len(flat)
                for r in _RUN.findall(part):
                    flat += runs.get(r) or learn(r)
                if len(flat) > at:
                    size.append(len(flat) - at)
            per_text.append(len(size) - before)
        n, words = np.array(per_text, np.int64), np.array(size, np.int64)
        if not size:
            return np.zeros((0, len(self.subjects)), np.float32), n
        w, seg, many = np.array(flat, np.int64), np.repeat(np.arange(len(words)), words), len(self._words)
        key = np.unique(seg * many + w)
        row = np.array(self._row_of)[key % many]
        hit, at = [key[row > 0] // many], [np.array(self._rows)[row[row > 0]]]
        same = seg[1:] == seg[:-1]
        pair, where_ = np.unique(w[:-1][same] * many + w[1:][same], return_inverse=True)
        names = list(self._words)
        number = np.array([self._number.get(names[a] + names[b], -1) for a, b in zip((pair // many).tolist(), (pair % many).tolist())], np.int64)
        if len(number) and (number >= 0).any():
            of = number[where_.ravel()]
            key = np.unique(seg[1:][same][of >= 0] * len(self.features) + of[of >= 0])
            hit.append(key // len(self.features))
            at.append(self.evidence[key % len(self.features)])
        s, v = np.concatenate(hit), np.concatenate(at)
        order = np.argsort(s, kind="stable")
        out = np.zeros((len(words), len(self.subjects)), np.float32)
        if len(s):
            used, first = np.unique(s[order], return_index=True)
            out[used] = np.add.reduceat(v[order], first)
        return sigmoid(out * segment_scale(words)[:, None] + self.offsets), n

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Texts by subjects; 0 for a text without words."""
        out, n = self.outputs(texts)
        return np.where((n > 0)[:, None], certainty(per_document(out, n), np.maximum(1, n))[2], 0)

    def decide(self, texts: list[str | None]) -> np.ndarray:
        """Texts by subjects: whether a text is about a subject."""
        return self.probabilities(texts) >= self.limit


#: Limits that are tried, the usual one first.
_LIMITS = [0.4, 0.42, 0.38, 0.45, 0.35, 0.5, 0.3, 0.55]


def labelled_documents(docs: DataFrame, labels: DataFrame, areas: DataFrame, subjects: list[str], max_labelled: int) -> DataFrame:
    """``text, y array<double>, use int``: the labelled sample, bounded by ``max_labelled`` documents, and the
    descriptions of the subjects. By hash, a tenth of the documents sets the limit (use 1), another tells how good the
    model is (use 2), and the rest is trained on (use 0)."""
    marks = F.array(*[F.max(F.when(F.col("subject") == s, 1.0).otherwise(0.0)) for s in subjects])
    y = labels.where("doc_id is not null").groupBy("doc_id").agg(marks.alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id")  # at most max_labelled rows
    ten = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10))
    own = own.select("text", "y", F.when(ten == 0, 1).when(ten == 1, 2).otherwise(0).alias("use"))
    told = areas.select(
        F.concat_ws(" ", F.col("subject"), F.col("description")).alias("text"), F.array(*[F.when(F.col("subject") == s, 1.0).otherwise(0.0) for s in subjects]).alias("y"), F.lit(0).alias("use")
    )
    return own.unionByName(told).where("text is not null")


def choose_features(sample: DataFrame, n_subjects: int) -> list[str]:
    """Features that go with a subject far more often than by chance: three deviations, which no feature of fewer than
    three documents has. How many there are is bounded by the labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        ids, sizes, ys = [], [], []
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {f for w in segments(t) for f in segment_features(w)}
                ids += [number.setdefault(f, len(number)) for f in own]
                sizes.append(len(own))
                ys.append([1.0, *y])
        if not number:
            return
        at, doc = np.array(ids), np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.bincount(at, c[doc], len(number)) for c in np.array(ys).T]
        keys = pa.array(list(number), pa.string())
        for i in range(0, len(number), 50_000):
            yield pa.RecordBatch.from_arrays([keys.slice(i, 50_000), *[pa.array(c[i : i + 50_000]) for c in sums]], names=["feature", "n", *[f"y{i}" for i in range(n_subjects)]])

    names = ["n", *[f"y{i}" for i in range(n_subjects)]]
    sums = sample.select("text", "y").mapInArrow(run, "feature string, " + ", ".join(f"{c} double" for c in names)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    prior = sample.agg(*[F.avg(F.col("y")[i]) for i in range(n_subjects)]).first()
    if prior is None or prior[0] is None:
        return []
    z = F.greatest(*[(F.col(f"y{i}") - F.col("n") * float(p)) / F.sqrt(F.col("n") * float(p * (1 - p)) + 0.5) for i, p in enumerate(prior)], F.lit(-1.0))
    top = F.greatest(*[F.col(f"y{i}") for i in range(n_subjects)], F.lit(0.0))
    return sorted(r[0] for r in sums.where(top > F.col("n") * 0.3).withColumn("z", z).where("z > 3").select("feature").collect())


def gradient(e: np.ndarray, w: np.ndarray, c: np.ndarray, idx: np.ndarray, n_features: np.ndarray, words: np.ndarray, n_segments: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the documents' summed cross entropy. ``idx``: features, one segment after another; ``n_features`` and
    ``words``: of each segment; ``n_segments``: of each document."""
    scale = segment_scale(words)[:, None]
    full = np.flatnonzero(n_features)
    h = np.zeros((len(words), e.shape[1]), np.float32)
    if full.size:
        h[full] = np.add.reduceat(e[idx], (np.cumsum(n_features) - n_features)[full])
    h *= scale
    s = sigmoid(h @ w + c)
    m, slope, q = certainty(per_document(s, n_segments), np.maximum(1, n_segments))
    q = np.clip(q, 1e-5, 1 - 1e-5)
    d = (q - y) / (q * (1 - q)) * GAIN * np.exp(-GAIN * m) * slope
    d = (np.repeat(d, n_segments, axis=0) * s * (1 - s)).astype(np.float32)
    g = np.zeros_like(e)
    if full.size:
        back, by = d @ w.T * scale, np.argsort(idx, kind="stable")
        used, first = np.unique(idx[by], return_index=True)
        g[used] = np.add.reduceat(back[np.repeat(np.arange(len(words)), n_features)[by]], first)
    return [g, h.T @ d, d.sum(0)]


def train(sample: DataFrame, subjects: list[str], features: list[str], dim: int = 16, rounds: int = 25, rate: float = 0.05, decay: float = 5e-3, part_docs: int = 4000, block: int = 65_536, seed: int = 3):
    """Embeddings (features x dim), weights (dim x subjects) and offsets, after ``rounds`` synchronous steps.

    A step is a gradient in each partition of ``part_docs`` documents, summed block by block in the executors; the
    driver gets the sum only. Few rounds are meant: more would fit the wrong labels.
    """
    spark, k = sample.sparkSession, len(subjects)
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, n, words = [], [], []
            for t in b.column(0).to_pylist():
                seg = segments(t)
                own = [[j for f in segment_features(w) if (j := number.value.get(f)) is not None] for w in seg]
                idx.append([j for x in own for j in x])
                n.append([len(x) for x in own])
                words.append([len(w) for w in seg])
            ints = [pa.array(x, pa.list_(pa.int32())) for x in (idx, n, words)]
            yield pa.RecordBatch.from_arrays([*ints, b.column(1)], names=["idx", "n", "words", "y"])

    parts = max(1, -(-sample.count() // part_docs))
    stored = Stored(sample.select("text", "y").repartition(parts).mapInArrow(rows, "idx array<int>, n array<int>, words array<int>, y array<double>"), "labelled")
    table, n_docs = stored.df, max(1, stored.df.count())
    rng = np.random.default_rng(seed)
    p = [rng.standard_normal((len(features), dim)) * 0.05, rng.standard_normal((dim, k)) * 0.3, np.full(k, -2.0)]
    m, u = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32) for x in group.column("g").to_pylist()], axis=0)
        return pa.table([group.column("at").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["at", "g"])

    for step in range(1, rounds + 1):
        now = spark.sparkContext.broadcast([x.astype(np.float32) for x in p])

        def own(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(x.size for x in now.value), np.float32)
            for b in batches:
                if b.num_rows:
                    flat = [b.column(i).flatten().to_numpy() for i in range(4)]
                    g = gradient(*now.value, *flat[:3], np.diff(b.column(1).offsets.to_numpy()), flat[3].reshape(b.num_rows, -1))
                    total += np.concatenate([x.ravel() for x in g])
            at = list(range(0, len(total), block))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + block].tobytes() for i in at], pa.binary())], names=["at", "g"])

        sums = table.mapInArrow(own, "at int, g binary")
        if parts > 1:
            sums = sums.repartition(parts, "at").groupBy("at").applyInArrow(add, "at int, g binary")
        total = np.zeros(sum(x.size for x in p), np.float32)
        for at, raw in sums.collect():
            g = np.frombuffer(raw, np.float32)
            total[at : at + len(g)] += g
        now.destroy()
        for i, (x, t) in enumerate(zip(p, np.split(total, np.cumsum([x.size for x in p])[:-1]))):
            g = t.reshape(x.shape) / n_docs + (decay / 10 if i == 0 else decay if i == 1 else 0) * x
            m[i] = 0.9 * m[i] + 0.1 * g
            u[i] = 0.999 * u[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(u[i] / (1 - 0.999**step)) + 1e-8)
    stored.drop()
    return p


def fit(docs: DataFrame, labels: DataFrame, areas: DataFrame, max_labelled: int = 20_000, **options) -> tuple[Model, float]:
    """The model and its F1 on a tenth of the labelled documents that neither the training nor the limit has seen.
    ``max_labelled`` bounds the labelled documents used; ``options`` are those of ``train``."""
    subjects = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    both = Stored(labelled_documents(docs, labels, areas, subjects, max_labelled), "sample")
    sample = both.df.where("use = 0")
    features = choose_features(sample, len(subjects)) if subjects else []
    if not features:
        both.drop()
        return Model(subjects, [], np.zeros((0, len(subjects)), np.float32), np.full(len(subjects), -30.0), _LIMITS[0]), 0.0
    e, w, c = train(sample, subjects, features, **options)
    model = Model(subjects, features, (e @ w).astype(np.float32), c.astype(np.float32), _LIMITS[0])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = shared.value, np.zeros((2, len(_LIMITS), 3), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q = model.probabilities(b.column(0).to_pylist())
            y = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) > 0
            for use in (1, 2):
                own = b.column(2).to_numpy() == use
                for i, limit in enumerate(_LIMITS):
                    got = q[own] >= limit
                    out[use - 1, i] += (got & y[own]).sum(), got.sum(), y[own].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.shape[0] * out.shape[1], dtype=np.int32)), *[pa.array(x) for x in out.reshape(-1, 3).T]], names=["i", "hit", "got", "want"])

    held = both.df.where("use > 0").select("text", "y", "use")
    sums = held.mapInArrow(judge, "i int, hit bigint, got bigint, want bigint").groupBy("i").agg(F.sum("hit"), F.sum("got"), F.sum("want")).collect()
    f1 = {r[0]: 2 * r[1] / max(1, r[2] + r[3]) for r in sums}
    best = max(range(len(_LIMITS)), key=lambda i: (round(f1.get(i, 0), 3), -i))
    both.drop()
    model.limit = _LIMITS[best]
    return model, f1.get(len(_LIMITS) + best, 0.0)


def assign(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, subject`` of every document; a document about nothing has no row, nor has a null or empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                t, k = np.nonzero(model.decide(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array([model.subjects[i] for i in k], pa.string())], names=["doc_id", "subject"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "doc_id bigint, subject string").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    docs = read("documents")
    model, _ = fit(docs, read("doc_labels"), read("subject_areas"))
    return assign(docs, model)


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of each subject, ``(none)`` for documents without one: ``subject, n_documents, n_chars``."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    tagged = docs.join(p9_found(spark, d), "doc_id", "left")
    return tagged.groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chars"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
