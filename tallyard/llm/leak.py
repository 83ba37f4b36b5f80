"""Evaluation passages inside a training corpus (problem 8).

Latent semantic retrieval: passages of documents and of evaluation items become TF-IDF vectors over the items' words,
with document frequencies of the whole corpus; a randomised SVD, whose sums run over all partitions, gives the latent
space; passages near an item's passage by cosine are candidates; a candidate is a leak if the longest common
subsequence with a window of the item is long enough and the window's answer, its rarest words, is among it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Stored, put_file
from .words import words

#: A document's passages are SPAN words long and start every STEP words, so every run of SPAN - STEP words lies in one.
WINDOW, SPAN, STEP = 20, 48, 20
MISSED = 10  # one word in so many may differ


class Items:
    """The evaluation items: their words as numbers, and their windows. The set of items is small and stated."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words = [], []
        self.vocab: dict[str, int] = {}
        for i, text in rows:
            w = words(text)
            if w:
                self.ids.append(i)
                self.words.append([self.vocab.setdefault(x, len(self.vocab)) for x in w])
        self.win_item, self.win_at, wins = [], [], []
        for n, w in enumerate(self.words):
            last = max(0, len(w) - WINDOW)
            for at in sorted({*range(0, last, WINDOW // 2), last}):
                self.win_item.append(n)
                self.win_at.append(at)
                wins.append(w[at : at + WINDOW])
        self.windows = wins


def numbered(docs: DataFrame, doc_key: str, vocab: dict[str, int]) -> DataFrame:
    """``<doc_key>, n_words int, at array<int>, ids array<int>``: the known words of each document and their places. The
    corpus is read and cut into words only here."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = docs.schema[doc_key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for b in batches:
            size, at, ids, lens = [], [], [], []
            for t in b.column(1).to_pylist():
                w = words(t)
                own = np.fromiter((known(x, -1) for x in w), np.int32, len(w))
                hit = np.flatnonzero(own >= 0)
                size.append(len(w))
                at.append(hit.astype(np.int32))
                ids.append(own[hit])
                lens.append(hit.size)
            ends = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.empty(0, np.int32))) for x in (at, ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), *lists], names=[doc_key, "n_words", "at", "ids"])

    return docs.select(doc_key, "text").mapInArrow(run, f"{doc_key} {kind}, n_words int, at array<int>, ids array<int>")


def document_frequency(tokens: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """In how many documents each known word occurs, and the number of documents, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(n_words, np.int64), 0
        for b in batches:
            ids = b.column(0)
            doc = np.repeat(np.arange(b.num_rows), np.diff(ids.offsets.to_numpy()))
            once = np.unique(doc * n_words + ids.flatten().to_numpy())
            rows += b.num_rows
            n += np.bincount(once % n_words, minlength=n_words)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(n_words)], pa.int32()), pa.array([rows, *n], pa.int64())], names=["word", "n"])

    got = tokens.select("ids").mapInArrow(run, "word int, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_words + 1, np.int64)
    df[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def tf_idf(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, words and weights of the passages' vectors, of length one; a word's count enters as 1 + ln."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    flat = np.concatenate(passages) if passages else np.empty(0, np.int64)
    key, n = np.unique(row * len(idf) + flat, return_counts=True)
    r, w = key // len(idf), key % len(idf)
    x = (1 + np.log(n)) * idf[w]
    norm = np.sqrt(np.bincount(r, x * x, minlength=len(passages)))
    return r, w, (x / np.maximum(norm[r], 1e-12)).astype(np.float32)


def project(r: np.ndarray, w: np.ndarray, x: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The sparse rows times ``basis``."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    if len(r):
        used, first = np.unique(r, return_index=True)
        for lo in range(0, len(used), 2000):
            s, e = first[lo], first[lo + 2000] if lo + 2000 < len(used) else len(r)
            out[used[lo : lo + 2000]] = np.add.reduceat(x[s:e, None] * basis[w[s:e]], first[lo : lo + 2000] - s)
    return out


def gram_product(passages: DataFrame, extra: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, block: int = 256) -> np.ndarray:
    """A'A basis for the matrix A of all passages and ``extra``. Partial sums are added per block of words, so the
    driver receives one matrix of the items' vocabulary, whatever the corpus' size."""
    name = put_file(passages.sparkSession, basis.astype(np.float32).tobytes(), "basis")
    n_words, k = basis.shape

    def part(rows: list[np.ndarray], b: np.ndarray, total: np.ndarray) -> None:
        r, w, x = tf_idf(rows, idf)
        y = project(r, w, x, len(rows), b)
        order = np.argsort(w, kind="stable")
        used, first = np.unique(w[order], return_index=True)
        for lo in range(0, len(used), 500):
            s, e = first[lo], first[lo + 500] if lo + 500 < len(used) else len(w)
            o = order[s:e]
            total[used[lo : lo + 500]] += np.add.reduceat(x[o, None] * y[r[o]], first[lo : lo + 500] - s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.fromfile(SparkFiles.get(name), np.float32).reshape(n_words, k)
        total, held = np.zeros((n_words, k)), []
        for batch in batches:
            for p in batch.column(0).to_pylist():
                held.append(np.array(p, np.int64))
                if len(held) >= 5000:
                    part(held, b, total)
                    held = []
        if held:
            part(held, b, total)
        for lo in range(0, n_words, block):
            s = total[lo : lo + block]
            if s.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], names=["lo", "part"])

    def add(group: pa.Table) -> pa.Table:
        parts = group.column("part").combine_chunks()
        size = len(parts[0])
        total = parts.flatten().to_numpy().reshape(-1, size).sum(0)
        return pa.table([pa.array([group.column("lo")[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["lo", "part"])

    sums = passages.select("ids").mapInArrow(run, "lo int, part array<double>").groupBy("lo").applyInArrow(add, "lo int, part array<double>")
    out = np.zeros((n_words, k))
    for lo, p in sums.toLocalIterator():
        out[lo : lo + block] += np.array(p).reshape(-1, k)
    part(extra, basis.astype(np.float32), out)
    return out


def latent_space(passages: DataFrame, extra: list[np.ndarray], idf: np.ndarray, k: int, turns: int = 2, seed: int = 17) -> np.ndarray:
    """Right singular vectors of the passages' matrix: randomised range finding with ``turns`` passes over the data."""
    k = min(k, len(idf))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), k)))[0]
    for _ in range(turns):
        z = gram_product(passages, extra, idf, q)
        small = q.T @ z
        _, turn = np.linalg.eigh((small + small.T) / 2)
        q = np.linalg.qr(z @ turn[:, ::-1])[0]
    return q.astype(np.float32)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, all of ``a`` at once as bits of one number."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def missed(size: int) -> int:
    """How many words of a window of ``size`` words may be changed, added or missing: one in ten."""
    return size // MISSED


def stretch_of(item: list[int], at: int) -> tuple[int, int, int]:
    """First and last place of the windows of the item near ``at``, and their size."""
    size = min(WINDOW, len(item))
    return max(0, at - WINDOW // 2), min(len(item) - size, at + WINDOW // 2), size


def same_passage(item: list[int], at: int, passage: list[int], answer: dict[int, list[int]]) -> bool:
    """Whether a window of the item near ``at`` lies in the passage: at most one word in ten missing from the common
    subsequence. Checked first is the answer: of a window's rarest words (``answer``: by place, one more than may be
    missing) at least one must be there."""
    first, last, size = stretch_of(item, at)
    need = size - missed(size)
    # the stretch's subsequence bounds that of every window in it
    if lcs_length(item[first : last + size], passage) < need:
        return False
    have = set(passage)
    for lo in range(first, last + 1):
        if have.isdisjoint(answer[lo]):
            continue
        if lcs_length(item[lo : lo + size], passage) >= need:
            return True
    return False


class Windows:
    """What a passage must hold to hold a window but for the words it may miss: at least one of its answer words (the
    rarest, one more than may be missing), and as many known words and as much weight as the rest. Stated for each
    answer word by the least of its windows, so an item of few words loosens the test for its own words only."""

    def __init__(self, items: Items, idf: np.ndarray):
        self.answers: list[dict[int, list[int]]] = []  # of each item: answer words by place of the window
        self.mass, self.count = np.full(len(idf), np.inf), np.full(len(idf), np.iinfo(np.int64).max)
        for w in items.words:
            own, size = {}, min(WINDOW, len(w))
            miss = missed(size)
            for lo in range(len(w) - size + 1):
                part = np.array(w[lo : lo + size])
                order = part[np.lexsort((part, -idf[part]))]
                rare = order[: miss + 1]
                own[lo] = list(dict.fromkeys(rare.tolist()))
                self.mass[rare] = np.minimum(self.mass[rare], idf[order[miss:]].sum())
                self.count[rare] = np.minimum(self.count[rare], size - miss)
            self.answers.append(own)

        # words of the stretch around each window, filled up with a word that no passage has, and how many are needed
        self.stretch = np.full((len(items.windows), 2 * WINDOW), len(idf), np.int32)
        self.need = np.empty(len(items.windows), np.int64)
        for j, (n, at) in enumerate(zip(items.win_item, items.win_at)):
            first, last, size = stretch_of(items.words[n], at)
            own = items.words[n][first : last + size]
            self.stretch[j, : len(own)], self.need[j] = own, size - missed(size)

    def shared(self, texts: list[list[int]], row: np.ndarray, window: np.ndarray, n_words: int) -> np.ndarray:
        """Which of the pairs (text, window) have as many words of the window's stretch in common as a match needs."""
        ok = np.zeros(len(row), bool)
        step = max(1, 20_000_000 // (n_words + 1))
        for lo in range(0, len(texts), step):
            part = texts[lo : lo + step]
            have = np.zeros((len(part), n_words + 1), bool)
            have[np.repeat(np.arange(len(part)), [len(t) for t in part]), np.concatenate(part)] = True
            mine = np.flatnonzero((row >= lo) & (row < lo + step))
            for i in range(0, len(mine), 100_000):
                m = mine[i : i + 100_000]
                ok[m] = have[row[m][:, None] - lo, self.stretch[window[m]]].sum(1) >= self.need[window[m]]
        return ok

    def passages(self, n: int, at: np.ndarray, ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the passages of a text of ``n`` words that may hold a window, and where in ``ids`` they lie."""
        n_passages = max(1, -(-(n - (SPAN - STEP)) // STEP))
        lo = np.arange(n_passages) * STEP
        a, b = np.searchsorted(at, lo), np.searchsorted(at, lo + SPAN)
        weight = np.concatenate([[0], np.cumsum(idf[ids])])
        mass, count = weight[b] - weight[a], b - a
        good = np.zeros(n_passages, bool)
        key = np.flatnonzero(np.isfinite(self.mass[ids]))
        for back in range(-(-SPAN // STEP)):
            p = at[key] // STEP - back
            ok = (p >= 0) & (p < n_passages)
            ok[ok] &= at[key[ok]] < lo[p[ok]] + SPAN
            p, w = p[ok], ids[key[ok]]
            good[p[(mass[p] >= self.mass[w] - 1e-9) & (count[p] >= self.count[w])]] = True
        p = np.flatnonzero(good)
        return p, a[p], b[p]


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", dims: int = 192, min_cosine: float = 0.2, shard_chars: int = 4_000_000
) -> DataFrame:
    """``<doc_key>, <item_key>`` of every document that holds a passage of an item.

    A passage is 20 consecutive words of the item, or all of a shorter item, of which one in ten may be changed, added
    or missing: two of 20, none of fewer than ten. Null and empty texts hold nothing and leak nothing; repeated
    documents each count; an empty table gives no rows. ``text`` is read of both tables; other columns aren't. Items, their
    vocabulary and latent space go to every task, so items of more than ``shard_chars`` characters in all are searched
    shard by shard; whether an item leaks depends on no other item. A passage amid other items' words has a low cosine
    to its own item: ``min_cosine`` may lose some of those (README, 8).
    """
    items = items.select(item_key, F.col("text").cast("string").alias("text")).where(f"{item_key} is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    parts = [_leaked(docs, items.where(F.pmod(F.xxhash64(item_key), F.lit(shards)) == i), doc_key, item_key, dims, min_cosine) for i in range(shards)]
    return reduce(DataFrame.unionByName, parts)


def _leaked(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, dims: int, min_cosine: float) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[doc_key].dataType.simpleString()
    ikind = items.schema[item_key].dataType.simpleString()
    known = Items(sorted((r[0], r[1]) for r in items.collect()))  # at most a shard
    docs = docs.select(doc_key, F.col("text").cast("string").alias("text")).where(f"{doc_key} is not null")
    if not known.ids:
        return spark.createDataFrame([], f"{doc_key} {kind}, {item_key} {ikind}")
    tokens = Stored(numbered(docs, doc_key, known.vocab), "tokens")
    df, n_docs = document_frequency(tokens.df, len(known.vocab))
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    wanted = Windows(known, idf)
    shared = spark.sparkContext.broadcast((wanted, idf))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, idf = shared.value
        for b in batches:
            keys, out = [], []
            size, at, ids = b.column(1).to_numpy(), b.column(2), b.column(3)
            ends = at.offsets.to_numpy()
            at, ids = at.flatten().to_numpy(), ids.flatten().to_numpy()
            for i in np.flatnonzero(np.diff(ends)):
                s = slice(ends[i] - ends[0], ends[i + 1] - ends[0])
                for _, lo, hi in zip(*wanted.passages(int(size[i]), at[s], ids[s], idf)):
                    keys.append(i)
                    out.append(ids[s][lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(out, pa.list_(pa.int32()))], names=[doc_key, "ids"])

    passages = Stored(tokens.df.mapInArrow(cut, f"{doc_key} {kind}, ids array<int>"), "passages")
    tokens.drop()
    windows = [np.array(w, np.int64) for w in known.windows]
    basis = latent_space(passages.df, windows, idf, dims)
    name = put_file(spark, basis.tobytes(), "latent")
    latent = project(*tf_idf(windows, idf), len(windows), basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    query = spark.sparkContext.broadcast((known, idf, wanted, latent, basis.shape))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, wanted, latent, shape = query.value
        basis = np.fromfile(SparkFiles.get(name), np.float32).reshape(shape)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                keys = b.column(0).to_pylist()
                texts = b.column(1).to_pylist()
                p = project(*tf_idf([np.array(t, np.int64) for t in texts], idf), len(texts), basis)
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
                found: set = set()
                for first in range(0, len(latent), 8192):  # the items' windows in blocks
                    row, window = np.nonzero(p @ latent[first : first + 8192].T >= min_cosine)
                    ok = wanted.shared(texts, row, window + first, len(idf))
                    for i, j in zip(row[ok].tolist(), (window[ok] + first).tolist()):
                        item = known.win_item[j]
                        if (keys[i], item) not in found and same_passage(known.words[item], known.win_at[j], texts[i], wanted.answers[item]):
                            found.add((keys[i], item))
                pairs = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in pairs], b.schema.field(0).type), pa.array([known.ids[i] for _, i in pairs], whole_type)], names=[doc_key, item_key]
                )

    whole_type = items.select(item_key).limit(0).toArrow().schema.field(0).type
    found = Stored(passages.df.mapInArrow(match, f"{doc_key} {kind}, {item_key} {ikind}").distinct(), "leaked").df
    passages.drop()
    return found


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, with their suite and split and the number of documents that hold them."""
    n = p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    items = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "suite", "item_split")
    return items.join(n, "item_id").select("item_id", "suite", "item_split", "n_documents")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
