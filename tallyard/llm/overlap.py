"""Records that occur in evaluation splits and, exactly or almost, in training (problem 3).

Evaluation records are indexed in shards of bounded size, each a compressed full-text index; training records stream
through backward search and give their maximal matches, which are merged to spans and counts for each pair of records
and decided on. A text record's string is its tokens; a vector's string is the signs of many fixed projections, eight to a symbol,
each symbol bound to its place. Records equal in the compared field form a class, searched once.

A training text goes to the shards in which it can have a maximal match long enough to count: any two strings that share
2 * window - 1 tokens share one of their minimisers (the least hash of ``window`` consecutive runs of ``window``
tokens), so the minimisers of the evaluation side, with their shards, tell. A vector goes to the cells of a coarse clustering near it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.repos import repo_name, repo_of_instance
from ..operators.skew import join_unique
from ..scratch import Stored
from .fmindex import FMIndex, place_matches, text_matches
from .knn import _floats, fit_cells, rotation, usable

_TOKENS = re.compile(r"\w+|[^\w]")
_STRINGS = "train boolean, h1 bigint, h2 bigint, toks array<bigint>, mins array<bigint>"
_VECTOR = "task int, train boolean, h1 bigint, h2 bigint, vec array<float>"
_FOUND = "t1 bigint, t2 bigint, e1 bigint, e2 bigint"
_SPANS = _FOUND + ", n_spans bigint, n_matched bigint, first bigint, last bigint, n_train bigint, n_eval bigint"

# ------------------------------------------------------------------------ texts


def _hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each place on."""
    x = tokens.astype(np.uint64)
    h = np.zeros(max(0, len(x) - k + 1), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(h)]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def minimisers(tokens: np.ndarray, lengths: np.ndarray, window: int, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """(string, hash) of the minimisers of strings that lie one after another; a string of fewer than ``window`` tokens
    has none. ``one``: only the least of each string, enough where whole strings must agree."""
    h, n = _hashes(tokens, window), lengths - window + 1
    who = np.flatnonzero(n > 0)
    begin = (np.cumsum(lengths) - lengths)[who]
    n = n[who]
    string = np.repeat(np.arange(len(who)), n)
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = h[at]
    if one:
        return who, np.minimum.reduceat(own, np.cumsum(n) - n) if len(own) else own
    left = np.repeat(np.cumsum(n), n) - np.arange(len(own))  # runs from here to the string's end
    low = own.copy()
    for j in range(1, window):
        ok = np.flatnonzero(left > j)
        low[ok] = np.minimum(low[ok], own[ok + j])
    starts = (left >= window) | (np.arange(len(own)) == np.repeat(np.cumsum(n) - n, n))
    pair = np.unique(np.stack([string[starts].astype(np.uint64), low[starts]], 1), axis=0)
    return who[pair[:, 0].astype(np.int64)], pair[:, 1]


def text_strings(rows: DataFrame, window: int, one: bool) -> DataFrame:
    """``train, h1, h2, toks, mins`` of rows ``train, h1, h2, txt``, copies inside a portion once. A token's number is
    its checksum, between the marks 1 and 2 of start and end; a text with no run of ``window`` tokens has its own hash as minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: dict[str, int] = {}
        for b in batches:
            key = np.stack([b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            one_of = np.sort(np.unique(key, axis=0, return_index=True)[1])
            b = b.take(pa.array(one_of))
            if len(book) > 500_000:
                book.clear()
            flat, lens = [], []
            for t in b.column(3).to_pylist():
                own = _TOKENS.findall(t)
                for w in own:
                    if w not in book:
                        book[w] = crc32(w.encode("utf-8", "surrogatepass")) + 3
                flat.append(1)
                flat += map(book.__getitem__, own)
                flat.append(2)
                lens.append(len(own) + 2)
            toks, lens = np.array(flat, np.int64), np.array(lens, np.int64)
            who, mins = minimisers(toks, lens, window, one)
            short = np.flatnonzero(lens < window)
            who, mins = np.concatenate([who, short]), np.concatenate([mins, b.column(1).to_numpy()[short].astype(np.uint64)])
            mins = mins[np.argsort(who, kind="stable")].astype(np.int64)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x))
                for n, x in ((lens, toks), (np.bincount(who, minlength=len(lens)), mins))
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["train", "h1", "h2", "toks", "mins"])

    return rows.select("train", "h1", "h2", "txt").mapInArrow(run, _STRINGS)


def matching_texts(rows: DataFrame, share: float = 1.0, window: int = 5, shard_tokens: int = 500_000) -> DataFrame:
    """Pairs of a training and an evaluation text of which maximal matches of 2 * ``window`` - 1 tokens or more cover
    ``share`` of the longer: ``t1, t2, e1, e2, n_spans, n_matched, first, last, n_train, n_eval``.

    Rows ``train, h1, h2, txt``; h1 and h2 name the classes of equal texts. Equal texts are always a pair, however short. Counts are in
    tokens, the marks of start and end among them. A shard holds some ``shard_tokens`` tokens of the evaluation side, and
    a task one shard and a block of its visitors.
    """
    all_ = Stored(text_strings(rows, window, share >= 1).dropDuplicates(["train", "h1", "h2"]), "strings")
    held, sent = all_.df.where("not train"), all_.df.where("train")
    shards = max(1, -(-(held.agg(F.sum(F.size("toks"))).first()[0] or 0) // shard_tokens))
    shard = F.pmod("h2", F.lit(shards)).cast("int")
    where_ = held.select(F.explode("mins").alias("m"), shard.alias("shard")).groupBy("m").agg(F.collect_set("shard").alias("shards"))
    visits = Stored(join_unique(sent.select("h1", "h2", F.explode("mins").alias("m")), where_, "m").select("h1", "h2", F.explode("shards").alias("shard")).distinct(), "visits")
    per_block = 4 * shard_tokens
    guests = visits.df.join(sent.select("h1", "h2", "toks"), ["h1", "h2"])
    sizes = guests.groupBy("shard").agg(F.ceil(F.sum(F.size("toks")) / per_block).cast("int").alias("blocks"))
    guests = guests.join(sizes, "shard").select("shard", F.pmod("h1", F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("train"), "h1", "h2", "toks")
    hosts = held.select(shard.alias("shard"), "h1", "h2", "toks").join(sizes, "shard")
    hosts = hosts.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("train"), "h1", "h2", "toks")

    def search(group: pa.Table) -> pa.Table:
        train = group.column("train").to_numpy()
        h1, h2 = (group.column(c).to_numpy() for c in ("h1", "h2"))
        toks = group.column("toks")

        def strings(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = toks.take(pa.array(at)).combine_chunks()
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            return own.flatten().to_numpy(), np.diff(own.offsets.to_numpy())

        e, t, parts = np.flatnonzero(~train), np.flatnonzero(train), []
        if e.size and t.size:
            flat, lens = strings(e)
            index = FMIndex(flat, lens)
            for i in range(0, t.size, 1024):
                own = t[i : i + 1024]
                seen, n = strings(own)
                m = text_matches(index, seen, n, window, share)
                parts.append((own[m["pattern"]], e[m["string"]], m["spans"], m["matched"], m["lo"], m["hi"], n[m["pattern"]], lens[m["string"]]))
        t, e, *counts = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else [np.empty(0, np.int64)] * 8
        return pa.table([h1[t], h2[t], h1[e], h2[e], *counts], names=[c.split()[0] for c in _SPANS.split(", ")])

    return guests.unionByName(hosts).groupBy("shard", "block").applyInArrow(search, _SPANS)


# ---------------------------------------------------------------------- vectors


def _signature(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    value = np.packbits((unit @ planes > 0), axis=1).astype(np.int64)
    return value + np.arange(value.shape[1]) * 256 + 1


def matching_vectors(
    rows: DataFrame, min_cosine: float, dim: int = 64, cell_rows: int = 8192, sample_rows: int = 16_384, margin: float = 0.1, turns: int = 8, least: int = 2, symbols: int = 3
) -> DataFrame:
    """Pairs of classes with cosine of at least ``min_cosine``: rows ``space, train, h1, h2, vec``.

    Evaluation vectors are indexed in their nearest cell; a training vector visits the cells within ``margin`` of its
    nearest, six at most. Candidates are the pairs whose maximal matches of ``least`` symbols or more hold ``symbols`` in
    all; of 100,000 pairs at cosine 0.98 none had fewer. Candidates are compared exactly.
    """
    cells = fit_cells(rows, dim, cell_rows, sample_rows, margin, visits=6)
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    planes = np.concatenate([rotation(dim, 100 + i) for i in range(turns)], 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x = _floats(b.column(4), dim).astype(np.float64)
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                train, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                _, one = np.unique(np.stack([train.astype(np.int64), h1, h2], 1), axis=0, return_index=True)
                who, task, member, asks = cells.visit("", unit[one], h1[one])
                who = one[who]
                ok = np.where(train[who], asks, member)
                yield pa.RecordBatch.from_arrays([pa.array(task[ok].astype(np.int32)), *b.take(pa.array(who[ok])).columns[1:]], names=["task", "train", "h1", "h2", "vec"])

    def search(group: pa.Table) -> pa.Table:
        train = group.column("train").to_numpy()
        h1, h2 = (group.column(c).to_numpy() for c in ("h1", "h2"))
        x = np.concatenate([_floats(c, dim) for c in group.column("vec").chunks]).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)

        def classes(at: np.ndarray) -> np.ndarray:
            return at[np.unique(np.stack([h1[at], h2[at]], 1), axis=0, return_index=True)[1]] if at.size else at

        held, sent = classes(np.flatnonzero(~train)), classes(np.flatnonzero(train))
        parts = [(np.empty(0, np.int64),) * 2]
        if held.size and sent.size:
            sig = _signature(x[held].astype(np.float32), planes)
            index = FMIndex(sig.ravel(), np.full(held.size, sig.shape[1]))
            for i in range(0, sent.size, 2048):
                own = sent[i : i + 2048]
                p, s, _, n = place_matches(index, _signature(x[own].astype(np.float32), planes), least)
                t, e = own[p[n >= symbols]], held[s[n >= symbols]]
                ok = np.concatenate([np.einsum("ij,ij->i", x[t[j : j + 65_536]], x[e[j : j + 65_536]]) >= min_cosine for j in range(0, len(t), 65_536)] or [np.empty(0, bool)])
                same = (h1[t] == h1[e]) & (h2[t] == h2[e])
                parts.append((t[ok | same], e[ok | same]))
        t, e = (np.concatenate(v) for v in zip(*parts))
        return pa.table([h1[t], h2[t], h1[e], h2[e]], names=["t1", "t2", "e1", "e2"])

    sent = rows.select("space", "train", "h1", "h2", "vec").mapInArrow(route, _VECTOR)
    return sent.repartition(cells.parts, "task").groupBy("task").applyInArrow(search, _FOUND).distinct()


# --------------------------------------------------------------------- together


class Overlaps:
    """Overlaps of rows ``id, train boolean, name, body, vec`` between training and evaluation.

    Two records overlap if both vectors are usable and their cosine is at least ``min_cosine``, or if name and body
    both agree when letter case and white space are ignored; a null name or body agrees with nothing. Rows with a null
    id or ``train`` are in no split and match nothing. Repeated rows count once; an empty side gives no pairs. Other
    columns are not read.
    """

    def __init__(self, rows: DataFrame, min_cosine: float = 0.98, dim: int = 64):
        bare = lambda c: F.regexp_replace(F.lower(F.col(c)), r"(?U)\s+", "")
        flat = rows.where("id is not null and train is not null").select(
            "id", "train", F.when(usable("vec", dim), F.col("vec").cast("array<float>")).alias("vec"), F.concat(bare("name"), F.lit("\x00"), bare("body")).alias("txt")
        )
        hashed = flat.withColumns(
            {"v1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "v2": F.xxhash64(F.lit(1), "vec"), "x1": F.xxhash64("txt"), "x2": F.xxhash64(F.lit(1), "txt")}
        )
        self._stored = Stored(hashed, "records")
        self.base = self._stored.df
        #: One row for each record: its id, side and classes.
        self.members = Stored(self.base.select("id", "train", *[F.when(F.col(a).isNotNull(), F.col(c)).alias(c) for a, c in (("txt", "x1"), ("txt", "x2"), ("v1", "v1"), ("v1", "v2"))]).distinct(), "members").df
        self.min_cosine, self.dim = min_cosine, dim

    def texts(self, share: float = 1.0, **options) -> DataFrame:
        return matching_texts(self.base.where("txt is not null").select("train", F.col("x1").alias("h1"), F.col("x2").alias("h2"), "txt"), share, **options)

    def vectors(self) -> DataFrame:
        rows = self.base.where("v1 is not null").select(F.lit("").alias("space"), "train", F.col("v1").alias("h1"), F.col("v2").alias("h2"), "vec")
        return matching_vectors(rows, self.min_cosine, self.dim)

    def same_texts(self) -> DataFrame:
        """Classes that occur on both sides. Maximal matches cover the whole of both strings; that their texts are
        equal too, and not only their tokens' checksums, is seen from the classes."""
        return self.texts().where("t1 = e1 and t2 = e2").select("t1", "t2", "e1", "e2")

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """Matching classes by text and by vector, as tables; the copy of the records is dropped."""
        found = Stored(self.same_texts(), "by_text").df, Stored(self.vectors(), "by_vec").df
        self._stored.drop()
        return found

    def _side(self, kind: str, train: bool) -> DataFrame:
        side = "t" if train else "e"
        own = self.members.where(F.col("train") == train).where(f"{kind}1 is not null")
        return own.select(F.col(f"{kind}1").alias(f"{side}1"), F.col(f"{kind}2").alias(f"{side}2"), F.col("id").alias("train_id" if train else "eval_id")).distinct()

    def pairs(self) -> DataFrame:
        """``train_id, eval_id`` of all overlaps. The training members, of which a class may have very many, take
        their class's matches from one row; the pairs are as many as the result's columns demand."""

        def expand(matches: DataFrame, kind: str) -> DataFrame:
            lists = matches.groupBy(F.struct("t1", "t2").alias("class")).agg(F.collect_set(F.struct("e1", "e2")).alias("to"))
            mine = join_unique(self._side(kind, True).select("train_id", F.struct("t1", "t2").alias("class")), lists, "class")
            return mine.select("train_id", F.explode("to").alias("e")).select("train_id", "e.e1", "e.e2").join(self._side(kind, False), ["e1", "e2"]).select("train_id", "eval_id")

        text, vec = self.matches()
        return expand(text, "x").unionByName(expand(vec, "v")).distinct()

    def counts(self) -> DataFrame:
        """``eval_id, n``: how many training records each evaluation record overlaps, from the sizes of classes: those
        of its text, and those of its vector, less those of both. No pair of records is built. Records of one id that
        differ count each for themselves."""
        text, vec = self.matches()
        both = ["x1", "x2", "v1", "v2"]
        trained = self.members.where("train").groupBy(*both).agg(F.count(F.lit(1)).alias("n"))
        held = self.members.where("not train")
        kinds = held.select(*both).distinct()

        def sums(matches: DataFrame, kind: str) -> DataFrame:
            sizes = trained.where(f"{kind}1 is not null").groupBy(F.col(f"{kind}1").alias("t1"), F.col(f"{kind}2").alias("t2")).agg(F.sum("n").alias("n"))
            return matches.join(sizes, ["t1", "t2"]).groupBy(F.col("e1").alias(f"{kind}1"), F.col("e2").alias(f"{kind}2")).agg(F.sum("n").alias(f"n_{kind}"))

        met = vec.select(F.col("e1").alias("v1"), F.col("e2").alias("v2"), F.col("t1").alias("w1"), F.col("t2").alias("w2"))
        shared = trained.where("x1 is not null and v1 is not null").select("x1", "x2", F.col("v1").alias("w1"), F.col("v2").alias("w2"), F.col("n").alias("m"))
        twice = kinds.where("x1 is not null and v1 is not null").join(met, ["v1", "v2"]).join(shared, ["x1", "x2", "w1", "w2"]).groupBy(*both).agg(F.sum("m").alias("n_both"))
        n = lambda c: F.coalesce(c, F.lit(0))
        known = kinds.join(sums(text, "x"), ["x1", "x2"], "left").join(sums(vec, "v"), ["v1", "v2"], "left")
        same = lambda c: known[c].eqNullSafe(twice[c])
        known = known.join(twice, same("x1") & same("x2") & same("v1") & same("v2"), "left").select(*[known[c] for c in both], (n(F.col("n_x")) + n(F.col("n_v")) - n(F.col("n_both"))).alias("n"))
        known = known.where("n > 0").select(F.struct(*both).alias("class"), "n")
        return join_unique(held.select(F.col("id").alias("eval_id"), F.struct(*both).alias("class")), known, "class").select("eval_id", "n")


def cross_split_matches(rows: DataFrame, min_cosine: float = 0.98, dim: int = 64) -> DataFrame:
    """``train_id, eval_id`` of all overlaps, as ``Overlaps`` states them."""
    return Overlaps(rows, min_cosine, dim).pairs()


def function_splits(spark: SparkSession, d: str) -> DataFrame:
    """``id, name, repo, split_name`` of every function whose repository is listed."""
    emb = spark.read.parquet(f"{d}/function_embeddings.parquet")
    who = emb.select("id", F.col("feature_function").alias("name"), repo_of_instance("instance_id").alias("repo"))
    splits = spark.read.parquet(f"{d}/repo_splits.parquet").select(repo_name("repo").alias("repo"), "split_name")
    return join_unique(who, splits, "repo")


def _is_train(c: Column) -> Column:
    return F.when(c == "train", F.lit(True)).when(c.isin("val", "test"), F.lit(False))


def _overlaps(spark: SparkSession, d: str) -> tuple[Overlaps, DataFrame]:
    """Overlaps, and ``id, name, repo, split_name, train`` of the functions in them."""
    who = Stored(function_splits(spark, d).withColumn("train", _is_train(F.col("split_name"))).where("train is not null").distinct(), "functions").df
    targets = spark.read.parquet(f"{d}/function_student_targets.parquet")
    rows = targets.select(F.col("function_id").alias("id"), F.col("body_text").alias("body"), F.col("body_embedding").alias("vec")).join(who.select("id", "name", "train").distinct(), "id")
    return Overlaps(rows), who


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = _overlaps(spark, d)[0].pairs()
    return m.select(F.least("train_id", "eval_id").alias("function_id_a"), F.greatest("train_id", "eval_id").alias("function_id_b"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of each evaluation split and source repository: ``split_name, repo, n_functions, n_pairs``."""
    overlaps, who = _overlaps(spark, d)
    m = overlaps.counts()
    return m.join(who.select(F.col("id").alias("eval_id"), "repo", "split_name").distinct(), "eval_id").groupBy("split_name", "repo").agg(F.count(F.lit(1)).alias("n_functions"), F.sum("n").alias("n_pairs"))


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    """Texts of training and evaluation that share 0.8 of the longer one's tokens in runs of nine or more, with what
    they share: ``train_id, eval_id, n_spans, n_matched, n_tokens``. Equal texts are one class and stand for each other:
    the ids are the smallest of their classes."""
    o, _ = _overlaps(spark, d)
    first = lambda train, side: o._side("x", train).groupBy(f"{side}1", f"{side}2").agg(F.min("train_id" if train else "eval_id").alias("train_id" if train else "eval_id"))
    m = o.texts(0.8).join(first(True, "t"), ["t1", "t2"]).join(first(False, "e"), ["e1", "e2"])
    return m.select("train_id", "eval_id", "n_spans", "n_matched", F.greatest("n_train", "n_eval").alias("n_tokens"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_near": p3_near}

_PARTS = "string_split(instance_id, '__')"
_NAMED = (
    "regexp_replace(lower(CASE WHEN contains(instance_id, '#') THEN string_split(instance_id, '#')[1]"
    f" WHEN len({_PARTS}) >= 3 AND regexp_full_match({_PARTS}[1], '[0-9]+') THEN {_PARTS}[2] || '/' || {_PARTS}[3] ELSE {_PARTS}[1] || '/' || {_PARTS}[2] END), '(\\.git|/|\\s)+$', '')"
)
_BARE = "regexp_replace(lower({c}), '\\s+', '', 'g')"
_PAIRS = f"""who AS (SELECT DISTINCT id, {_NAMED} AS repo, feature_function FROM function_embeddings),
    r AS (SELECT DISTINCT w.id, w.repo, s.split_name, {_BARE.format(c="w.feature_function")} AS name, {_BARE.format(c="t.body_text")} AS body, CAST(t.body_embedding AS DOUBLE[]) AS v
        FROM who w JOIN repo_splits s ON s.repo = w.repo JOIN function_student_targets t ON t.function_id = w.id),
    u AS (SELECT id, split_name, v FROM r WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    pairs AS (SELECT a.id AS t, b.id AS e FROM u a JOIN u b ON a.split_name = 'train' AND b.split_name IN ('val', 'test') AND list_cosine_similarity(a.v, b.v) >= 0.98
        UNION SELECT a.id, b.id FROM r a JOIN r b ON a.name = b.name AND a.body = b.body AND a.split_name = 'train' AND b.split_name IN ('val', 'test'))"""
SQL = {
    "p3_found": f"WITH {_PAIRS} SELECT least(t, e) AS function_id_a, greatest(t, e) AS function_id_b FROM pairs",
    "p3_counts": f"""WITH {_PAIRS}, n AS (SELECT e, count(*) AS n FROM pairs GROUP BY 1), k AS (SELECT DISTINCT id, repo, split_name FROM r)
        SELECT split_name, repo, count(*) AS n_functions, CAST(sum(n) AS BIGINT) AS n_pairs FROM n JOIN k ON k.id = e GROUP BY 1, 2""",
}
