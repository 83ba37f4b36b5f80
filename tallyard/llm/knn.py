"""The k most similar vectors of every vector (problem 2).

Vectors with equal values form a class, searched once. Classes are routed to cells of a coarse clustering; a class also
visits the cells that its neighbours may lie in. A crowded cell is cut into blocks on both sides, and a task is one
block of members against one block of visitors. There, vectors are rotated, put into
lists and scanned by adaptive dimension scan: a list's candidates are compared in blocks of rotated dimensions, and a
hypothesis test on the partial distance drops a candidate as soon as its whole distance is unlikely to be among the
best. What is left is computed exactly from the stored values, in double precision. All vectors are indexed and all
are queries; only the centroids are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from ..scratch import Stored

# ------------------------------------------------------------------ clustering


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors, by dot product. An emptied centroid restarts at a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, 1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        c = x[rng.choice(len(x), len(c))].copy()
        c[used] = np.add.reduceat(x[order], first)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


# --------------------------------------------------------------- scan of a cell

#: Cosines that agree in so many digits are a tie: the last ones depend on the order of summation only.
DIGITS = 9


def scan_cell(
    x: np.ndarray, n_home: int, asks: np.ndarray, own: np.ndarray, k: int, min_cosine: float, probes: int = 16, block: int = 16, epsilon: float = 2.1, seed: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (query row, home row, cosine) of the rows ``asks`` of ``x`` among its first ``n_home`` rows.

    ``own``: class number of each row; a row isn't its own neighbour. At most ``k`` a query, none under
    ``min_cosine``; cosines agree if they do in ``DIGITS`` digits. ``epsilon``: width of the hypothesis test; a candidate is dropped after d dimensions if its
    extrapolated distance exceeds the bound times (1 + epsilon / sqrt(d)) squared.
    """
    n, dim = x.shape
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not n_home or not asks.size:
        return none
    wide = x.astype(np.float64)
    norm = np.linalg.norm(wide, axis=1)
    unit = (wide / norm[:, None]).astype(np.float32) @ rotation(dim)
    home = unit[:n_home]
    n_lists = max(1, int(np.sqrt(n_home)))
    rng = np.random.default_rng(seed)
    sample = home if n_home <= 32 * n_lists else home[rng.choice(n_home, 32 * n_lists, replace=False)]
    cents = kmeans(sample, n_lists, 5, seed)
    n_lists, probes = len(cents), min(probes, len(cents))
    order_of = []  # each row's lists, nearest first
    for i in range(0, n, 4096):
        s = unit[i : i + 4096] @ cents.T
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < n_lists else np.tile(np.arange(n_lists), (len(s), 1))
        order_of.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1).astype(np.int32))
    visit = np.concatenate(order_of)
    members = np.argsort(visit[:n_home, 0], kind="stable")
    bound = np.searchsorted(visit[members, 0], np.arange(n_lists + 1))
    worst = np.float32(2 - 2 * min_cosine)  # squared distance of unit vectors
    reach = np.full(n, worst, np.float32)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def groups(first: bool):
        flat = visit[asks, 0] if first else visit[asks, 1:].ravel()
        who = asks if first else np.repeat(asks, probes - 1)
        by = np.argsort(flat, kind="stable")
        at = np.searchsorted(flat[by], np.arange(n_lists + 1))
        for ell in range(n_lists):
            cand, q = members[bound[ell] : bound[ell + 1]], who[by[at[ell] : at[ell + 1]]]
            if cand.size:
                step = max(1, 4_000_000 // cand.size)
                for i in range(0, q.size, step):
                    yield q[i : i + step], cand

    for q, cand in groups(True):  # the nearest list is scanned whole: it gives each query its bound
        d2 = 2 - 2 * (unit[q] @ home[cand].T)
        d2[own[q][:, None] == own[cand][None, :]] = np.inf
        if cand.size > k:
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            reach[q] = np.minimum(worst, kth * 1.0001 + 1e-6)
        r, c = np.nonzero(d2 <= reach[q][:, None])
        out.append((q[r], cand[c]))
    if probes > 1:
        ends = [*range(block, dim, block), dim]

        def limit(d: int, rows: np.ndarray) -> np.ndarray:
            """Up to where the distance extrapolated from ``d`` dimensions may still belong to a neighbour."""
            return reach[rows] * (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else reach[rows] * 1.0001 + 1e-6

        for q, cand in groups(False):
            part, at = None, 0
            for lo, hi in zip([0, *ends], ends):
                a, b = unit[q, lo:hi], home[cand, lo:hi]
                step = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                part = step if part is None else part + step
                alive = part * (dim / hi) <= limit(hi, q)[:, None]
                at = hi
                # while many are left, whole blocks are cheaper than the pairs one by one
                if hi == dim or np.count_nonzero(alive) < alive.size // 16:
                    break
            r, c = np.nonzero(alive)
            gq, gc, dist = q[r], cand[c], part[r, c]
            for lo, hi in zip([0, *ends], ends):
                if lo >= at:
                    diff = unit[gq, lo:hi] - home[gc, lo:hi]
                    dist = dist + np.einsum("ij,ij->i", diff, diff)
                    ok = dist * (dim / hi) <= limit(hi, gq)
                    gq, gc, dist = gq[ok], gc[ok], dist[ok]
            out.append((gq, gc))
    gq, gc = (np.concatenate(v) for v in zip(*out)) if out else none[:2]
    ok = own[gq] != own[gc]
    gq, gc = gq[ok], gc[ok]
    cos = np.empty(len(gq))
    for i in range(0, len(gq), 65_536):
        s = slice(i, i + 65_536)
        cos[s] = np.einsum("ij,ij->i", wide[gq[s]], wide[gc[s]]) / (norm[gq[s]] * norm[gc[s]])
    ok = cos >= min_cosine
    gq, gc, cos = gq[ok], gc[ok], np.round(cos[ok], DIGITS)
    best = np.lexsort((gc, -cos, gq))  # home rows are in order of id: ties go to the smaller
    gq, gc, cos = gq[best], gc[best], cos[best]
    place = np.arange(len(gq)) - np.searchsorted(gq, gq)
    ok = place < k
    return gq[ok], gc[ok], cos[ok]


# ----------------------------------------------------------------- distribution


def usable(vec: str, dim: int) -> Column:
    """``dim`` finite numbers, not all zero. NaN sorts above infinity."""
    v = F.col(vec)
    top, low, inf = F.array_max(v), F.array_min(v), F.lit(float("inf"))
    return F.coalesce((F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (top < inf) & (low > -inf) & ((top > 0) | (low < 0)), F.lit(False))


def with_class(df: DataFrame, space: Column, item: str, vec: str, dim: int) -> DataFrame:
    """``space, id, h1, h2, vec`` of the usable vectors; h1 and h2 are two hashes of the values: one class."""
    v = F.col(vec).cast("array<float>")
    return df.where(F.col(item).isNotNull() & usable(vec, dim)).select(
        space.cast("string").alias("space"), F.col(item).cast("bigint").alias("id"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), v.alias("vec")
    )


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row ``n`` times, and which time it is."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Cells:
    """Cells of a coarse clustering of each space. A crowded cell has several blocks of members and of visitors; a task
    is one block of each."""

    def __init__(self, first: dict[str, int], book: dict[str, np.ndarray], margin: float, visits: int):
        self.first, self.book, self.margin, self.visits = first, book, margin, visits
        n = sum(len(c) for c in book.values())
        self.members, self.guests = np.ones(n, np.int64), np.ones(n, np.int64)  # blocks of each cell
        self.divide()

    def divide(self) -> None:
        self.offset = np.concatenate([[0], np.cumsum(self.members * self.guests)]).astype(np.int64)

    @property
    def tasks(self) -> int:
        return int(self.offset[-1])

    @property
    def parts(self) -> int:
        """Partitions for the tasks: three times as many, so that few share one."""
        return max(1, 3 * self.tasks)

    def near(self, space: str, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells) of each row's nearest cell, then of its second, and so on as far as the row visits."""
        score = unit @ self.book[space].T
        m = min(self.visits, score.shape[1])
        top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.tile(np.arange(m), (len(score), 1))
        val = np.take_along_axis(score, top, 1)
        order = np.argsort(-val, axis=1)
        top, val = np.take_along_axis(top, order, 1), np.take_along_axis(val, order, 1)
        found = []
        for j in range(m):
            go = np.flatnonzero(val[:, j] >= val[:, 0] - self.margin)
            found.append((go, self.first[space] + top[go, j]))
        return found

    def visit(self, space: str, unit: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, task, whether it is a member there, whether it asks there). A row is a member of one block of its
        nearest cell, with every block of visitors, and asks every block of members from one block of visitors; ``spread`` decides which."""
        parts = []
        for j, (go, c) in enumerate(self.near(space, unit)):
            nm, ng = self.members[c], self.guests[c]
            h = spread[go].astype(np.uint64)
            own, seat = (h % nm.astype(np.uint64)).astype(np.int64), (h // np.uint64(1 << 20) % ng.astype(np.uint64)).astype(np.int64)
            i, block = _each(nm)  # as a visitor, to every block of members
            parts.append((go[i], self.offset[c[i]] + block * ng[i] + seat[i], (block == own[i]) & (j == 0), np.ones(len(i), bool)))
            if j == 0:
                i, block = _each(ng)  # as a member, to every block of visitors but its own seat's, which is above
                i, block = i[block != seat[i]], block[block != seat[i]]
                parts.append((go[i], self.offset[c[i]] + own[i] * ng[i] + block, np.ones(len(i), bool), np.zeros(len(i), bool)))
        return tuple(np.concatenate(x) for x in zip(*parts))


def fit_cells(rows: DataFrame, dim: int, cell_rows: int, sample_rows: int, margin: float, visits: int) -> Cells:
    """One cell for ``cell_rows`` rows of each space, but for 16 sampled rows at least; the centroids are fitted on at
    most ``sample_rows`` rows in all, which also tell how many rows a cell will have."""
    counts = {r["space"]: r["n"] for r in rows.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each model and layer
    total = sum(counts.values())
    fit: dict[str, list] = {s: [] for s in counts}
    if total and max(counts.values()) > cell_rows:
        for r in rows.select("space", "vec").sample(min(1.0, sample_rows / total), seed=3).limit(sample_rows).toArrow().to_batches():
            for s, v in zip(r.column(0).to_pylist(), _floats(r.column(1), dim)):
                fit[s].append(v)
    first, book, unit, at = {}, {}, {}, 0
    for s in sorted(counts):
        x = np.array(fit[s], np.float32).reshape(-1, dim)
        n_cells = max(1, min(-(-counts[s] // cell_rows), len(x) // 16))
        unit[s] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        book[s] = kmeans(unit[s], n_cells, 8, 1) if n_cells > 1 else np.ones((1, dim), np.float32)
        first[s], at = at, at + len(book[s])
    cells = Cells(first, book, margin, visits)
    for s in sorted(counts):
        if len(unit[s]):
            seen = cells.near(s, unit[s])
            scale = counts[s] / len(unit[s]) / (2 * cell_rows)
            cells.members[first[s] : first[s] + len(book[s])] = np.maximum(1, np.ceil(np.bincount(seen[0][1] - first[s], minlength=len(book[s])) * scale))
            went = np.concatenate([c for _, c in seen]) - first[s]
            cells.guests[first[s] : first[s] + len(book[s])] = np.maximum(1, np.ceil(np.bincount(went, minlength=len(book[s])) * scale / 2))
    cells.divide()
    return cells


_ROUTED = "task int, member boolean, asks boolean, space string, id bigint, h1 bigint, h2 bigint, vec array<float>"
_PAIRS = "space string, q1 bigint, q2 bigint, c1 bigint, c2 bigint, cid bigint, cosine double"


def class_neighbours(
    rows: DataFrame, k: int, min_cosine: float, dim: int, cell_rows: int | None = None, sample_rows: int = 16_384, margin: float | None = None, visits: int | None = None
) -> DataFrame:
    """Pairs of classes (query class, candidate class, its smallest id, cosine), at most ``k`` a query and task.

    Each space has one cell for ``cell_rows`` rows: 8,192, or 65,536 for neighbours however far. The centroids are fitted on at most ``sample_rows`` rows in all (the
    only sample). A class is indexed in its nearest cell and also searched in up to ``visits`` - 1 others whose centroid
    is within ``margin`` of the nearest: a vector at cosine 0.9 moves the difference of two centroids' products by some
    0.07, so 0.12 and 6 do from 0.8 on; farther neighbours take 0.3 and 8, and more lists in a cell. A cell that the
    sample shows to be crowded is cut into blocks by class hash, of some 2 ``cell_rows`` members and twice as many visitors.
    """
    near = min_cosine >= 0.8
    cells = fit_cells(rows, dim, cell_rows or (8192 if near else 65_536), sample_rows, margin or (0.12 if near else 0.3), visits or (6 if near else 8))
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # at most sample_rows / 16 centroids

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                space = b.column(0).to_pylist()
                x = _floats(b.column(4), dim).astype(np.float32)
                ids, h1, h2 = (b.column(i).to_numpy() for i in (1, 2, 3))
                names = np.array(space, object)
                parts = []
                for s in set(space):
                    at = np.flatnonzero(names == s)
                    # copies inside a portion travel once; their smallest id stands for them
                    at = at[np.lexsort((ids[at], h2[at], h1[at]))]
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1])
                    at = at[fresh]
                    u = x[at] / np.linalg.norm(x[at].astype(np.float64), axis=1, keepdims=True).astype(np.float32)
                    who, *rest = cells.visit(s, u, h1[at])
                    parts.append((at[who], *rest))
                t, task, member, asks = (np.concatenate(v) for v in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task.astype(np.int32)), pa.array(member), pa.array(asks), *b.take(pa.array(t)).columns], names=["task", "member", "asks", "space", "id", "h1", "h2", "vec"]
                )

    def search(group: pa.Table) -> pa.Table:
        # members first, in order of id; one row for each class
        member = group.column("member").to_numpy()
        ids, h1, h2 = (group.column(c).to_numpy() for c in ("id", "h1", "h2"))
        _, own = np.unique(np.stack([h1, h2], 1), axis=0, return_inverse=True)
        own = own.ravel()
        order = np.lexsort((ids, ~member))
        _, at = np.unique(own[order], return_index=True)
        order = order[np.sort(at)]
        x = np.concatenate([_floats(c, dim) for c in group.column("vec").chunks])[order]
        asks = np.flatnonzero(group.column("asks").to_numpy()[order])
        gq, gc, cos = scan_cell(x, int(member[order].sum()), asks, own[order], k, min_cosine, 16 if near else 48)
        q, c = order[gq], order[gc]
        space = group.column("space")[0].as_py()
        return pa.table([pa.array([space] * len(q), pa.string()), h1[q], h2[q], h1[c], h2[c], ids[c], cos], names=["space", "q1", "q2", "c1", "c2", "cid", "cosine"])

    routed = rows.select("space", "id", "h1", "h2", "vec").mapInArrow(route, _ROUTED)
    return routed.repartition(cells.parts, "task").groupBy("task").applyInArrow(search, _PAIRS)


def top_similar(df: DataFrame, space: Column, item: str, vec: str, k: int = 5, min_cosine: float = -1.0, dim: int = 64, **options) -> DataFrame:
    """``space, id, neighbour, cosine``: the ``k`` most similar other rows of each row within its space.

    Ties, to ``DIGITS`` digits of the cosine, go to the smaller id; neighbours under ``min_cosine`` are left out. Rows
    with an unusable vector (null, not ``dim`` numbers, a null or non-finite number, all zero) or a null id are neither
    queries nor neighbours; a row delivered twice counts once; an empty table gives no row. Other columns are not read.
    """
    rows = with_class(df, F.coalesce(space.cast("string"), F.lit("")), item, vec, dim)
    key = ["space", "h1", "h2"]
    members = Stored(rows.select(*key, "id").distinct(), "members").df
    # a member can only be among the best by being one of its class's k + 1 smallest ids
    ranked = members.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("rn") <= k + 1)
    classes = ranked.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = class_neighbours(rows, k, min_cosine, dim, **options)
    c = [F.col(c).alias(n) for c, n in (("space", "space"), ("h1", "c1"), ("h2", "c2"), ("ids", "c_ids"))]
    entries = lambda ids, s: F.transform(ids, lambda i: F.struct((-s).alias("s"), i.alias("id")))
    # a class's k + 1 best rows, its own among them: each member's best are these without itself
    others = (
        pairs.withColumn("rn", F.row_number().over(Window.partitionBy("space", "q1", "q2").orderBy(F.desc("cosine"), "cid")))
        .where(F.col("rn") <= k)
        .join(classes.select(*c), ["space", "c1", "c2"])
        .groupBy("space", F.col("q1").alias("h1"), F.col("q2").alias("h2"))
        .agg(F.flatten(F.collect_list(entries("c_ids", F.col("cosine")))).alias("found"))
    )
    own = entries("ids", F.lit(1.0))
    best = classes.join(others, key, "left").select(
        *key, "ids", F.slice(F.array_sort(F.concat(own, F.coalesce("found", F.slice(own, 1, 0)))), 1, k + 1).alias("best")
    )
    # the ids of a small class are at hand; those of a large one, however many, take its list
    small = best.where(F.size("ids") <= k).select("space", F.explode("ids").alias("id"), "best")
    large = best.where(F.size("ids") > k).select(F.struct(*key).alias("class"), "best")
    spread = join_unique(members.select("space", "id", F.struct(*key).alias("class")), large, "class").select("space", "id", "best")
    near = small.unionByName(spread).select("space", "id", F.explode(F.slice(F.filter("best", lambda e: e["id"] != F.col("id")), 1, k)).alias("e"))
    return near.select("space", "id", F.col("e")["id"].alias("neighbour"), (-F.col("e")["s"]).alias("cosine"))


def _found(near: DataFrame, name: str) -> DataFrame:
    return near.select(F.lit(name).alias("vec_set"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    emb = spark.read.parquet(f"{d}/function_embeddings.parquet")
    body = spark.read.parquet(f"{d}/function_student_targets.parquet")
    a = top_similar(emb, F.concat_ws("|", F.coalesce("model_name", F.lit("")), F.coalesce(F.col("layer_index").cast("string"), F.lit(""))), "id", "embedding", 5, 0.9)
    b = top_similar(body, F.lit("body"), "function_id", "body_embedding", 5, 0.9)
    return _found(a, "embedding").unionByName(_found(b, "body_embedding"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar functions of every vector, however far: ``vec_set, id, neighbour, cosine``."""
    emb = spark.read.parquet(f"{d}/function_embeddings.parquet")
    body = spark.read.parquet(f"{d}/function_student_targets.parquet")
    space = F.concat_ws("|", F.coalesce("model_name", F.lit("")), F.coalesce(F.col("layer_index").cast("string"), F.lit("")))
    a = top_similar(emb, space, "id", "embedding", 5).withColumn("vec_set", F.lit("embedding"))
    b = top_similar(body, F.lit("body"), "function_id", "body_embedding", 5).withColumn("vec_set", F.lit("body_embedding"))
    return a.unionByName(b).select("vec_set", "id", "neighbour", "cosine")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}

_TOP = """{n}_v AS (SELECT DISTINCT {space} AS space, {item} AS id, CAST({vec} AS DOUBLE[]) AS v FROM {t} WHERE len({vec}) = 64
        AND len(list_filter({vec}, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter({vec}, lambda x: x <> 0)) > 0),
    {n}_s AS (SELECT a.space, a.id, b.id AS o, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM {n}_v a JOIN {n}_v b ON a.space = b.space AND a.id <> b.id),
    {n}_t AS (SELECT id, o, s FROM {n}_s QUALIFY row_number() OVER (PARTITION BY space, id ORDER BY s DESC, o) <= 5)"""
_SETS = _TOP.format(n="e", space="model_name || '|' || layer_index", item="id", vec="embedding", t="function_embeddings") + ", " + _TOP.format(
    n="b", space="'body'", item="function_id", vec="body_embedding", t="function_student_targets"
)
SQL = {
    "p2_found": f"""WITH {_SETS} SELECT DISTINCT 'embedding' AS vec_set, least(id, o) AS id_a, greatest(id, o) AS id_b FROM e_t WHERE s >= 0.9
        UNION ALL SELECT DISTINCT 'body_embedding' AS vec_set, least(id, o) AS id_a, greatest(id, o) AS id_b FROM b_t WHERE s >= 0.9""",
    "p2_neighbours": f"""WITH {_SETS} SELECT 'embedding' AS vec_set, id, o AS neighbour, s AS cosine FROM e_t
        UNION ALL SELECT 'body_embedding' AS vec_set, id, o AS neighbour, s AS cosine FROM b_t""",
}
