"""Connected components of record links (problems 4 and 5).

``forest_components`` (problem 4): union-find inside edge partitions keeps only spanning forests, which are merged
through fewer and fewer partitions of bounded size. ``star_components`` (problem 5): alternating large-star and
small-star on the whole edge list. Both give each node the smallest node of its component and keep every intermediate
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.repos import repo_name, repo_of_instance
from ..scratch import Stored

# ------------------------------------------------------------------ union-find


def smallest_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and for each the smallest node of its component, by vectorised hooking and halving."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star forest of a partition's edges: (node, smallest node of its tree). Folded in as the batches come, so that
    never more than the forest and one portion is held."""
    held: list[np.ndarray] = []
    size, forest = 0, np.empty((2, 0), np.int64)
    for b in batches:
        held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
        size += b.num_rows
        if size >= 200_000:
            forest = _fold([forest, *held])
            held, size = [], 0
    forest = _fold([forest, *held])
    for at in range(0, forest.shape[1], 100_000):
        part = forest[:, at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], names=["node", "root"])


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    e = np.concatenate(parts, axis=1)
    if not e.shape[1]:
        return e
    nodes, roots = smallest_roots(e[0], e[1])
    child = nodes != roots
    return np.stack([nodes[child], roots[child]])


_EDGE = "node bigint, root bigint"


def forest_components(edges: DataFrame, a: str, b: str, part_edges: int = 2_000_000, fan_in: int = 8, max_rounds: int = 60) -> DataFrame:
    """``node bigint, component bigint``: the smallest id of everything linked to ``node``, itself included.

    Every level runs union-find in each partition and keeps only a spanning forest. The next level has ``fan_in`` times
    fewer partitions, but never fewer than keep each within ``part_edges`` forest edges. The forests are partitioned by
    child, so one child's parents meet and a hub's children spread. Once one partition is enough, its union-find is the
    answer; where the graph is larger than that, levels alternate with pointer jumps until no root has a parent. Links
    with a null end are no links; an id linked to itself only is its own component; repeated links don't matter.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(a).cast("bigint").alias("node"), F.col(b).cast("bigint").alias("root")).where("node is not null and root is not null")
    # union-find within the input partitions: what is shuffled first is already forests
    alone = links.where("node = root").select("node", "root")
    stored = Stored(links.where("node != root").mapInArrow(_forest, _EDGE), "forest")
    parts = max(1, stored.df.rdd.getNumPartitions())
    for _ in range(max_rounds):
        n = stored.df.count()
        need = max(1, -(-n // part_edges))
        parts = max(need, -(-parts // fan_in))
        merged = Stored(stored.df.repartition(parts, "node").mapInArrow(_forest, _EDGE), "forest")
        stored.drop()
        stored = merged
        if parts == 1:
            break
        if need > 1:
            stored, settled = _jump(stored, part_edges)
            if settled:
                break
    else:
        raise RuntimeError("the forests did not settle")
    found = stored.df.select("node", F.col("root").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    single = alone.join(stored.df, "node", "left_anti").join(roots, "node", "left_anti").select("node", F.col("node").alias("component")).distinct()
    return found.unionByName(roots).unionByName(single)


def _jump(stored: Stored, part_edges: int) -> tuple[Stored, bool]:
    """Pointer jumping to a fixed point; settled if then every node has one root only. The children of a giant root are
    spread over as many salts as its count asks for."""
    while True:
        e = stored.df
        # parents of nodes that are themselves roots; heavy roots spread over salts
        up = e.join(e.select(F.col("root").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.min("root").alias("top"))
        if up.isEmpty():
            one = e.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").isEmpty()
            return stored, one
        largest = e.groupBy("root").count().agg(F.max("count")).first()[0] or 0
        salts = max(1, -(-largest // part_edges))
        left = e.withColumn("salt", F.pmod(F.hash("node"), F.lit(salts)))
        right = up.select(F.col("node").alias("root"), "top", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
        # a node keeps its link to an old root only through that root's own link upwards
        moved = left.join(right, ["root", "salt"], "left").select("node", F.coalesce("top", "root").alias("root")).where("node != root").distinct()
        nxt = Stored(moved, "forest")
        stored.drop()
        stored = nxt


# ------------------------------------------------------- large-star, small-star


def _star(edges: DataFrame, large: bool, n: int, heavy_share: int) -> DataFrame:
    """One large-star or small-star step over distinct edges (u > v)."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select("u", "v")
    stats = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("deg"))
    limit = max(1000, n // heavy_share)
    hubs = F.broadcast(stats.where(F.col("deg") > limit).select("u", F.col("m").alias("hub_m")))
    marked = pairs.join(hubs, "u", "left")
    light = marked.where("hub_m is null").drop("hub_m").join(stats.where(F.col("deg") <= limit).select("u", "m"), "u")
    all_ = light.select("u", "v", "m").unionByName(marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))
    if large:
        out = all_.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = all_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stats.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def star_components(edges: DataFrame, a: str, b: str, heavy_share: int = 200, max_rounds: int = 60, part_edges: int = 200_000) -> DataFrame:
    """``node, component``: for every node of a link the smallest node it is linked to, directly or not.

    Alternates large-star (neighbours above a node link to its smallest neighbour) and small-star (neighbours below do)
    until the edges no longer change. Nodes may be of any ordered type. Null ends and loops are no links; a node
    without links isn't listed. Hubs with more than 1/``heavy_share`` of the edges are joined by broadcast (they are
    fewer than twice ``heavy_share``), so no task holds a hub's edges.
    """
    x, y = F.col(a), F.col(b)
    first = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    stored = Stored(first, "star")

    def step(large: bool) -> Stored:
        """One step, written in parts of some ``part_edges`` edges: a small graph isn't worth many tasks."""
        out = _star(half.df if not large else stored.df, large, now[0], heavy_share)
        return Stored(out.coalesce(parts) if parts == 1 else out, "star")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = mark(stored.df)
    for _ in range(max_rounds):
        parts = max(1, -(-now[0] // part_edges))
        half = step(True)
        done = step(False)
        half.drop()
        stored.drop()
        stored, before, now = done, now, mark(done.df)
        if before == now:
            break
    else:
        raise RuntimeError("the stars did not settle")
    found = stored.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


# ------------------------------------------------------------------- problem 4


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.read.parquet(f"{d}/knn_pairs.parquet")
    j = F.col("judge")
    match = pairs.where(j["score_c"].isin(2, 3) & j["skipped"].isNull() & j["error"].isNull() & (F.col("query_id") != F.col("neighbour_id")))
    return forest_components(match, "query_id", "neighbour_id").select(F.col("node").alias("function_id"), F.col("component").alias("group_id"))


# ------------------------------------------------------------------- problem 5


def repo_links(spark: SparkSession, d: str) -> DataFrame:
    """Links ``a, b`` between repositories and authors. A repository is a node ``owner/name``; an author is a node
    above every repository in order, so that the smallest node of a component is always a repository."""
    prs = spark.read.parquet(f"{d}/prs_copy.parquet").select(
        repo_name("repo").alias("own"), repo_of_instance("instance_id").alias("named"), F.lower(F.regexp_replace("pr_author", r"^\s+|\s+$", "")).alias("author")
    )
    org = spark.read.parquet(f"{d}/followup_org_metrics.parquet").select(repo_name("feature_repo").alias("own"), repo_of_instance("feature_instance_id").alias("named"))
    by_author = (
        prs.where(F.col("author").isNotNull() & ~F.col("author").isin("", "unknown"))
        .select(F.coalesce("own", "named").alias("a"), F.concat(F.lit("\U0010ffff"), F.col("author")).alias("b"))
        .where("a is not null")
    )
    renamed = prs.select("own", "named").unionByName(org).where("own != named").select(F.col("own").alias("a"), F.col("named").alias("b"))
    return by_author.unionByName(renamed).distinct()


def repo_groups(spark: SparkSession, d: str) -> DataFrame:
    """``repo, group_repo`` of all repositories with a link; an author's only repository forms a group of one."""
    found = star_components(repo_links(spark, d), "a", "b").where(~F.col("node").startswith("\U0010ffff"))
    return found.select(F.col("node").alias("repo"), F.col("component").alias("group_repo"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    groups = repo_groups(spark, d)
    several = groups.where("repo != group_repo").select("group_repo").distinct()
    return groups.join(several, "group_repo", "left_semi").select("repo", "group_repo")


_SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))


def proportional_splits(weights: DataFrame, group: str, rows: str, splits=_SPLITS, seed: int = 7, heavy: float = 0.002, buckets: int = 4096) -> DataFrame:
    """``<group>, split``: splits whose row shares are as near to the given ones as whole groups allow.

    A group's identifier is hashed into [0, 1) and the splits are consecutive ranges. A group above ``heavy`` of all
    rows (at most 1/``heavy`` of them, hence small enough for the driver) would shift the ranges; it goes first, largest
    first, to the split that lacks most. The range borders are then set on a histogram of ``buckets`` hash buckets, so
    that the other groups fill what is left. The same input gives the same splits.
    """
    total = weights.agg(F.sum(rows)).first()[0] or 0
    big = weights.where(F.col(rows) > total * heavy).select(group, rows).orderBy(F.desc(rows), group).collect()
    lacking = {s: p * total for s, p in splits}
    fixed = {}
    for g, n in big:
        fixed[g] = max(lacking, key=lambda s: lacking[s])
        lacking[fixed[g]] -= n
    light = weights.where(~(F.col(rows) > total * heavy)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(buckets)))
    filled = dict(light.groupBy("bucket").agg(F.sum(rows)).collect())
    want = np.maximum([lacking[s] for s, _ in splits], 0)
    ends = np.cumsum(want) / max(want.sum(), 1) * sum(filled.values())
    run, of = 0.0, []
    for k in range(buckets):
        n = filled.get(k, 0)
        # a bucket goes to the range that holds its middle
        of.append(min(int(np.searchsorted(ends, run + n / 2, side="right")), len(splits) - 1))
        run += n
    cuts = [sum(o <= i for o in of) for i in range(len(splits))]
    range_of = F.lit(splits[-1][0])
    for i in reversed(range(len(splits) - 1)):
        range_of = F.when(F.col("bucket") < cuts[i], splits[i][0]).otherwise(range_of)
    placed = light.select(group, range_of.alias("split"))
    if not fixed:
        return placed
    kept = weights.sparkSession.createDataFrame(list(fixed.items()), placed.schema)
    return placed.unionByName(kept)


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each repository in both tables with its new split: ``src, repo, n_rows, group_repo, split``.

    Rows without a repository are spread as a group of their own: repo null, group_repo ``(none)``.
    """
    org = spark.read.parquet(f"{d}/followup_org_metrics.parquet").select(F.lit("followup_org_metrics").alias("src"), repo_name("feature_repo").alias("repo"))
    emb = spark.read.parquet(f"{d}/function_embeddings.parquet").select(F.lit("function_embeddings").alias("src"), repo_of_instance("instance_id").alias("repo"))
    counts = org.unionByName(emb).groupBy("src", "repo").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = Stored(counts.join(repo_groups(spark, d), "repo", "left").withColumn("group_repo", F.coalesce("group_repo", "repo", F.lit("(none)"))), "rows").df
    placed = proportional_splits(rows.groupBy("group_repo").agg(F.sum("n_rows").alias("n_rows")), "group_repo", "n_rows")
    return rows.join(placed, "group_repo").select("src", "repo", "n_rows", "group_repo", "split")


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_splits": p5_splits}

_CLOSURE = """edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(x, y) AS (SELECT a, a FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y)"""


def _norm(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(lower({c}), '^\s+', ''), '(\.git|/|\s)+$', ''), '')"


def _named(c: str) -> str:
    parts = f"string_split({c}, '__')"
    return _norm(
        f"CASE WHEN contains({c}, '#') THEN string_split({c}, '#')[1] WHEN len({parts}) >= 3 AND regexp_full_match({parts}[1], '\\s*[0-9]+')"
        f" THEN {parts}[2] || '/' || {parts}[3] WHEN len({parts}) >= 2 THEN {parts}[1] || '/' || {parts}[2] ELSE {c} END"
    )


SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE links AS (SELECT query_id AS a, neighbour_id AS b FROM knn_pairs
        WHERE judge.score_c IN (2, 3) AND judge.skipped IS NULL AND judge.error IS NULL AND query_id <> neighbour_id),
    {_CLOSURE} SELECT x AS function_id, min(y) AS group_id FROM reach GROUP BY x""",
    "p5_found": f"""WITH RECURSIVE prs AS (SELECT {_norm("repo")} AS own, {_named("instance_id")} AS named,
        lower(trim(pr_author)) AS author FROM prs_copy),
    org AS (SELECT {_norm("feature_repo")} AS own, {_named("feature_instance_id")} AS named FROM followup_org_metrics),
    by_author AS (SELECT coalesce(own, named) AS r, author FROM prs WHERE author NOT IN ('', 'unknown')),
    links AS (SELECT r AS a, min(r) OVER (PARTITION BY author) AS b FROM by_author
        UNION SELECT own, named FROM (SELECT own, named FROM prs UNION SELECT own, named FROM org) WHERE own <> named),
    {_CLOSURE}, groups AS (SELECT x AS repo, min(y) AS group_repo, count(*) AS n FROM reach GROUP BY x)
    SELECT repo, group_repo FROM groups WHERE n > 1""",
}
