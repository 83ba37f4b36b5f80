"""Queries over ranking metrics, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.repos import repo_of_instance
from ..operators import ranking, sampling


def _props(spark: SparkSession, d: str) -> DataFrame:
    """Functions once each, with a 0/1 label and a score."""
    f = spark.read.parquet(f"{d}/function_static_props.parquet")
    return f.select("id", "instance_id", "feature_function", F.col("has_side_effects").cast("int").alias("label"), F.coalesce("cyclomatic_complexity", F.lit(0)).alias("score"), "loc", "n_branches", "has_docstring").distinct()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """F5, F7, L17, L18."""
    return _rounded(ranking.recall_mrr(_props(spark, d), "instance_id", "label", "score", "id", (1, 3, 5, 10)))


def topk_payload(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each group as one nested list, flattened again."""
    r = ranking.ranked(_props(spark, d), "instance_id", "score", "id").where(F.col("rank") <= 5)
    nested = r.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "label"))).alias("topk"))
    return nested.select("instance_id", F.inline("topk"))


def auroc_ap(spark: SparkSession, d: str) -> DataFrame:
    """L15."""
    return _rounded(ranking.auroc_ap(_props(spark, d), "label", "score"))


def bacc_f1(spark: SparkSession, d: str) -> DataFrame:
    """L15, L16."""
    return _rounded(ranking.binary_quality(_props(spark, d), "label", F.col("score") >= 8))


def spearman_r2(spark: SparkSession, d: str) -> DataFrame:
    """F12, L5, J23."""
    p = _props(spark, d).where("loc is not null and score is not null")
    return _rounded(ranking.spearman(p, "loc", "score").crossJoin(ranking.r_squared(p, F.log1p("loc"), F.log1p("score"))))


def group_split(spark: SparkSession, d: str) -> DataFrame:
    """K1, K5."""
    r = spark.read.parquet(f"{d}/function_embeddings.parquet").select(repo_of_instance("instance_id").alias("repo"))
    return sampling.group_split(r, "repo", 42)


def _by_repo(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("repo", F.lit("(none)")).alias("repo"))


def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    """The reference's target of 50,000."""
    return sampling.stratified_cap(_by_repo(spark, d), "repo", "doc_id").select("repo", "doc_id")


def bounded_anchors(spark: SparkSession, d: str) -> DataFrame:
    """K4, G6, K11."""
    return sampling.bounded_sample(_props(spark, d).where("feature_function is not null"), "feature_function", "id", 2, 300, 7).select("feature_function", "id")


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """K6."""
    r = spark.read.parquet(f"{d}/function_static_props.parquet").select(repo_of_instance("instance_id").alias("repo"))
    return sampling.group_folds(r, "repo", 5)


def class_folds(spark: SparkSession, d: str) -> DataFrame:
    """K7."""
    return sampling.class_folds(_props(spark, d).select("id", "label"), "label", "id", 5, 42).select("id", "label", F.col("fold").cast("int").alias("fold"))


def pair_construct(spark: SparkSession, d: str) -> DataFrame:
    """The reference's 300 draws of each group at most."""
    return sampling.pair_draws(_props(spark, d), "instance_id", "label", "id")


def candidate_packs(spark: SparkSession, d: str) -> DataFrame:
    """K9, L19."""
    p = spark.read.parquet(f"{d}/prs_copy.parquet").select("id", F.coalesce("changed_files", F.lit(0)).alias("size")).distinct()
    v = sampling.variants(p, "id", ["size"], {"wide": 0.5, "wider": 1.0, "narrow": -0.5}, 42)
    return _rounded(ranking.pack_quality(v, "id", "label", "size", "kind", "kind"))


QUERIES = {f.__name__: f for f in (recall_mrr, topk_payload, auroc_ap, bacc_f1, spearman_r2, group_split, stratified_cap, bounded_anchors, group_folds, class_folds, pair_construct, candidate_packs)}

_P = """p AS (SELECT DISTINCT id, instance_id, feature_function, CAST(has_side_effects AS INTEGER) AS label, coalesce(cyclomatic_complexity,
        0) AS score, loc, n_branches, has_docstring FROM function_static_props)"""
_R = f"{_P}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY score DESC NULLS LAST, id) AS INTEGER) AS rank FROM p)"
_NAMED = r"""regexp_replace(lower(CASE WHEN contains(instance_id, '#') THEN string_split(instance_id, '#')[1] WHEN len(string_split(instance_id,
        '__')) >= 3 AND regexp_full_match(string_split(instance_id, '__')[1], '[0-9]+')
    THEN string_split(instance_id, '__')[2] || '/' || string_split(instance_id, '__')[3] ELSE string_split(instance_id,
        '__')[1] || '/' || string_split(instance_id, '__')[2] END), '(\.git|/|\s)+$', '')"""
_U = lambda *x: f"(CAST(('0x' || substr(md5({' || chr(124) || '.join(x)}), 1, 8)) AS BIGINT) / 4294967296.0)"
SQL = {
    "recall_mrr": f"WITH {_R}, g AS (SELECT instance_id, sum(label) AS pos, min(CASE WHEN label = 1 THEN rank END) AS f, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE label = 1 AND rank <= {k}) AS a{k}" for k in (1, 3, 5, 10))
    + " FROM r GROUP BY 1 HAVING sum(label) > 0) SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, round(avg(1.0 / f), 6) AS mrr, " + ", ".join(f"round(avg(a{k} / pos), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + " FROM g",
    "topk_payload": f"WITH {_R} SELECT instance_id, rank, id, label FROM r WHERE rank <= 5",
    "auroc_ap": f"""WITH {_P}, s AS (SELECT score, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n FROM p WHERE label IS NOT NULL GROUP BY 1),
        c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM s)
        SELECT round(sum(n * (cp - p) + 0.5 * n * p) / (sum(p) * sum(n)), 6) AS auroc, round(sum(p * cp / (cp + cn)) / sum(p), 6) AS ap FROM c""",
    "bacc_f1": f"""WITH {_P}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 8) AS tp, count(*) FILTER (WHERE label = 0
        AND score >= 8) AS fp, count(*) FILTER (WHERE label = 1 AND score < 8) AS fn, count(*) FILTER (WHERE label = 0 AND score < 8) AS tn FROM p
        WHERE label IS NOT NULL)
        SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
        round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 6) AS majority FROM c""",
    "spearman_r2": f"""WITH {_P}, q AS (SELECT loc, score FROM p WHERE loc IS NOT NULL), r AS (SELECT *,
        rank() OVER (ORDER BY loc) + (count(*) OVER (PARTITION BY loc) - 1) / 2 AS ra,
        rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rb FROM q)
        SELECT round(corr(ra, rb), 6) AS spearman, round(1 - sum((ln(1 + loc) - ln(1 + score)) ** 2) / (count(*) * var_pop(ln(1 + loc))), 6) AS r2 FROM r""",
    "group_split": f"""WITH g AS (SELECT DISTINCT {_NAMED} AS repo FROM function_embeddings), p AS (SELECT repo,
        row_number() OVER (ORDER BY md5(repo || '|42'), repo) - 1 AS p, count(*) OVER () AS n FROM g),
        s AS (SELECT *, greatest(1, CAST(floor(0.1 * n) AS BIGINT)) AS v FROM p) SELECT repo, CASE WHEN p < v THEN 'val' WHEN p < v + greatest(1,
        n - CAST(floor(0.8 * n) AS BIGINT) - v) THEN 'test' ELSE 'train' END AS split FROM s""",
    "stratified_cap": """WITH t AS (SELECT doc_id, coalesce(repo, '(none)') AS repo FROM documents), c AS (SELECT repo, count(*) AS n FROM t
        GROUP BY 1), caps AS (SELECT unnest(range(0, (SELECT max(n) FROM c) + 1)) AS cap),
        best AS (SELECT max(cap) AS cap FROM (SELECT cap, sum(least(n, cap)) AS s FROM caps, c GROUP BY 1) WHERE s <= 50000)
        SELECT repo, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM t)
        WHERE rn <= (SELECT cap FROM best)""",
    "bounded_anchors": f"""WITH {_P}, r AS (SELECT feature_function, id, row_number() OVER (PARTITION BY feature_function ORDER BY md5(id || '|7'),
        id) AS rn FROM p WHERE feature_function IS NOT NULL)
        SELECT feature_function, id FROM r WHERE rn <= 2 ORDER BY md5(id || '|7'), id LIMIT 300""",
    "group_folds": f"""WITH RECURSIVE g AS (SELECT {_NAMED} AS repo, count(*) AS n FROM function_static_props GROUP BY 1),
        m AS (SELECT repo, n, n > (SELECT sum(n) FROM g) * 0.001 AS big, CAST(floor({_U("coalesce(repo, '')", "'42'")} * 1024) AS INTEGER) AS b FROM g),
        u AS (SELECT n, CAST(NULL AS INTEGER) AS b, repo FROM m WHERE big UNION ALL SELECT CAST(sum(n) AS BIGINT), b, CAST(NULL AS VARCHAR) FROM m WHERE NOT big GROUP BY b),
        o AS (SELECT *, row_number() OVER (ORDER BY n DESC, b IS NOT NULL, repo, b) AS i FROM u),
        w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, 0 AS f
            UNION ALL SELECT o.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + o.n ELSE x END),
                list_position(loads, list_min(loads)) FROM w JOIN o ON o.i = w.i + 1)
        SELECT m.repo, m.n, CAST(w.f - 1 AS INTEGER) AS fold FROM m JOIN o ON CASE WHEN m.big THEN o.repo = m.repo ELSE o.b = m.b END JOIN w ON w.i = o.i""",
    "class_folds": f"""WITH {_P}, q AS (SELECT DISTINCT id, label FROM p) SELECT id, label, CAST((row_number() OVER (PARTITION BY label
        ORDER BY md5(id || '|42'), id) - 1) % 5 AS INTEGER) AS fold FROM q""",
    "pair_construct": f"""WITH {_P}, m AS (SELECT DISTINCT instance_id, label, id FROM p WHERE label IS NOT NULL), n AS (SELECT *,
        row_number() OVER (PARTITION BY instance_id, label ORDER BY id) - 1 AS i FROM m),
        g AS (SELECT instance_id, count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label = 0) AS nn FROM m GROUP BY 1), d AS (SELECT *,
        unnest(range(1, least(300, np * nn) + 1)) AS draw FROM g WHERE np > 0 AND nn > 0),
        w AS (SELECT instance_id, draw, CAST(floor({_U("instance_id", "draw", "'p'", "'42'")} * np) AS BIGINT) AS ip,
        CAST(floor({_U("instance_id", "draw", "'n'", "'42'")} * nn) AS BIGINT) AS iq FROM d)
        SELECT w.instance_id, CAST(draw AS INTEGER) AS draw, a.id AS pos, b.id AS neg FROM w JOIN n a ON a.instance_id = w.instance_id AND a.label = 1
        AND a.i = ip JOIN n b ON b.instance_id = w.instance_id AND b.label = 0 AND b.i = iq""",
    "candidate_packs": f"""WITH p AS (SELECT DISTINCT id, coalesce(changed_files, 0) AS size FROM prs_copy), v AS (SELECT id, kind, size * CASE kind
        WHEN 'wide' THEN 1 + 0.5 * {_U("id", "kind", "'42'")} WHEN 'wider' THEN 1 + 1.0 * {_U("id", "kind", "'42'")}
        WHEN 'narrow' THEN 1 - 0.5 * {_U("id", "kind", "'42'")} ELSE 1 END AS s FROM p, (SELECT unnest(['real', 'wide', 'wider', 'narrow']) AS kind)),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, kind) AS rank FROM v), real AS (SELECT id, rank, s FROM r WHERE kind = 'real'),
        g AS (SELECT r.id, any_value(real.rank) AS f, avg(CASE WHEN real.s > r.s THEN 1.0 ELSE 0 END) AS w FROM r JOIN real USING (id) WHERE kind <> 'real' GROUP BY 1)
        SELECT round(avg(CASE WHEN f = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(1.0 / f), 6) AS mrr, round(avg(w), 6) AS win_rate FROM g""",
}
