"""Queries over pull requests and organisational metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.repos import repo_name
from ..functions.text import patch_files, top_module
from ..operators import labels, org

_NUM = ["commits_touching_file", "distinct_authors", "ownership_friction", "cochange_weighted_degree", "cochange_unique_neighbors", "interface_stress"]


def _touches(spark: SparkSession, d: str) -> DataFrame:
    """One row for each pull-request row and Python file; as delivered, so repeated rows count for ownership."""
    p = spark.read.parquet(f"{d}/prs_copy.parquet")
    author = F.coalesce(F.nullif(F.lower(F.trim("pr_author")), F.lit("")), F.lit("unknown"))
    return p.select(F.coalesce(repo_name("repo"), F.lit("(none)")).alias("repo"), "instance_id", author.alias("author"), F.explode(patch_files("file_patches")).alias("file")).where(
        F.col("file").rlike(r"\.(py|pyi|pyx)$")
    )


def _coupling(spark: SparkSession, d: str) -> DataFrame:
    return org.coupling(org.cochange(_touches(spark, d), ["repo", "instance_id"], "file", 120), "repo")


def ownership_metrics(spark: SparkSession, d: str) -> DataFrame:
    """E8, E10, E11, E12."""
    o = org.ownership(_touches(spark, d), ["repo", "file"], "author")
    return o.select("repo", "file", "n_touches", "n_authors", *[F.round(c, 6).alias(c) for c in ("top_share", "entropy", "friction")])


def cochange_edges(spark: SparkSession, d: str) -> DataFrame:
    """D-15, C14, J2, H4."""
    return org.cochange(_touches(spark, d), ["repo", "instance_id"], "file", 120)


def interface_stress(spark: SparkSession, d: str) -> DataFrame:
    """E9, E13, E14."""
    t = _touches(spark, d).groupBy("repo", "file").agg(F.count_distinct("instance_id").alias("n_changes"))
    c = _coupling(spark, d).withColumnRenamed("src", "file")
    joined = t.join(c, ["repo", "file"], "left")
    return joined.select("repo", "file", *[F.round(F.coalesce(x, F.lit(0.0)), 6).alias(x) for x in ("degree", "cross_ratio", "stress")],
                         F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), org.coverage_flag(F.col("n_changes"), F.col("n_neighbours")).alias("flag"))


def repo_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of each metric in each repository."""
    m = spark.read.parquet(f"{d}/followup_org_metrics.parquet").withColumn("repo", repo_name("feature_repo")).where("repo is not null")
    return org.upper_median(m, ["repo"], _NUM)


def first_seen_stats(spark: SparkSession, d: str) -> DataFrame:
    """The first value of each file, counted once for every occurrence, averaged per repository."""
    m = spark.read.parquet(f"{d}/followup_org_metrics.parquet").withColumn("repo", repo_name("feature_repo")).where("repo is not null")
    first = F.min_by(F.coalesce("ownership_friction", F.lit(0.0)), F.struct("created_at", "feature_instance_id", "feature_function", F.coalesce("ownership_friction", F.lit(0.0))))
    per = m.groupBy("repo", "feature_file").agg(first.alias("friction"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_rows"), F.round(F.sum(F.col("friction") * F.col("n")) / F.sum("n"), 9).alias("mean_friction"))


def org_fallback_merge(spark: SparkSession, d: str) -> DataFrame:
    """D-13, D-11, C6: each function's file metrics from history, else from pull requests, else its repository's median."""
    m = spark.read.parquet(f"{d}/followup_org_metrics.parquet").withColumn("repo", repo_name("feature_repo"))
    want = m.select("repo", F.col("feature_file").alias("file")).distinct()
    git = m.where((F.col("metric_source") == "git_history") & (F.col("commits_touching_file") > 0)).groupBy("repo", F.col("feature_file").alias("file")).agg(F.max("ownership_friction").alias("g_friction"), F.max("commits_touching_file").alias("g_n"))
    proxy = org.ownership(_touches(spark, d), ["repo", "file"], "author").select("repo", "file", F.col("friction").alias("p_friction"), F.col("n_touches").alias("p_n"))
    median = org.upper_median(m.where("repo is not null"), ["repo"], ["ownership_friction", "commits_touching_file"]).select("repo", F.col("ownership_friction").alias("d_friction"), F.col("commits_touching_file").alias("d_n"))
    j = want.join(git, ["repo", "file"], "left").join(proxy, ["repo", "file"], "left").join(median, ["repo"], "left")
    pick = lambda p: {"friction": F.col(f"{p}_friction"), "n": F.col(f"{p}_n").cast("bigint")}
    cols = org.fallback(
        [("git_history", F.col("g_n").isNotNull(), pick("g")), ("db_proxy", F.col("p_n").isNotNull(), pick("p")), ("repo_fallback", F.col("d_friction").isNotNull(), pick("d"))],
        {"friction": F.lit(0.0), "n": F.lit(0).cast("bigint")},
    )
    return j.select("repo", "file", *cols).withColumn("friction", F.round("friction", 6))


def pr_file_avg_with_default(spark: SparkSession, d: str) -> DataFrame:
    """D-14, E17: a pull request's mean friction over the files that have one, else its repository's median, else 0."""
    m = spark.read.parquet(f"{d}/followup_org_metrics.parquet").withColumn("repo", repo_name("feature_repo")).where("repo is not null")
    by_file = m.groupBy("repo", F.col("feature_file").alias("file")).agg(F.avg("ownership_friction").alias("f"))
    median = org.upper_median(m, ["repo"], ["ownership_friction"]).withColumnRenamed("ownership_friction", "d")
    t = _touches(spark, d).select("repo", "instance_id", "file").distinct()
    per = t.join(by_file, ["repo", "file"], "left").groupBy("repo", "instance_id").agg(F.avg("f").alias("mean_f"), F.count("f").alias("n_matched"))
    return per.join(median, "repo", "left").select("repo", "instance_id", "n_matched", F.round(F.coalesce("mean_f", "d", F.lit(0.0)), 6).alias("friction"))


def module_mix(spark: SparkSession, d: str) -> DataFrame:
    """Modules of each pull request, their dominance, and the three largest."""
    t = _touches(spark, d).select("instance_id", "file").distinct()
    per = t.groupBy("instance_id", top_module("file").alias("module")).agg(F.count(F.lit(1)).alias("n"))
    ranked = per.withColumn("rn", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("n"), "module")))
    top = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "module"))))
    return ranked.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_modules"), F.round(1 - F.max("n") / F.sum("n"), 6).alias("spread"), F.concat_ws(",", top["module"]).alias("top3"))


def anchor_labels(spark: SparkSession, d: str) -> DataFrame:
    """E1 to E4, D-7: labels of each user and day from the events table."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return labels.anchor_labels(e, ["user_id", "day"], "event_type", "event_id", "value", ["click", "purchase"])


def relabel_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Weak labels taken back, rows kept."""
    a = anchor_labels(spark, d)
    flag, n = labels.relabel(F.col("has_click"), F.col("n_click"), F.col("max_click_overlap"), 50.0)
    return a.select("user_id", "day", flag.alias("has_click"), n.alias("n_click"))


def churn_counts(spark: SparkSession, d: str) -> DataFrame:
    """E5, E7, D-10, E26: churn of each function, 1 where no other table knows it."""
    f = spark.read.parquet(f"{d}/function_static_props.parquet").where("feature_function is not null")
    known = labels.churn(spark.read.parquet(f"{d}/function_embeddings.parquet"), ["feature_file", "feature_function"], "instance_id").withColumnRenamed("n_rows", "n_known")
    own = f.groupBy("feature_file", "feature_function").agg(F.count(F.lit(1)).alias("n_rows"))
    return own.join(known, ["feature_file", "feature_function"], "left").select("feature_file", "feature_function", "n_rows", F.coalesce("churn", F.lit(1)).alias("churn"))


QUERIES = {f.__name__: f for f in (ownership_metrics, cochange_edges, interface_stress, repo_upper_median, first_seen_stats, org_fallback_merge, pr_file_avg_with_default, module_mix, anchor_labels, relabel_threshold, churn_counts)}

_REPO = r"nullif(regexp_replace(regexp_replace(lower({c}), '^\s+', ''), '(\.git|/|\s)+$', ''), '')"
_T = f"""raw AS (SELECT coalesce({_REPO.format(c="repo")}, '(none)') AS repo, instance_id, coalesce(nullif(lower(trim(pr_author)), ''), 'unknown') AS author,
        list_filter(list_transform(coalesce(TRY_CAST(file_patches AS JSON[]), []), lambda x: CASE
        WHEN json_type(x) = 'OBJECT' THEN coalesce(nullif(x ->> 'file_path', ''), nullif(x ->> 'path', ''), nullif(x ->> 'file', ''),
        nullif(x ->> 'filename', '')) ELSE x ->> '$' END), lambda x: x <> '') AS fs FROM prs_copy),
    t AS (SELECT repo, instance_id, author, unnest(list_distinct(fs)) AS file FROM raw), touches AS (SELECT * FROM t WHERE regexp_matches(file, '\\.(py|pyi|pyx)$'))"""
_OWN = """cnt AS (SELECT repo, file, author, count(*) AS n FROM touches GROUP BY 1, 2, 3), tot AS (SELECT repo, file, sum(n) AS t, count(*) AS a,
        max(n) AS m FROM cnt GROUP BY 1, 2),
    ent AS (SELECT repo, file, any_value(t) AS t, any_value(a) AS a, any_value(m) AS m, -sum(n / t * ln(n / t + 1e-12)) AS h FROM cnt
        JOIN tot USING (repo, file) GROUP BY 1, 2),
    own AS (SELECT repo, file, CAST(t AS BIGINT) AS n_touches, a AS n_authors, m / t AS top_share, h AS entropy,
        greatest(0.0, least(1.0, 0.6 * (1 - m / t) + 0.4 * (CASE WHEN a > 1 THEN h / ln(greatest(a, 2)) ELSE 0 END))) * least(1.0,
        ln(1 + a) / ln(10)) AS friction FROM ent)"""
_MOD = "CASE WHEN trim({c}, '/') = '' THEN '__root__' ELSE string_split(trim({c}, '/'), '/')[1] END"
_EDGE = f"""once AS (SELECT DISTINCT repo, instance_id, file FROM touches), narrow AS (SELECT * FROM once WHERE (repo, instance_id) IN (SELECT (repo,
        instance_id) FROM once GROUP BY repo, instance_id HAVING count(*) <= 120)),
    edges AS (SELECT a.repo, a.file AS src, b.file AS dst, CAST(sum(CASE WHEN {_MOD.format(c="a.file")} <> {_MOD.format(c="b.file")} THEN 1.25
        ELSE 1.0 END) AS DOUBLE) AS weight
        FROM narrow a JOIN narrow b ON a.repo = b.repo AND a.instance_id = b.instance_id AND a.file <> b.file GROUP BY 1, 2, 3)"""
_M = f"m AS (SELECT *, {_REPO.format(c='feature_repo')} AS repo FROM followup_org_metrics)"
_MED = lambda c: f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))[CAST(floor(count({c}) / 2) AS BIGINT) + 1]"
_ANCHOR = """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, """ + ", ".join(
    f"CAST(max(CASE WHEN event_type = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS has_{c}, count(DISTINCT CASE WHEN event_type = '{c}' THEN event_id END) AS n_{c}, coalesce(max(CASE WHEN event_type = '{c}' THEN value END), 0.0) AS max_{c}_overlap"
    for c in ("click", "purchase")
) + " FROM events GROUP BY 1, 2"
SQL = {
    "ownership_metrics": f"""WITH {_T}, {_OWN} SELECT repo, file, n_touches, n_authors, round(top_share, 6) AS top_share, round(entropy,
        6) + 0.0 AS entropy, round(friction, 6) AS friction FROM own""",
    "cochange_edges": f"WITH {_T}, {_EDGE} SELECT * FROM edges",
    "interface_stress": f"""WITH {_T}, {_EDGE}, c AS (SELECT repo, src AS file, sum(weight) AS degree, count(*) AS n_neighbours, sum(CASE
        WHEN {_MOD.format(c="src")} <> {_MOD.format(c="dst")} THEN weight ELSE 0 END) / sum(weight) AS r FROM edges GROUP BY 1, 2)
        SELECT f.repo, f.file, round(coalesce(degree, 0.0), 6) AS degree, round(coalesce(r, 0.0), 6) AS cross_ratio, round(coalesce(ln(1 + degree) * r,
        0.0), 6) AS stress, coalesce(n_neighbours, 0) AS n_neighbours,
        CASE WHEN coalesce(n_neighbours, 0) = 0 THEN 'low_signal' ELSE 'ok' END AS flag FROM (SELECT DISTINCT repo, file FROM touches) f LEFT
        JOIN c ON c.repo = f.repo AND c.file = f.file""",
    "repo_upper_median": f"WITH {_M} SELECT repo, " + ", ".join(f"{_MED(c)} AS {c}" for c in _NUM) + " FROM m WHERE repo IS NOT NULL GROUP BY 1",
    "first_seen_stats": f"""WITH {_M}, p AS (SELECT repo, feature_file, first(coalesce(ownership_friction, 0.0) ORDER BY created_at,
        feature_instance_id, feature_function, coalesce(ownership_friction, 0.0)) AS f, count(*) AS n FROM m WHERE repo IS NOT NULL GROUP BY 1, 2)
        SELECT repo, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(f * n) / sum(n), 9) AS mean_friction FROM p GROUP BY 1""",
    "org_fallback_merge": f"""WITH {_T}, {_OWN}, {_M}, want AS (SELECT DISTINCT repo, feature_file AS file FROM m),
        git AS (SELECT repo, feature_file AS file, max(ownership_friction) AS f, max(commits_touching_file) AS n FROM m
        WHERE metric_source = 'git_history' AND commits_touching_file > 0 GROUP BY 1, 2),
        med AS (SELECT repo, {_MED("ownership_friction")} AS f, {_MED("commits_touching_file")} AS n FROM m WHERE repo IS NOT NULL GROUP BY 1)
        SELECT w.repo, w.file, round(CASE WHEN g.n IS NOT NULL THEN g.f WHEN o.n_touches IS NOT NULL THEN o.friction WHEN d.f IS NOT NULL THEN d.f
        ELSE 0 END, 6) AS friction,
        CAST(CASE WHEN g.n IS NOT NULL THEN g.n WHEN o.n_touches IS NOT NULL THEN o.n_touches WHEN d.f IS NOT NULL THEN d.n ELSE 0 END AS BIGINT) AS n,
        CASE WHEN g.n IS NOT NULL THEN 'git_history' WHEN o.n_touches IS NOT NULL THEN 'db_proxy' WHEN d.f IS NOT NULL THEN 'repo_fallback'
        ELSE 'missing' END AS metric_source
        FROM want w LEFT JOIN git g ON g.repo = w.repo AND g.file = w.file LEFT JOIN own o ON o.repo = w.repo AND o.file = w.file LEFT JOIN med d ON d.repo = w.repo""",
    "pr_file_avg_with_default": f"""WITH {_T}, {_M}, bf AS (SELECT repo, feature_file AS file, avg(ownership_friction) AS f FROM m
        WHERE repo IS NOT NULL GROUP BY 1, 2), med AS (SELECT repo, {_MED("ownership_friction")} AS d FROM m WHERE repo IS NOT NULL GROUP BY 1),
        p AS (SELECT t.repo, t.instance_id, avg(f) AS mf, count(f) AS n_matched FROM (SELECT DISTINCT repo, instance_id, file FROM touches) t LEFT
        JOIN bf ON bf.repo = t.repo AND bf.file = t.file GROUP BY 1, 2)
        SELECT p.repo, instance_id, n_matched, round(coalesce(mf, d, 0.0), 6) AS friction FROM p LEFT JOIN med ON med.repo = p.repo""",
    "module_mix": f"""WITH {_T}, p AS (SELECT instance_id, {_MOD.format(c="file")} AS module, count(*) AS n FROM (SELECT DISTINCT instance_id, file
        FROM touches) GROUP BY 1, 2)
        SELECT instance_id, count(*) AS n_modules, round(1 - max(n) / sum(n), 6) AS spread, array_to_string(list(module ORDER BY n DESC, module)[1:3],
        ',') AS top3 FROM p GROUP BY 1""",
    "anchor_labels": _ANCHOR,
    "relabel_threshold": f"""SELECT user_id, day, CAST(CASE WHEN has_click = 1 AND max_click_overlap < 50 THEN 0
        ELSE has_click END AS INTEGER) AS has_click, CASE WHEN has_click = 1 AND max_click_overlap < 50 THEN 0 ELSE n_click END AS n_click
        FROM ({_ANCHOR})""",
    "churn_counts": """WITH k AS (SELECT feature_file, feature_function, count(DISTINCT instance_id) AS churn FROM function_embeddings GROUP BY 1, 2),
        o AS (SELECT feature_file, feature_function, count(*) AS n_rows FROM function_static_props WHERE feature_function IS NOT NULL GROUP BY 1, 2)
        SELECT feature_file, feature_function, n_rows, coalesce(churn, 1) AS churn FROM o LEFT JOIN k USING (feature_file, feature_function)""",
}
