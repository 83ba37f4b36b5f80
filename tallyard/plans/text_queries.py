"""Queries over text and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.repos import repo_of_instance


def repo_slug_parse(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that instance ids of all three shapes name."""
    prs = spark.read.parquet(f"{d}/prs_copy.parquet")
    return prs.groupBy(repo_of_instance("instance_id").alias("named_repo")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("instance_id").alias("n_instances"))


def module_and_base(spark: SparkSession, d: str) -> DataFrame:
    """J2, J3."""
    f = spark.read.parquet(f"{d}/function_static_props.parquet")
    return f.groupBy(text.top_module("feature_file").alias("module"), text.base_name("feature_file").alias("base")).agg(F.count(F.lit(1)).alias("n"))


def diff_paths(spark: SparkSession, d: str) -> DataFrame:
    """Python files of each patch."""
    p = spark.read.parquet(f"{d}/prs_copy.parquet").select("id", "patch").distinct()
    return p.select("id", F.posexplode(text.diff_paths("patch")).alias("pos", "path"))


def name_quality(spark: SparkSession, d: str) -> DataFrame:
    """J6, J12, C1."""
    p = spark.read.parquet(f"{d}/prs_copy.parquet").where(F.col("pr_title").isNotNull() & (F.col("pr_title") != ""))
    return p.groupBy("pr_title").agg(F.max(F.round(text.name_quality("pr_title"), 6)).alias("quality"), F.round(F.max(scores.log_scale(F.length("pr_title"))), 6).alias("log_length"))


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """J18, C10, C17."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", text.line_count("text").cast("bigint").alias("n_lines"), (text.stripped_length("text") < 5).alias("is_short"), F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("head"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Tolerant reading of JSON text columns."""
    p = spark.read.parquet(f"{d}/prs_copy.parquet").select("id", "requested_reviewers", "file_patches").distinct()
    files = text.patch_files("file_patches")
    return p.select("id", text.json_length("requested_reviewers").cast("bigint").alias("n_reviewers"), F.size(files).cast("bigint").alias("n_files"), F.concat_ws("|", files).alias("files"))


def refactor_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Comments and threads that ask for restructuring."""
    p = spark.read.parquet(f"{d}/prs_copy.parquet").select("id", "review_threads", "comments").distinct()
    per = F.transform(text.thread_bodies("review_threads"), lambda b: text.mentions(b))
    return p.withColumn("per", per).select(
        "id",
        (F.aggregate("per", F.lit(0), lambda a, x: a + x) + text.mentions(text.comment_bodies("comments"))).cast("bigint").alias("n_comments"),
        F.size(F.filter("per", lambda x: x > 0)).cast("bigint").alias("n_threads"),
    )


def transitions(prs: DataFrame, files: tuple[int, int] = (1, 120), sizes: tuple[int, int] = (5, 8000), newest: int | None = None) -> DataFrame:
    """Pull requests with numbers of files and sizes in range, newest first, as rows of plain values (A7). The ranges are
    the reference's. All rows without ``newest``; the reference's own default there is 30,000."""
    size = scores.whole(F.col("additions")) + scores.whole(F.col("deletions"))
    rows = prs.where(F.col("changed_files").between(*files) & size.between(*sizes)).select(
        "id", "instance_id", F.coalesce(F.nullif(F.trim("pr_author"), F.lit("")), F.lit("unknown")).alias("author"), F.coalesce("pr_is_draft", F.lit(False)).alias("is_draft"),
        size.alias("size"), scores.whole(F.col("total_comments")).alias("n_comments"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "created_at",
    ).distinct()
    ordered = rows.orderBy(F.desc_nulls_first("created_at"), "id")
    return (ordered if newest is None else ordered.limit(newest)).drop("created_at")


def pr_transition_rows(spark: SparkSession, d: str) -> DataFrame:
    """All pull requests that have patches, in the reference's ranges."""
    return transitions(spark.read.parquet(f"{d}/prs_copy.parquet").where("patch is not null and file_patches is not null"))


def size_parse(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as printed by tools."""
    rows = [(i, s) for i, s in enumerate(["300", "1K", "1.5GB", "2 MiB", " 7t ", "x", "", None, "12.25m"])]
    return spark.createDataFrame(rows, "i int, printed string").select("i", text.human_size("printed").alias("bytes"))


QUERIES = {f.__name__: f for f in (repo_slug_parse, module_and_base, diff_paths, name_quality, line_stats, json_props, refactor_mentions, pr_transition_rows, size_parse)}

_JSON = lambda c: f"coalesce(TRY_CAST({c} AS JSON[]), [])"
_REFACTOR = r"(?i)\b(refactor|restructure|split\s+this|extract\s+\w+|too\s+large|too\s+big|naming|cleanup|architecture|design)\b"
_BODIES = lambda c: f"list_transform(list_filter({_JSON(c)}, lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce(x ->> 'body', ''))"
_HITS = lambda c: f"len(list_filter({_BODIES(c)}, lambda b: regexp_matches(b, '{_REFACTOR}')))"
SQL = {
    "repo_slug_parse": r"""SELECT regexp_replace(lower(CASE WHEN contains(instance_id, '#') THEN string_split(instance_id, '#')[1]
        WHEN len(string_split(instance_id, '__')) >= 3 AND regexp_full_match(string_split(instance_id, '__')[1], '[0-9]+')
        THEN string_split(instance_id, '__')[2] || '/' || string_split(instance_id, '__')[3]
        ELSE string_split(instance_id, '__')[1] || '/' || string_split(instance_id, '__')[2] END), '(\.git|/|\s)+$', '') AS named_repo,
        count(*) AS n_rows, count(DISTINCT instance_id) AS n_instances FROM prs_copy GROUP BY 1""",
    "module_and_base": """SELECT CASE WHEN trim(coalesce(feature_file, ''), '/') = '' THEN '__root__' ELSE string_split(trim(feature_file, '/'), '/')[1] END AS module,
        string_split(feature_file, '/')[-1] AS base, count(*) AS n FROM function_static_props GROUP BY 1, 2""",
    "diff_paths": r"""WITH p AS (SELECT DISTINCT id, patch FROM prs_copy), l AS (SELECT id, unnest(string_split(patch, chr(10))) AS line,
        generate_subscripts(string_split(patch, chr(10)), 1) AS n FROM p),
        m AS (SELECT id, n, CASE WHEN starts_with(line, '+++ b/') THEN regexp_extract(line, '^\+\+\+ b/(.+)$', 1) ELSE regexp_extract(line,
        '^diff --git a/(.+?) b/.+$', 1) END AS path FROM l),
        f AS (SELECT id, path, min(n) AS n FROM m WHERE regexp_matches(path, '\.pyx?$') GROUP BY 1, 2)
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS pos, path FROM f""",
    "name_quality": """WITH t AS (SELECT DISTINCT pr_title, regexp_extract_all(pr_title, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM prs_copy WHERE pr_title <> '')
        SELECT pr_title, round(CASE WHEN len(w) = 0 THEN 0.5 ELSE CAST(len(list_filter(w, lambda x: len(x) >= 3 AND NOT regexp_full_match(x,
        '[a-z][0-9]*'))) AS DOUBLE) / len(w) END, 6) AS quality,
        round(ln(1 + len(pr_title)), 6) AS log_length FROM t""",
    "line_stats": r"""SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$',
        ''), '\r\n|\r|\n')) END AS BIGINT) AS n_lines,
        length(regexp_replace(coalesce(text, ''),
        '^[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$',
        '', 'g')) < 5 AS is_short,
        coalesce(substr(text, 1, 40), '') AS head FROM documents""",
    "json_props": f"""WITH p AS (SELECT DISTINCT id, requested_reviewers, file_patches FROM prs_copy),
        f AS (SELECT id, requested_reviewers, list_filter(list_transform({_JSON("file_patches")}, lambda x: CASE
        WHEN json_type(x) = 'OBJECT' THEN coalesce(nullif(x ->> 'file_path', ''), nullif(x ->> 'path', ''), nullif(x ->> 'file', ''),
        nullif(x ->> 'filename', '')) ELSE x ->> '$' END),
            lambda x: x IS NOT NULL AND x <> '') AS files FROM p),
        g AS (SELECT id, requested_reviewers, list_filter(files, lambda x, i: list_position(files, x) = i) AS files FROM f)
        SELECT id, CAST(len({_JSON("requested_reviewers")}) AS BIGINT) AS n_reviewers, CAST(len(files) AS BIGINT) AS n_files,
        coalesce(array_to_string(files, '|'), '') AS files FROM g""",
    "refactor_mentions": f"""WITH p AS (SELECT DISTINCT id, review_threads, comments FROM prs_copy),
        t AS (SELECT id, comments, list_transform(list_filter({_JSON("review_threads")}, lambda t: json_type(t) = 'OBJECT'),
        lambda t: {_HITS("(t ->> 'comments')")}) AS per FROM p)
        SELECT id, CAST(coalesce(list_sum(per), 0) + {_HITS("comments")} AS BIGINT) AS n_comments, CAST(len(list_filter(per,
        lambda x: x > 0)) AS BIGINT) AS n_threads FROM t""",
    "pr_transition_rows": """SELECT id, instance_id, author, is_draft, size, n_comments, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM (
        SELECT DISTINCT id, instance_id, coalesce(nullif(trim(pr_author), ''), 'unknown') AS author, coalesce(pr_is_draft, false) AS is_draft,
        CAST(coalesce(additions, 0) AS BIGINT) + CAST(coalesce(deletions, 0) AS BIGINT) AS size, CAST(coalesce(total_comments, 0) AS BIGINT) AS n_comments, created_at
        FROM prs_copy WHERE patch IS NOT NULL AND file_patches IS NOT NULL AND changed_files BETWEEN 1 AND 120 AND coalesce(additions,
        0) + coalesce(deletions, 0) BETWEEN 5 AND 8000)""",
    "size_parse": """SELECT * FROM (VALUES (0, 300::BIGINT), (1, 1024), (2, 1610612736), (3, 2097152), (4, 7696581394432), (5, NULL), (6, NULL), (7,
        NULL), (8, 12845056)) AS t(i, bytes)""",
}
