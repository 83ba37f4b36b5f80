"""Queries of problem 6: results per repository although a few repositories hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.repos import repo_name
from ..operators.skew import skewed_group_metrics

_ANCHOR = ["feature_instance_id", "feature_file", "feature_function"]
_MEASURES = ["ownership_friction", "interface_stress", "commits_touching_file"]


def _metrics(spark: SparkSession, d: str, measures: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{d}/followup_org_metrics.parquet").withColumn("repo_key", repo_name("feature_repo"))
    return skewed_group_metrics(rows, "repo_key", _ANCHOR, measures)


def p6_found(spark: SparkSession, d: str, share: float = 0.04) -> DataFrame:
    """Repositories with at least ``share`` of all rows; rows without repository count in the total only."""
    m = _metrics(spark, d, [])
    total = m.agg(F.sum("n_rows").alias("total"))
    return m.crossJoin(F.broadcast(total)).where(F.col("key").isNotNull() & (F.col("n_rows") >= F.col("total") * share)).select(F.col("key").alias("repo"))


def p6_repo_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rows, anchors and metrics of each repository; rows without one are the row with a null repository."""
    m = _metrics(spark, d, _MEASURES)
    mean = lambda c: F.round(F.when(F.col(f"cnt_{c}") > 0, F.col(f"sum_{c}") / F.col(f"cnt_{c}")), 9)
    return m.select(
        F.col("key").alias("repo"),
        "n_rows",
        F.col("n_distinct").alias("n_anchors"),
        mean("ownership_friction").alias("mean_friction"),
        mean("interface_stress").alias("mean_stress"),
        F.col("max_commits_touching_file").alias("max_commits"),
        F.col("cnt_commits_touching_file").alias("n_commits_known"),
    )


QUERIES = {"p6_found": p6_found, "p6_repo_metrics": p6_repo_metrics}

_REPO = r"nullif(regexp_replace(regexp_replace(lower(feature_repo), '^\s+', ''), '(\.git|/|\s)+$', ''), '')"
SQL = {
    "p6_found": f"""SELECT {_REPO} AS repo FROM followup_org_metrics WHERE {_REPO} IS NOT NULL GROUP BY 1
        HAVING count(*) >= 0.04 * (SELECT count(*) FROM followup_org_metrics)""",
    "p6_repo_metrics": f"""SELECT {_REPO} AS repo, count(*) AS n_rows,
        count(DISTINCT (feature_instance_id, feature_file, feature_function)) AS n_anchors,
        round(avg(ownership_friction), 9) AS mean_friction, round(avg(interface_stress), 9) AS mean_stress,
        CAST(max(commits_touching_file) AS DOUBLE) AS max_commits, count(commits_touching_file) AS n_commits_known
        FROM followup_org_metrics GROUP BY 1""",
}
