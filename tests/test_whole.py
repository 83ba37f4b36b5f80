"""Queries over more rows than their samples hold: the whole job comes out."""

from pyspark.sql import functions as F

from tallyard.plans import catalogue, table_queries


def _pull_requests(spark, folder, n):
    """n pull requests of distinct ids, the last ones with 100 files and 7,000 lines."""
    wide = F.col("id") >= n - 50
    spark.range(n).select(
        "id", F.concat(F.lit("a__b__"), "id").alias("instance_id"), F.lit("who").alias("pr_author"), F.lit(False).alias("pr_is_draft"), F.when(wide, 100).otherwise(3).alias("changed_files"),
        F.when(wide, 7000).otherwise(10).alias("additions"), F.lit(None).cast("int").alias("deletions"), F.lit(1).alias("total_comments"), F.timestamp_seconds(F.col("id") * 60).alias("created_at"),
        F.when(F.col("id") > 0, "p").alias("patch"), F.lit("[]").alias("file_patches"),
    ).write.parquet(f"{folder}/prs_copy.parquet")


def test_all_transitions(spark, tmp_path):
    _pull_requests(spark, tmp_path, 400)
    got = [r["id"] for r in catalogue.queries()["pr_transition_rows"](spark, str(tmp_path)).collect()]
    assert got == list(range(399, 0, -1))


def test_full_pool(spark, tmp_path):
    _pull_requests(spark, tmp_path, 400)
    spark.range(0, 12_400).select(F.concat(F.lit("a__b__"), F.col("id") % 300).alias("instance_id")).write.parquet(f"{tmp_path}/function_static_props.parquet")
    got = [r["id"] for r in catalogue.queries()["semi_pool_topn"](spark, str(tmp_path)).collect()]
    assert got == list(range(299, -1, -1))


def test_pool_is_bounded_by_the_reference(spark):
    prs = spark.range(12_050).select("id", F.col("id").cast("string").alias("instance_id"), F.lit(2).alias("changed_files"), F.timestamp_seconds("id").alias("created_at"))
    got = {r["id"] for r in table_queries.newest_known(prs, prs).collect()}
    assert got == set(range(50, 12_050))


def test_full_draws_and_target(spark, tmp_path):
    n = F.col("id")
    spark.range(40).select(
        "id", F.lit("a__b__1").alias("instance_id"), F.lit("f").alias("feature_function"), (n % 2 == 0).alias("has_side_effects"), F.lit(1).alias("cyclomatic_complexity"),
        F.lit(1).alias("loc"), F.lit(1).alias("n_branches"), F.lit(True).alias("has_docstring"),
    ).write.parquet(f"{tmp_path}/function_static_props.parquet")
    spark.range(900).select(n.alias("doc_id"), F.lit("r").alias("repo")).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.queries()["pair_construct"](spark, str(tmp_path)).count() == 300
    assert catalogue.queries()["stratified_cap"](spark, str(tmp_path)).count() == 900
