"""Queries over source code and heads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, scores, text
from ..functions.repos import repo_name, repo_of_instance
from ..operators import heads, ml, packs, ranking, sampling, vectors
from ..operators.ranking import first_per_group
from ..scratch import Stored, own_path

_FEATURES = ["log_loc", "n_branches", "n_loops", "n_returns", "n_api_calls", "n_args"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "function_student_targets").where("sig_text is not null and body_text is not null")
    return t.select("function_id", F.concat_ws("\n", "sig_text", "body_text").alias("source")).distinct()


def ast_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the functions in all stored sources."""
    return code.code_functions(_sources(spark, d), "function_id", "source")


def split_source(spark: SparkSession, d: str) -> DataFrame:
    """M7: signature and body of each source."""
    s = _sources(spark, d).select("function_id", code.split_column("source").alias("s"))
    return s.select("function_id", "s.sig", "s.body")


def _props(spark: SparkSession, d: str) -> DataFrame:
    """Functions once each, with features, a 0/1 label and their repository."""
    f = _t(spark, d, "function_static_props").withColumn("repo", repo_of_instance("instance_id"))
    f = f.withColumn("label", F.col("has_side_effects").cast("int")).withColumn("log_loc", F.log1p("loc"))
    return f.select("id", "repo", "instance_id", "feature_file", "feature_function", "label", "loc", "cyclomatic_complexity", "return_type_cat", *_FEATURES).dropDuplicates(["id"])


def _split_props(spark: SparkSession, d: str) -> DataFrame:
    """K1: the functions with the split of their repository, written once."""
    f = _props(spark, d)
    return Stored(f.join(sampling.group_split(f, "repo", 42), "repo"), "props").df


def _quality(scored: DataFrame) -> DataFrame:
    test = scored.where("split = 'test'")
    out = ranking.auroc_ap(test, "label", "score").crossJoin(ranking.recall_mrr(test, "instance_id", "label", "score", "id", (1, 5)))
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def logreg_head(spark: SparkSession, d: str) -> DataFrame:
    """L1, L2, L15, L17, L18."""
    p = _split_props(spark, d)
    return _quality(p.withColumn("score", heads.fit_logistic(p.where("split = 'train'"), _FEATURES, "label").probability()))


def pairwise_head(spark: SparkSession, d: str) -> DataFrame:
    """A ranker on pairs of one instance; the plain head where there are no pairs."""
    p = _split_props(spark, d)
    train = p.where("split = 'train'")
    head = heads.fit_pairwise(train, _FEATURES, sampling.pair_draws(train, "instance_id", "label", "id"), "id") or heads.fit_logistic(train, _FEATURES, "label")
    return _quality(p.withColumn("score", head.probability()))


def network_head(spark: SparkSession, d: str) -> DataFrame:
    """A small network on the same features."""
    p = _split_props(spark, d)
    head, weights = heads.small_network(p.where("split = 'train'"), _FEATURES, "label")
    return _quality(heads.network_score(p, head, weights))


def ridge_head(spark: SparkSession, d: str) -> DataFrame:
    """Log complexity from features; R2 on the test split."""
    p = _split_props(spark, d).where("cyclomatic_complexity is not null").withColumn("y", F.log1p("cyclomatic_complexity"))
    head = heads.fit_ridge(p.where("split = 'train'"), _FEATURES, "y")
    return ranking.r_squared(p.where("split = 'test'"), F.col("y"), head.linear()).select(F.round("r2", 4).alias("r2"))


_DIMS = [f"x{i}" for i in range(64)]


def _spread(v: str, prefix: str) -> list[Column]:
    return [F.get(v, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(64)]


def _good(v: str) -> Column:
    return (F.size(v) == 64) & vectors.finite(vectors.as_double(v))


def _probed(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a vector, their properties, and a fold by hashed order within their return category."""
    e = first_per_group(_t(spark, d, "function_embeddings").where(_good("embedding")), ["id"], [F.col("model_name"), F.col("layer_index")])
    rows = Stored(e.select("id", *_spread("embedding", "x")).join(_props(spark, d).drop("repo", "instance_id", "feature_file", "feature_function"), "id"), "probed").df
    return rows.join(sampling.class_folds(rows.select("id", "return_type_cat"), "return_type_cat", "id", 5, 42).select("id", "fold"), "id")


def _over_folds(spark: SparkSession, name: str, values: dict[str, Sequence[float]]) -> DataFrame:
    """Mean and population deviation over the folds of each probe."""
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    per = spark.createDataFrame(rows, f"{name} string, value double").groupBy(name)
    return per.agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("deviation"))


def cv_properties(spark: SparkSession, d: str) -> DataFrame:
    """R2 of each property from the vectors, over five folds; skewed properties as ln(1 + x)."""
    p = _probed(spark, d)
    log = ["loc", "cyclomatic_complexity", "n_branches", "n_api_calls"]
    p = p.withColumns({c: F.log1p(c) for c in log})
    return _over_folds(spark, "property", {c: heads.cross_validated_ridge(p, _DIMS, c, "fold", 5) for c in [*log, "n_loops", "n_returns", "n_args"]})


def cv_classes(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy of the return category from the vectors, over five folds."""
    names = ["none", "primitive", "collection", "custom"]
    p = Stored(_probed(spark, d).withColumn("y", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("return_type_cat")) - 1).where("y >= 0"), "classes").df
    return _over_folds(spark, "property", {"return_type_cat": heads.cross_validated_classes(p, _DIMS, "y", len(names), "fold", 5)})


def tfidf_head(spark: SparkSession, d: str) -> DataFrame:
    """Is a document source code, from its words; words and weights of the training texts only."""
    t = _t(spark, d, "documents").where("text is not null and source is not null")
    t = t.select("doc_id", "text", (F.lower(F.trim("source")) == "source_code").cast("int").alias("label"), (sampling.hash_unit(F.col("doc_id"), seed=42) < 0.2).alias("held"))
    words = ml.TfIdf(t.where("not held"), "doc_id", "text", bias=True)
    v = Stored(words.transform(t).join(t.drop("text"), "doc_id"), "words").df
    model = ml.sparse_logistic(v.where("not held"), "label")
    return ranking.auroc_ap(ml.score(model, v).where("held"), "label", "score").select(F.round("auroc", 4).alias("auroc"), F.round("ap", 4).alias("ap"))


_ORG_LOG = ["commits_touching_file", "distinct_authors", "cochange_weighted_degree", "cochange_unique_neighbors"]
_ORG = ["top_author_fraction", "author_entropy", "ownership_friction", "cochange_cross_module_ratio", "interface_stress"]


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Functions with the scores of four base heads (of body vector, signature vector, words of the name, length), each
    fitted on the training split, and the raw further channels; written once."""
    p = _split_props(spark, d)
    e = first_per_group(_t(spark, d, "function_embeddings").where(_good("embedding")), ["id"], [F.col("model_name"), F.col("layer_index")]).select("id", *_spread("embedding", "x"))
    s = _t(spark, d, "function_student_targets").where(_good("sig_embedding")).select(F.col("function_id").alias("id"), *_spread("sig_embedding", "s")).dropDuplicates(["id"])
    rows = Stored(p.join(e, "id").join(s, "id", "left"), "records").df
    train = rows.where("split = 'train'")
    base = {"teacher": _DIMS, "student": [f"s{i}" for i in range(64)], "length": ["loc"]}
    scored = rows.withColumns({f"p_{n}": heads.fit_logistic(train, c, "label").probability() for n, c in base.items()}).drop(*_DIMS, *base["student"])
    named = rows.select("id", "split", "label", F.regexp_replace("feature_function", r"[_.]|(?<=[a-z])(?=[A-Z])", " ").alias("words")).where("words is not null and label is not null")
    words = ml.TfIdf(named.where("split = 'train'"), "id", "words", bias=True)
    v = Stored(words.transform(named).join(named.drop("words"), "id"), "words").df
    by_words = ml.score(ml.sparse_logistic(v.where("split = 'train'"), "label"), v, "p_words").select("id", "p_words")
    churn = rows.groupBy("feature_file", "feature_function").agg(F.count(F.lit(1)).alias("churn"))
    org = _t(spark, d, "followup_org_metrics").groupBy("feature_file").agg(*[F.avg(c).alias(c) for c in [*_ORG_LOG, *_ORG]])
    out = scored.join(by_words, "id", "left").join(churn, ["feature_file", "feature_function"], "left").join(org, "feature_file", "left")
    zero = {c: F.log1p(F.coalesce(c, F.lit(0.0))) for c in _ORG_LOG} | {c: F.coalesce(c, F.lit(0.0)) for c in _ORG}
    return Stored(out.withColumns(zero | {"log_churn": F.log1p(F.coalesce("churn", F.lit(1))), "log_cc": F.log1p("cyclomatic_complexity"), "p_words": F.coalesce("p_words", F.lit(0.5))}), "channels").df


_BASE = ["p_teacher", "p_student", "p_words", "p_length"]


def _mean_over_seeds(c: DataFrame, columns: list[str], seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Mean score of heads fitted on nine tenths of the training rows, another tenth left out for each seed."""
    train = c.where("split = 'train'")
    fitted = [heads.fit_logistic(train.where(sampling.hash_unit(F.col("id"), seed=s) < 0.9), columns, "label").probability() for s in seeds]
    return c.withColumn("score", reduce(Column.__add__, fitted) / len(fitted))


def fusion_head(spark: SparkSession, d: str) -> DataFrame:
    """A head over the four base scores; as in the base heads' use, training scores are in-sample."""
    return _quality(_mean_over_seeds(_channels(spark, d), _BASE))


def stacked_head(spark: SparkSession, d: str) -> DataFrame:
    """Base scores, complexity if enough rows have it (its median where it is missing), churn and nine
    organisational channels."""
    c, more = _channels(spark, d), ["log_churn", *_ORG_LOG, *_ORG]
    if heads.covered(c, "log_cc"):
        c = c.withColumn("log_cc", F.coalesce("log_cc", F.lit(c.agg(F.percentile_approx("log_cc", 0.5)).first()[0])))
        more.append("log_cc")
    return _quality(_mean_over_seeds(c, _BASE + more))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests once each, with the fields of a candidate."""
    p = first_per_group(_t(spark, d, "prs_copy"), ["id"], [F.col("created_at"), F.col("total_comments"), F.col("pr_title")])
    p = p.select("*", text.patch_files("file_patches").alias("files"))
    org = _t(spark, d, "followup_org_metrics").groupBy(F.col("feature_file").alias("file")).agg(
        F.avg("ownership_friction").alias("f"), F.avg("interface_stress").alias("i"), F.avg("distinct_authors").alias("a"), F.avg("cochange_cross_module_ratio").alias("c")
    )
    per = p.select("id", F.explode("files").alias("file")).distinct().join(org, "file", "left").withColumn("module", text.top_module("file"))
    module = per.groupBy("id", "module").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.count(F.lit(1)).alias("module_count"), (1 - F.max("n") / F.sum("n")).alias("cross_module_ratio"))
    mean = per.groupBy("id").agg(F.avg("f").alias("ownership_friction"), F.avg("i").alias("interface_stress"), F.avg("a").alias("distinct_authors"), F.avg("c").alias("cochange_cross_ratio"))
    n = lambda c: F.greatest(F.lit(0), scores.whole(F.col(c)))
    own = p.select(
        "id", repo_name(F.coalesce("repo", repo_of_instance("instance_id"))).alias("repo"), F.col("pr_merged").cast("int").alias("merged"), F.coalesce(F.col("pr_is_draft").cast("int"), F.lit(0)).alias("is_draft"),
        n("changed_files").alias("changed_files"), n("additions").alias("additions"), n("deletions").alias("deletions"), text.json_length("requested_reviewers").alias("n_reviewers"),
        n("total_review_threads").alias("n_threads"), n("total_comments").alias("n_comments"), F.col("closing_issue_id").isNotNull().cast("int").alias("has_issue"),
        text.name_quality("pr_title").alias("naming_quality"), scores.risk_scope(n("changed_files").cast("double")).alias("risk_scope"),
        (text.mentions(text.comment_bodies("comments")) > 0).cast("int").alias("refactor"),
    )
    return own.join(module, "id", "left").join(mean, "id", "left")


def pack_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Packs of six candidates; a head fitted on the packs of four fifths of the changes ranks the others."""
    c = Stored(packs.as_features(packs.candidate_packs(_changes(spark, d), "id")), "packs").df.withColumn("held", sampling.hash_unit(F.col("id"), seed=7) < 0.2)
    head = heads.fit_logistic(c.where("not held"), packs.FIELDS, "label")
    q = ranking.pack_quality(c.where("held").withColumn("score", head.probability()), "id", "label", "score", "kind", "candidate")
    return q.select(*[F.round(x, 4).alias(x) for x in q.columns])


def two_heads(spark: SparkSession, d: str) -> DataFrame:
    """Two heads on six fields of a change, whether it was merged and whether restructuring was asked for; written
    as JSON, read back and scored on a fifth held out by repository."""
    held = (sampling.hash_unit(F.coalesce("repo", F.lit("")), seed=7) < 0.2).alias("held")
    c = Stored(packs.as_features(_changes(spark, d)).select("*", held), "changes").df
    fields, rows = ["is_draft", "changed_files", "additions", "deletions", "n_reviewers", "has_issue"], []
    for name in ("merged", "refactor"):
        path = own_path(spark, f"head-{name}")
        heads.fit_logistic(c.where("not held"), fields, name).write(spark, path)
        test = c.where("held").withColumn("score", heads.Head.read(spark, path).probability())
        rows.append(ranking.auroc_ap(test.where(F.col(name).isNotNull()), name, "score").select(F.lit(name).alias("head"), F.round("auroc", 4).alias("auroc"), F.round("ap", 4).alias("ap")))
    return rows[0].unionByName(rows[1])


QUERIES = {
    f.__name__: f
    for f in (
        ast_props, split_source, logreg_head, pairwise_head, network_head, ridge_head, cv_properties, cv_classes, tfidf_head, fusion_head, stacked_head, pack_ranker, two_heads,
    )
}
SQL: dict[str, str] = {}
