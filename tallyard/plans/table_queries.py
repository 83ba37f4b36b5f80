"""Queries over joins, sets, windows and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import from_log, per_thousand, risk_scope, sigmoid, warm_cosine
from ..functions.text import api_base, first_json_object
from ..operators import ranking
from ..operators.ranking import first_per_group
from ..sources import readers, sinks
from ..streaming.incremental import windowed_counts


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_ANCHOR = ["instance_id", "feature_file", "feature_function"]


def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    """D-3, D-4, H1: functions without a target yet."""
    done = _t(spark, d, "function_student_targets").select(F.col("function_id").alias("id"))
    return sinks.not_done(_t(spark, d, "function_embeddings").select("id", "model_name").distinct(), done, ["id"])


def newest_known(prs: DataFrame, known: DataFrame, pool: int = 12_000) -> DataFrame:
    """The ``pool`` newest pull requests of 2 to 40 files whose ``instance_id`` is in ``known`` (A6). A limit is part of
    the operator; its default is the reference's."""
    p = prs.where(F.col("changed_files").between(2, 40)).select("id", "instance_id", "created_at").distinct()
    return p.join(known.select("instance_id").distinct(), "instance_id", "left_semi").orderBy(F.desc_nulls_first("created_at"), "id").limit(pool).select("id", "instance_id")


def semi_pool_topn(spark: SparkSession, d: str) -> DataFrame:
    """A6, D-6, C2, C4, G2: the pool of the newest pull requests of a size, of which a function is known."""
    return newest_known(_t(spark, d, "prs_copy"), _t(spark, d, "function_static_props"))


def first_row_join(spark: SparkSession, d: str) -> DataFrame:
    """F1, D-8: each pull request's first crawl joined to its functions' count."""
    first = first_per_group(_t(spark, d, "prs_copy").select("instance_id", "id", "pull_number").distinct(), ["instance_id"], [F.col("id")])
    n = _t(spark, d, "function_static_props").groupBy("instance_id").agg(F.count_distinct("id").alias("n_functions"))
    return first.join(n, "instance_id").select("instance_id", "id", "pull_number", "n_functions")


def distinct_on_deterministic(spark: SparkSession, d: str) -> DataFrame:
    """One row for each key, the survivor chosen by a stated order."""
    f = _t(spark, d, "function_embeddings").select(*_ANCHOR, "id", "model_name", "layer_index").distinct()
    return first_per_group(f, ["feature_file", "feature_function"], [F.col("layer_index"), F.col("id")]).select("feature_file", "feature_function", "id")


def static_left_enrich(spark: SparkSession, d: str) -> DataFrame:
    """D-2, D-5, D-11, D-12, F2, F4, E30: widest range of each function joined on, the old value kept where none matches."""
    props = _t(spark, d, "function_static_props").where("feature_function is not null").groupBy(*_ANCHOR).agg(F.max("loc").alias("max_loc"), F.max("n_branches").alias("max_branches"))
    m = _t(spark, d, "followup_org_metrics").select(F.col("feature_instance_id").alias("instance_id"), "feature_file", "feature_function", F.coalesce("commits_touching_file", F.lit(0)).alias("old")).distinct()
    j = m.join(props.withColumn("hit", F.lit(1)), _ANCHOR, "left")
    return j.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_matched"), F.sum(F.when(F.col("hit").isNotNull(), F.coalesce("max_branches", F.lit(0))).otherwise(F.col("old"))).cast("bigint").alias("total")
    )


def three_way_counts(spark: SparkSession, d: str) -> DataFrame:
    """D-1, D-7, D-9, E6, H6."""
    e = _t(spark, d, "function_embeddings").select("id", "instance_id", "model_name").distinct()
    t = _t(spark, d, "function_student_targets").select(F.col("function_id").alias("id")).distinct()
    p = _t(spark, d, "prs_copy").select("instance_id", "pull_number").distinct()
    j = e.join(t, "id").join(p, "instance_id")
    return j.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_functions"), F.count_distinct("instance_id").alias("n_instances"))


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of difference, intersection and union of two key sets in one pass."""
    a = _t(spark, d, "function_static_props").select("instance_id").withColumn("side", F.lit(1))
    b = _t(spark, d, "prs_copy").select("instance_id").withColumn("side", F.lit(2))
    per = a.unionByName(b).groupBy("instance_id").agg(F.max(F.col("side") == 1).alias("a"), F.max(F.col("side") == 2).alias("b"))
    return per.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count(F.lit(1)).alias("either"))


def status_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each kind, their part, and means with missing values as 0."""
    e = _t(spark, d, "events")
    n = e.agg(F.count(F.lit(1)).alias("total"))
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("value", F.lit(0.0))), 4).alias("mean_value"))
    return per.crossJoin(F.broadcast(n)).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"), "mean_value")


def stage_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Each day's total against the first and the one before, for each kind of event."""
    per = _t(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    return per.select("event_type", "day", "n", (F.col("n") - F.first("n").over(w)).alias("since_first"), (F.col("n") - F.lag("n").over(w)).alias("since_last"))


def early_stop_trace(spark: SparkSession, d: str) -> DataFrame:
    """the best daily mean so far and for how many days it has stood, for each kind of event."""
    per = _t(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("m"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    best = per.withColumn("best", F.max("m").over(w))
    run = best.withColumn("at", F.sum(F.lit(1)).over(w)).withColumn("hit", F.max(F.when(F.col("m") == F.col("best"), F.col("at"))).over(w))
    return run.select("event_type", "day", "best", (F.col("at") - F.col("hit")).alias("waited"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles, and the mean with missing values at the median."""
    f = _t(spark, d, "function_static_props")
    p = ranking.percentiles(f, "loc", [0.1, 0.5, 0.9])
    mean = f.agg(F.round(F.avg(F.coalesce(F.col("loc").cast("double"), F.lit(1.0 if p[1] is None else p[1]))), 6).alias("mean_filled"))
    return mean.select(*[F.lit(x).cast("double").alias(n) for x, n in zip(p, ("p10", "p50", "p90"))], "mean_filled")


def fold_statistics(spark: SparkSession, d: str) -> DataFrame:
    """L1: mean and population deviation over groups of rows."""
    per = _t(spark, d, "function_static_props").groupBy("return_type_cat", "n_loops").agg(F.avg("loc").alias("m"))
    return per.groupBy("return_type_cat").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("deviation"))


def expressions(spark: SparkSession, d: str) -> DataFrame:
    """Numeric and text expressions over whole tables."""
    p = _t(spark, d, "prs_copy").select("id", "changed_files", "pr_body").distinct()
    n = F.coalesce("changed_files", F.lit(0)).cast("double")
    return p.select("id", F.round(risk_scope(n), 6).alias("scope"), F.round(sigmoid(n - 5), 6).alias("squashed"), F.round(from_log(n / 50), 6).alias("back"), F.round(per_thousand(F.lit(1.0), n), 6).alias("rate"),
                    F.round(warm_cosine(n, 5, 50, 0.1), 6).alias("factor"), F.coalesce(F.length(first_json_object("pr_body")), F.lit(0)).alias("object_length"), api_base(F.concat(F.lit("http://host/"), F.col("id").cast("string"))).alias("base")).distinct()


def marker_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Files of each marked change in a text log."""
    log = ["@@@a1\tx@y", "src/a.py", "", "src/b.py", "@@@b2\tz@y", "@@@c3\tx@y", "lib/c.py"]
    lines = spark.createDataFrame([("log", i, s) for i, s in enumerate(log)], "log string, n int, line string")
    return readers.marked_sessions(lines, "log", "n", "line").select("session", "hash", "author", "line")


def lookup_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4: rows of asked ids in the order asked."""
    f = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return readers.lookup(f, "id", [42, 3, 99999999, 7, 3]).select("position", "id", "label")


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """B2: metrics after a later delivery; each anchor's newest row stays."""
    m = _t(spark, d, "followup_org_metrics").select("feature_instance_id", "feature_file", "feature_function", "created_at", "ownership_friction").distinct()
    late = F.col("created_at") >= F.lit("2025-08-01").cast("timestamp")
    keys = ["feature_instance_id", "feature_file", "feature_function"]
    arrival = [F.desc("created_at"), F.desc_nulls_last("ownership_friction")]
    old = sinks.upsert_last_wins(m.limit(0), m.where(~late), keys, arrival)
    return sinks.upsert_last_wins(old, m.where(late), keys, arrival).select(*keys, "ownership_friction")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Targets of new functions are added, known ones stay as they are."""
    t = _t(spark, d, "function_student_targets").select(F.col("function_id").alias("id"), F.lit("target").alias("origin")).distinct()
    e = _t(spark, d, "function_embeddings").select("id", F.col("model_name").alias("origin")).distinct()
    return sinks.insert_ignore(t, e, ["id"], [F.col("origin")])


def get_or_create_id(spark: SparkSession, d: str) -> DataFrame:
    """A row and its dependent row share an id made from the natural key."""
    e = sinks.keyed_ids(_t(spark, d, "function_embeddings").select(*_ANCHOR, "model_name", "layer_index").distinct(), [*_ANCHOR, "model_name", "layer_index"], "key_id")
    child = e.select("key_id", F.length("feature_function").alias("n"))
    return e.join(child, "key_id").groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key_id").alias("n_keys"), F.sum("n").alias("total"))


def update_columns(spark: SparkSession, d: str) -> DataFrame:
    """Null texts filled from another table by key."""
    t = _t(spark, d, "function_student_targets").groupBy(F.col("function_id").alias("id")).agg(F.max("sig_text").alias("sig_text"))
    e = _t(spark, d, "function_embeddings").select("id", F.concat(F.lit("def "), F.col("feature_function")).alias("sig_text"))
    filled = sinks.update_by_key(t.where("sig_text is null"), e, "id", ["sig_text"])
    return t.where("sig_text is not null").unionByName(filled.select(*t.columns))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """2.N: event-time windows; the same code runs over a stream."""
    w = windowed_counts(_t(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        anti_resume, semi_pool_topn, first_row_join, distinct_on_deterministic, static_left_enrich, three_way_counts, key_sets, status_summary, stage_deltas, early_stop_trace, percentiles,
        fold_statistics, expressions, marker_sessions, lookup_in_order, upsert_last_wins, insert_ignore, get_or_create_id, update_columns, event_windows,
    )
}

SQL = {
    "anti_resume": "SELECT DISTINCT id, model_name FROM function_embeddings WHERE id NOT IN (SELECT function_id FROM function_student_targets)",
    "semi_pool_topn": """SELECT id, instance_id FROM (SELECT DISTINCT id, instance_id, created_at FROM prs_copy WHERE changed_files BETWEEN 2 AND 40
        AND instance_id IN (SELECT instance_id FROM function_static_props)) ORDER BY created_at DESC NULLS FIRST, id LIMIT 12000""",
    "first_row_join": """SELECT p.instance_id, p.id, p.pull_number, n_functions FROM (SELECT DISTINCT instance_id, id, pull_number
        FROM prs_copy QUALIFY dense_rank() OVER (PARTITION BY instance_id ORDER BY id) = 1) p
        JOIN (SELECT instance_id, count(DISTINCT id) AS n_functions FROM function_static_props GROUP BY 1) f ON f.instance_id = p.instance_id""",
    "distinct_on_deterministic": """SELECT DISTINCT ON (feature_file, feature_function) feature_file, feature_function, id FROM function_embeddings
        ORDER BY feature_file, feature_function, layer_index, id""",
    "static_left_enrich": """WITH p AS (SELECT instance_id, feature_file, feature_function, max(n_branches) AS b FROM function_static_props
        WHERE feature_function IS NOT NULL GROUP BY 1, 2, 3),
        m AS (SELECT DISTINCT feature_instance_id AS instance_id, feature_file, feature_function, coalesce(commits_touching_file, 0) AS old FROM followup_org_metrics)
        SELECT m.instance_id, count(*) AS n, count(p.instance_id) AS n_matched, CAST(sum(CASE WHEN p.instance_id IS NOT NULL THEN coalesce(b, 0)
        ELSE old END) AS BIGINT) AS total
        FROM m LEFT JOIN p ON p.instance_id = m.instance_id AND p.feature_file = m.feature_file AND p.feature_function = m.feature_function GROUP BY 1""",
    "three_way_counts": """SELECT model_name, count(*) AS n_rows, count(DISTINCT e.id) AS n_functions, count(DISTINCT e.instance_id) AS n_instances
        FROM (SELECT DISTINCT id, instance_id, model_name FROM function_embeddings) e
        JOIN (SELECT DISTINCT function_id FROM function_student_targets) t ON t.function_id = e.id JOIN (SELECT DISTINCT instance_id, pull_number
        FROM prs_copy) p ON p.instance_id = e.instance_id GROUP BY 1""",
    "key_sets": """WITH a AS (SELECT DISTINCT instance_id FROM function_static_props), b AS (SELECT DISTINCT instance_id FROM prs_copy)
        SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS "both", (SELECT count(*)
        FROM (FROM a UNION FROM b)) AS either""",
    "status_summary": """SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS rate, round(avg(coalesce(value, 0)),
        4) AS mean_value FROM events GROUP BY 1""",
    "stage_deltas": """WITH p AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, day, n, n - first_value(n) OVER w AS since_first, n - lag(n) OVER w AS since_last FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
    "early_stop_trace": """WITH p AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS m FROM events GROUP BY 1, 2),
        b AS (SELECT *, max(m) OVER w AS best, row_number() OVER w AS pos FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day))
        SELECT event_type, day, best, pos - max(CASE WHEN m = best THEN pos END) OVER (PARTITION BY event_type ORDER BY day) AS waited FROM b""",
    "percentiles": """WITH m AS (SELECT quantile_cont(loc, 0.1) AS p10, quantile_cont(loc, 0.5) AS p50, quantile_cont(loc, 0.9) AS p90 FROM function_static_props)
        SELECT p10, p50, p90, (SELECT round(avg(coalesce(loc, m.p50)), 6) FROM function_static_props) AS mean_filled FROM m""",
    "fold_statistics": """SELECT return_type_cat, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS deviation FROM (SELECT return_type_cat, n_loops,
        avg(loc) AS m FROM function_static_props GROUP BY 1, 2) GROUP BY 1""",
    "expressions": r"""WITH p AS (SELECT DISTINCT id, CAST(coalesce(changed_files, 0) AS DOUBLE) AS n, pr_body FROM prs_copy)
        SELECT DISTINCT id, round(least(1.0, ln(1 + n) / ln(40)), 6) AS scope, round(1 / (1 + exp(-greatest(-20, least(20, n - 5)))), 6) AS squashed,
        round(exp(greatest(n / 50, 0)) - 1, 6) AS back,
        CASE WHEN n <> 0 THEN round(1 / n * 1000, 6) END AS rate, round(CASE WHEN n < 5 THEN (n + 1) / 5
        ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (n - 5) / 45))) END, 6) AS factor,
        CAST(coalesce(length(regexp_extract(pr_body, '(?s)\{.*\}')), 0) AS INTEGER) AS object_length, 'http://host/' || id || '/v1' AS base FROM p""",
    "marker_sessions": """SELECT * FROM (VALUES (1::BIGINT, 'a1', 'x@y', 'src/a.py'), (1, 'a1', 'x@y', 'src/b.py'), (3, 'c3', 'x@y',
        'lib/c.py')) AS t(session, hash, author, line)""",
    "lookup_in_order": """SELECT position, vec_id AS id, label FROM (VALUES (0, 42), (1, 3), (2, 99999999), (3, 7), (4, 3)) AS w(position, i)
        JOIN embeddings ON vec_id = i""",
    "upsert_last_wins": """SELECT DISTINCT ON (feature_instance_id, feature_file, feature_function) feature_instance_id, feature_file,
        feature_function, ownership_friction FROM followup_org_metrics
        ORDER BY feature_instance_id, feature_file, feature_function, created_at DESC, ownership_friction DESC NULLS LAST""",
    "insert_ignore": """SELECT DISTINCT function_id AS id, 'target' AS origin FROM function_student_targets UNION ALL SELECT id,
        min(model_name) AS origin FROM function_embeddings WHERE id NOT IN (SELECT function_id FROM function_student_targets) GROUP BY 1""",
    "get_or_create_id": """SELECT model_name, count(*) AS n_rows, count(*) AS n_keys, CAST(sum(length(feature_function)) AS BIGINT) AS total
        FROM (SELECT DISTINCT instance_id, feature_file, feature_function, model_name, layer_index FROM function_embeddings) GROUP BY 1""",
    "update_columns": """WITH t AS (SELECT function_id AS id, max(sig_text) AS s FROM function_student_targets GROUP BY 1), e AS (SELECT id,
        max('def ' || feature_function) AS s FROM function_embeddings GROUP BY 1)
        SELECT t.id, coalesce(t.s, e.s) AS sig_text FROM t LEFT JOIN e ON e.id = t.id""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
