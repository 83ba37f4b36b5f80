"""Queries over vectors and judged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import disconnect, pair_tier
from ..operators import pairs, vectors
from ..scratch import at_most


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _labelled_knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = _emb(spark, d)
    near = vectors.exact_knn(e, "vec_id", "embedding", k)
    lab = lambda n: e.select(F.col("vec_id").alias(n), F.col("label").alias(f"{n}_label"))
    return near.join(lab("query"), "query").join(lab("neighbour"), "neighbour")


def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    """I1, I2, I5, F6, C18, D-16, G4."""
    return vectors.exact_knn(_emb(spark, d), "vec_id", "embedding", 10).select("query", "neighbour", "rank", F.round("similarity", 5).alias("similarity"))


def knn_cross_label(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours share their query's label."""
    n = _labelled_knn(spark, d, 10)
    return n.groupBy(F.col("query_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("query_label") != F.col("neighbour_label")).alias("n_cross"), F.round(F.avg("similarity"), 5).alias("mean_similarity"))


def knn_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4, I4: one vector's neighbours with their metadata, in rank order."""
    e = _emb(spark, d)
    near = vectors.exact_knn(e, "vec_id", "embedding", 10, e.where("vec_id = 7"))
    return near.join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").select("rank", "neighbour", "label").orderBy("rank")


def pairwise_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Full similarity matrix between the labels' mean vectors."""
    m = vectors.mean_vector(_emb(spark, d).where(vectors.finite(vectors.as_double("embedding"))), ["label"], "embedding").select("label", vectors.normalise(F.col("mean")).alias("v"))
    a, b = m.select(F.col("label").alias("a"), F.col("v").alias("va")), m.select(F.col("label").alias("b"), F.col("v").alias("vb"))
    return a.join(F.broadcast(at_most(b, 20_000)), F.col("a") <= F.col("b")).select("a", "b", F.round(vectors.dot(F.col("va"), F.col("vb")), 5).alias("similarity"))


def centroid_center_norm(spark: SparkSession, d: str) -> DataFrame:
    """Every vector centred on the mean of the training groups (labels under 8), then normalised."""
    e = _emb(spark, d).select("vec_id", "label", vectors.as_double("embedding").alias("v"))
    mean = vectors.mean_vector(e.where("label < 8"), [], "v")
    c = e.crossJoin(F.broadcast(mean)).select("vec_id", vectors.normalise(F.zip_with("v", "mean", lambda x, y: x - y)).alias("c"), "mean")
    return c.select("vec_id", F.round(vectors.dot(F.col("c"), F.col("mean")), 6).alias("to_mean"), F.round(F.get("c", F.lit(0)), 6).alias("first"))


def retrieval_rank_at_k(spark: SparkSession, d: str) -> DataFrame:
    """The rank of a function's own body among all bodies, searched by its signature vector."""
    t = spark.read.parquet(f"{d}/function_student_targets.parquet").select("function_id", F.col("sig_embedding").alias("sig"), F.col("body_embedding").alias("body"))
    ok = t.where((F.size("sig") == 64) & (F.size("body") == 64) & vectors.finite(F.col("sig")) & vectors.finite(F.col("body"))).dropDuplicates(["function_id"])
    r = vectors.own_ranks(ok, "function_id", "sig", "body", up_to=10)
    return r.agg(*[F.count_if(F.col("rank") <= k).alias(f"n_at_{k}") for k in (1, 5, 10)], F.count(F.lit(1)).alias("n"))


def infonce_value(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive loss of each label's mean against all vectors of that label and of the others."""
    e = _emb(spark, d).select("vec_id", "label", vectors.normalise(vectors.as_double("embedding")).alias("v"))
    m = vectors.mean_vector(e, ["label"], "v").select(F.col("label").alias("anchor"), vectors.normalise(F.col("mean")).alias("m"))
    s = e.crossJoin(F.broadcast(at_most(m, 20_000))).select("vec_id", "label", "anchor", vectors.dot(F.col("v"), F.col("m")).alias("s"))  # the stated set of anchors
    own = F.sum(F.when(F.col("label") == F.col("anchor"), F.col("s")))
    per = s.groupBy("vec_id", "label").agg(vectors.info_nce(own, F.sum(F.exp(F.col("s") / 0.07)), 0.07).alias("loss"))
    return per.groupBy("label").agg(F.round(F.avg("loss"), 5).alias("loss"), F.count(F.lit(1)).alias("n"))


def vector_hygiene(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with values that aren't finite, dropped or with zeros in their place."""
    f = spark.read.parquet(f"{d}/function_embeddings.parquet").where("embedding is not null").select("id", "model_name", vectors.as_double("embedding").alias("v")).dropDuplicates(["id"])
    z = vectors.zero_bad(F.col("v"))
    return f.groupBy("model_name").agg(F.count_if(vectors.finite(F.col("v"))).alias("n_finite"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate(z, F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))


def masked_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the vectors of a label that a mask (first value positive) selects."""
    e = _emb(spark, d).select("label", "vec_id", vectors.as_double("embedding").alias("v"))
    p = vectors.mean_pool(e, ["label"], "v", F.get("v", F.lit(0)) > 0)
    return p.select("label", F.posexplode("pooled").alias("place", "value")).withColumn("value", F.round("value", 6))


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document that overlap its characters 100 to 200."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    w = t.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).withColumn("end", F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id").orderBy("pos")))
    hit = w.where(vectors.overlaps(F.col("end") - F.length("w") - 1, F.col("end") - 1, F.lit(100), F.lit(200)))
    return hit.groupBy("doc_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/knn_pairs.parquet")


def pair_band_filter(spark: SparkSession, d: str) -> DataFrame:
    """C7, K13, C19."""
    p = _pairs(spark, d).where(pairs.band(F.col("cross_repo"), F.col("cosine_similarity"), 0.8))
    tier = pair_tier(F.col("cross_repo"), F.col("cosine_similarity"), F.when(pairs.judged(F.col("judge")), F.col("judge.score_c")))
    return p.groupBy("query_model", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """C8, D-6, H1."""
    return pairs.hard_negatives(_pairs(spark, d), spark.read.parquet(f"{d}/function_embeddings.parquet"), "id", 0.5, 1)


def hard_negative_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Negatives of each anchor, counted up to 10."""
    per = hard_negatives(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.least("n", F.lit(10)).alias("n_negatives")).agg(F.count(F.lit(1)).alias("n_anchors"))


def pair_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """All stage counters in one pass."""
    p = _pairs(spark, d)
    ok = pairs.judged(F.col("judge"))
    return p.groupBy("query_model").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(ok).alias("n_judged"), F.count_if(F.col("judge.skipped").isNotNull()).alias("n_skipped"),
        F.count_if(ok & (F.col("judge.score_c") >= 2)).alias("n_positive"), F.count_if(ok & F.col("cross_repo")).alias("n_cross"),
    )


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on pairs across repositories."""
    s = _pairs(spark, d).where(pairs.judged(F.col("judge")) & F.col("cross_repo")).select(F.col("judge.score_c").alias("s"))
    return s.agg(*[F.count_if(F.col("s") == i).alias(f"n_{i}") for i in range(4)], F.round(F.avg("s"), 6).alias("mean"))


def disconnect_flags(spark: SparkSession, d: str) -> DataFrame:
    """J21, G7."""
    p = _pairs(spark, d).where(pairs.judged(F.col("judge")))
    kind = disconnect(F.col("judge.score_a"), F.col("judge.score_b"))
    return p.where(kind.isNotNull()).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cosine_similarity"), 6).alias("mean_similarity"))


def top_disconnects(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar pairs whose name and body disagree."""
    p = _pairs(spark, d).where(pairs.judged(F.col("judge")) & disconnect(F.col("judge.score_a"), F.col("judge.score_b")).isNotNull())
    one = p.select("query_id", "neighbour_id", F.round("cosine_similarity", 9).alias("similarity")).distinct()
    return one.orderBy(F.desc_nulls_last("similarity"), "query_id", "neighbour_id").limit(10)


def _rule(a: str, b: str) -> tuple[int, int, int]:
    n = 3 if len(a) == len(b) else 2 if abs(len(a) - len(b)) < 20 else 0
    return n, n, n


def judge_pairs_stub(spark: SparkSession, d: str) -> DataFrame:
    """M14, D-17: the judge seam with a rule in the judge's place."""
    p = _pairs(spark, d).select("query_id", "neighbour_id").distinct()
    both = pairs.with_sources(p, spark.read.parquet(f"{d}/function_student_targets.parquet"), "function_id", "body_text")
    return pairs.judge_pairs(both, _rule).groupBy(F.col("score_c").cast("bigint").alias("score")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_top10, knn_cross_label, knn_point_lookup, pairwise_matrix, centroid_center_norm, retrieval_rank_at_k, infonce_value, vector_hygiene, masked_mean_pool, span_overlap,
        pair_band_filter, hard_negatives, hard_negative_histogram, pair_stage_counts, score_histogram, disconnect_flags, top_disconnects, judge_pairs_stub,
    )
}

_N = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v,
        lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS v FROM e)"""
_KNN = f"""{_N}, s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS ql, b.label AS nl, list_dot_product(a.v, b.v) AS s FROM n a
        JOIN n b ON a.vec_id <> b.vec_id),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, neighbour) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"""
_OK = "judge IS NOT NULL AND judge.error IS NULL AND judge.skipped IS NULL"
_HARD = f"""SELECT DISTINCT query_id, neighbour_id, judge.score_c AS score FROM knn_pairs WHERE {_OK} AND judge.score_c BETWEEN 0 AND 1 AND cosine_similarity >= 0.5
    AND query_id IN (SELECT id FROM function_embeddings) AND neighbour_id IN (SELECT id FROM function_embeddings)"""
_DIS = f"SELECT *, CASE WHEN judge.score_b > judge.score_a THEN 'name_misleads' ELSE 'name_overclaims' END AS kind FROM knn_pairs WHERE {_OK} AND abs(judge.score_a - judge.score_b) >= 2"
_MEANS = "mean AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {t}) GROUP BY 1, 2) GROUP BY 1)"
_UNIT = "list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-9))"
SQL = {
    "knn_top10": f"WITH {_KNN} SELECT query, neighbour, rank, round(s, 5) AS similarity FROM k",
    "knn_cross_label": f"""WITH {_KNN} SELECT ql AS label, count(*) AS n, count(*) FILTER (WHERE ql <> nl) AS n_cross, round(avg(s),
        5) AS mean_similarity FROM k GROUP BY 1""",
    "knn_point_lookup": f"WITH {_KNN} SELECT rank, neighbour, nl AS label FROM k WHERE query = 7",
    "pairwise_matrix": f"""WITH {_N}, {_MEANS.format(t='e')}, u AS (SELECT label, {_UNIT.format(v='m')} AS m FROM mean) SELECT a.label AS a,
        b.label AS b, round(list_dot_product(a.m, b.m), 5) AS similarity FROM u a JOIN u b ON a.label <= b.label""",
    "centroid_center_norm": f"""WITH {_N}, t AS (SELECT 0 AS label, v FROM e WHERE label < 8), {_MEANS.format(t="t")}, c AS (SELECT vec_id, m,
        list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS c FROM e, mean),
        u AS (SELECT vec_id, m, {_UNIT.format(v="c")} AS c FROM c) SELECT vec_id, round(list_dot_product(c, m), 6) AS to_mean, round(c[1], 6) AS first FROM u""",
    "retrieval_rank_at_k": f"""WITH t AS (SELECT function_id, any_value(CAST(sig_embedding AS DOUBLE[])) AS s,
        any_value(CAST(body_embedding AS DOUBLE[])) AS b FROM function_student_targets
        WHERE len(sig_embedding) = 64 AND len(body_embedding) = 64 AND len(list_filter(sig_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        AND len(list_filter(body_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 GROUP BY 1),
        u AS (SELECT function_id, {_UNIT.format(v="s")} AS s, {_UNIT.format(v="b")} AS b FROM t), m AS (SELECT x.function_id AS q, y.function_id AS n,
        round(list_dot_product(x.s, y.b), 12) AS s FROM u x, u y),
        own AS (SELECT q, s FROM m WHERE q = n), r AS (SELECT m.q, 1 + count(*) FILTER (WHERE m.s > own.s OR m.s = own.s AND m.n < m.q) AS rank FROM m
        JOIN own USING (q) GROUP BY 1)
        SELECT count(*) FILTER (WHERE rank <= 1) AS n_at_1, count(*) FILTER (WHERE rank <= 5) AS n_at_5, count(*) FILTER (WHERE rank <= 10) AS n_at_10,
        count(*) AS n FROM r""",
    "infonce_value": f"""WITH {_N}, {_MEANS.format(t="n")}, u AS (SELECT label AS anchor, {_UNIT.format(v="m")} AS m FROM mean), s AS (SELECT vec_id,
        label, anchor, list_dot_product(v, m) AS s FROM n, u),
        p AS (SELECT vec_id, label, -sum(s) FILTER (WHERE label = anchor) / 0.07 + ln(sum(exp(s / 0.07))) AS loss FROM s GROUP BY 1, 2) SELECT label,
        round(avg(loss), 5) AS loss, count(*) AS n FROM p GROUP BY 1""",
    "vector_hygiene": """WITH f AS (SELECT id, any_value(model_name) AS model_name, any_value(embedding) AS e FROM function_embeddings
        WHERE embedding IS NOT NULL GROUP BY 1)
        SELECT model_name, count(*) FILTER (WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)) AS n_finite, count(*) AS n,
        round(sum(coalesce(list_sum(list_transform(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x)), lambda x: CAST(x AS DOUBLE))), 0)),
        3) AS total FROM f GROUP BY 1""",
    "masked_mean_pool": """SELECT label, CAST(i - 1 AS INTEGER) AS place, round(sum(CASE WHEN f > 0 THEN x ELSE 0 END) / greatest(1,
        count(*) FILTER (WHERE f > 0)), 6) AS value
        FROM (SELECT label, embedding[1] AS f, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2""",
    "span_overlap": """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos
        FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, pos, length(w) AS n, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM w)
        SELECT doc_id, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM e WHERE e - 1 > 100 AND e - n - 1 < 200 GROUP BY 1""",
    "pair_band_filter": f"""SELECT query_model, CASE WHEN NOT cross_repo AND cosine_similarity >= 0.999 THEN 'copy' WHEN cross_repo
        AND s = 3 THEN 'gold' WHEN cross_repo AND s = 2 THEN 'strong' WHEN NOT cross_repo AND s >= 2 THEN 'variant' ELSE 'other' END AS tier,
        count(*) AS n
        FROM (SELECT *, CASE WHEN {_OK} THEN judge.score_c END AS s FROM knn_pairs) WHERE CASE WHEN cross_repo THEN cosine_similarity >= 0.8
        ELSE cosine_similarity >= 0.8 AND cosine_similarity < 0.999 END GROUP BY 1, 2""",
    "hard_negatives": _HARD,
    "hard_negative_histogram": f"SELECT least(n, 10) AS n_negatives, count(*) AS n_anchors FROM (SELECT query_id, count(*) AS n FROM ({_HARD}) GROUP BY 1) GROUP BY 1",
    "pair_stage_counts": f"""SELECT query_model, count(*) AS n_pairs, count(*) FILTER (WHERE {_OK}) AS n_judged, count(judge.skipped) AS n_skipped,
        count(*) FILTER (WHERE {_OK} AND judge.score_c >= 2) AS n_positive,
        count(*) FILTER (WHERE {_OK} AND cross_repo) AS n_cross FROM knn_pairs GROUP BY 1""",
    "score_histogram": f"""SELECT count(*) FILTER (WHERE s = 0) AS n_0, count(*) FILTER (WHERE s = 1) AS n_1, count(*) FILTER (WHERE s = 2) AS n_2,
        count(*) FILTER (WHERE s = 3) AS n_3, round(avg(s), 6) AS mean FROM (SELECT judge.score_c AS s FROM knn_pairs WHERE {_OK} AND cross_repo)""",
    "disconnect_flags": f"SELECT kind, count(*) AS n, round(avg(cosine_similarity), 6) AS mean_similarity FROM ({_DIS}) GROUP BY 1",
    "top_disconnects": f"""SELECT DISTINCT query_id, neighbour_id, round(cosine_similarity, 9) AS similarity FROM ({_DIS})
        ORDER BY similarity DESC NULLS LAST, query_id, neighbour_id LIMIT 10""",
    "judge_pairs_stub": """WITH p AS (SELECT DISTINCT query_id, neighbour_id FROM knn_pairs), t AS (SELECT function_id, min(body_text) AS t
        FROM function_student_targets GROUP BY 1),
        b AS (SELECT length(q.t) AS a, length(n.t) AS b FROM p JOIN t q ON q.function_id = query_id JOIN t n ON n.function_id = neighbour_id
        WHERE q.t IS NOT NULL AND n.t IS NOT NULL)
        SELECT CAST(CASE WHEN a = b THEN 3 WHEN abs(a - b) < 20 THEN 2 ELSE 0 END AS BIGINT) AS score, count(*) AS n FROM b GROUP BY 1""",
}
