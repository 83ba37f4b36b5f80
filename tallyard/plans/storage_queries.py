"""Queries over what is written and read back, scans, and the seams to outside stores and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions.repos import repo_name
from ..operators import pairs, sampling, seams, vectors
from ..operators.ranking import first_per_group
from ..scratch import own_path
from ..sources import readers, sinks, vector_store
from ..streaming import incremental


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_MODELS = ["quill-coder-3b", "quill-coder-8b", "no-such-model"]


def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan with the filters that are given, of listed models, in order of id."""
    f = readers.table(spark, f"{d}/function_embeddings.parquet", [F.col("layer_index") == 18], ["id", "model_name", "feature_file"])
    return readers.in_list(f, "model_name", _MODELS).distinct().orderBy("id", "model_name", "feature_file")


def pr_code_scan(spark: SparkSession, d: str) -> DataFrame:
    """A5: pull requests of any repository that have a patch and some files, newest first."""
    p = _t(spark, d, "prs_copy").select("id", repo_name("repo").alias("repo"), "changed_files", "created_at", F.col("patch").isNotNull().alias("has_patch")).distinct()
    return readers.first_matching(p, F.col("has_patch") & F.col("changed_files").between(1, 30), []).select("id", "repo", "changed_files")


def first_functions_per_file(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 functions of each file."""
    f = _t(spark, d, "function_static_props").select("instance_id", "feature_file", "id").distinct()
    return first_per_group(f, ["instance_id", "feature_file"], [F.col("id")], 30)


def task_scan(spark: SparkSession, d: str) -> DataFrame:
    """100 pull requests in hashed order out of the 600 newest; the number is part of the operator."""
    p = _t(spark, d, "prs_copy").select("id", "created_at").distinct()
    return sampling.newest_shuffled(p, [F.desc_nulls_first("created_at"), F.col("id")], "id", 100, 42).select("id")


def round_robin_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents dealt out to seven workers."""
    return sampling.round_robin(_t(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 7)


_LINE = "query_id bigint, neighbour_id bigint, query_model string, cosine_similarity double, cross_repo boolean, score int, is_judged boolean, reason_len int"


def json_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Judged pairs as JSON lines without their bulky columns, appended in two portions; read back,
    all stage counters in one pass."""
    j = F.col("judge")
    p = _t(spark, d, "knn_pairs").select(
        "query_id", "neighbour_id", "query_model", "cosine_similarity", "cross_repo", j["score_c"].alias("score"), pairs.judged(j).alias("is_judged"), j["reasoning_c"].alias("reason")
    )
    path = own_path(spark, "pairs")
    for part in (F.coalesce("cross_repo", F.lit(False)), ~F.coalesce("cross_repo", F.lit(False))):
        sinks.write_json_lines(p.where(part), path, drop=["reason"], lengths=["reason"], mode="append", flush_rows=500)
    back = readers.json_lines(spark, path, _LINE)
    ok = F.col("is_judged")
    near = ok & (F.col("cosine_similarity") >= 0.5)
    return back.groupBy("query_model").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(ok).alias("n_judged"), F.count_if(near).alias("n_near"), F.count_if(near & F.col("score").between(0, 1)).alias("n_kept"),
        F.sum("reason_len").alias("reason_chars"),
    )


def first_judged_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 matching lines of a JSON-lines file, in a stated order; the number is part of the operator."""
    path = own_path(spark, "lines")
    j = F.col("judge")
    sinks.write_json_lines(_t(spark, d, "knn_pairs").select("query_id", "neighbour_id", j["score_c"].alias("score"), pairs.judged(j).alias("is_judged")).distinct(), path)
    back = readers.json_lines(spark, path, "query_id bigint, neighbour_id bigint, score int, is_judged boolean")
    by = [F.col(c) for c in ("query_id", "neighbour_id", "score")]
    return readers.first_matching(back, F.col("is_judged") & (F.col("score") >= 2), by, 50).select("query_id", "neighbour_id", "score")


def negatives_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor's hard negatives by score, as one nested object a line, written and read back."""
    found = pairs.hard_negatives(_t(spark, d, "knn_pairs"), _t(spark, d, "function_embeddings"), "id", 0.5, 1)
    path = own_path(spark, "negatives")
    pairs.nested(found, "query_id", "score", "neighbour_id").write.json(path)
    return readers.json_id_lines(spark, path).select("id", "bucket", "other")


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of one model and layer, written under the name of their filters and loaded."""
    place = own_path(spark, "vectors")
    one = first_per_group(_t(spark, d, "function_embeddings").where(F.size("embedding") == 64), ["id"], [F.col("model_name"), F.col("layer_index")])
    vector_store.write_vectors(one, place, "id", "embedding", "quill-coder-8b", 18)
    return vector_store.load_vectors(spark, place, "quill-coder-8b", 18).select("id", F.round(F.get("vec", F.lit(0)).cast("double"), 4).alias("first"))


def cached_scores(spark: SparkSession, d: str) -> DataFrame:
    """A13, B1, D-20: a table made once, kept in folders by label, and found again by its fingerprint and joined by key."""
    place, e = own_path(spark, "cache"), _t(spark, d, "embeddings")
    make = lambda: e.select("vec_id", F.round(vectors.dot(vectors.as_double("embedding"), vectors.as_double("embedding")), 4).alias("norm2"))
    readers.cached_table(spark, place, make, "norms")
    kept = readers.cached_table(spark, place, lambda: e.limit(0), "norms")  # is there: not made again
    folders = own_path(spark, "folders")
    sinks.write_partitioned(e.select("vec_id", "label"), folders, ["label"])
    back = spark.read.parquet(folders).where(F.col("label") < 5)
    return back.join(kept, "vec_id").select("vec_id", F.col("label").cast("int").alias("label"), "norm2")


def empty_or_example(spark: SparkSession, d: str) -> DataFrame:
    """Built-in rows in place of an empty table."""
    nothing = _t(spark, d, "repo_splits").where("repo is null")
    return readers.or_example(nothing, [("own/one", "train"), ("own/two", "val")], "repo string, split_name string")


def _listed(repo: str) -> list[str]:
    return [f"src/{repo.split('/')[-1]}.py", "README.md", "lib/util.py"]


def _fetched(repo: str, commit: str, path: str) -> bytes | None:
    return None if path.startswith("lib/") else f"# {repo} at {commit}: ".encode() + b"\xff"


def tree_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Python files of each repository and their text, by rules in place of the repositories."""
    files = readers.tree(_t(spark, d, "repo_splits"), "repo", _listed).withColumn("commit", F.lit("c0ffee"))
    return readers.blobs(files, "repo", "commit", "path", _fetched).select("repo", "path", "content")


def _largest(pack: pd.DataFrame) -> str:
    best = pack.sort_values(["score", "candidate"], ascending=[False, True])
    if pack["score"].max() < 2:
        return "none of them"
    return '{"best_candidate": "%s"}' % best["candidate"].iloc[0]


def candidate_choice(spark: SparkSession, d: str) -> DataFrame:
    """The choice among three candidates of each document by a rule in a model's place; where it names none, the default."""
    t = _t(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    packs = t.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f"cand_{c}").alias("candidate"), F.pmod(F.col("n"), F.lit(m)).cast("int").alias("score")) for c, m in (("A", 2), ("B", 3), ("C", 5))])).alias("c"))
    return seams.choose(packs.select("doc_id", "c.*"), "doc_id", "candidate", ["score"], _largest, retries=2, default="cand_A")


def _length_model():
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], float)


def inferred_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents, by a rule in a model's place."""
    v = seams.infer(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _length_model)
    return v.select("doc_id", F.get("vec", F.lit(0)).cast("bigint").alias("n_chars"), F.get("vec", F.lit(1)).cast("bigint").alias("n_blanks"))


def listed_repos(spark: SparkSession, d: str) -> DataFrame:
    """A list file written and read back, blank lines left out."""
    path = own_path(spark, "list")
    names = _t(spark, d, "repo_splits").select(F.explode(F.array(F.concat(F.lit(" "), "repo"), F.lit(""))).alias("value"))
    names.write.text(path)
    return readers.list_file(spark, path).distinct()


def streamed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """2.N, B2: the metrics as a stream of two deliveries, each upserted into the parts of a table that it touches."""
    keys = ["feature_instance_id", "feature_file", "feature_function"]
    m = _t(spark, d, "followup_org_metrics").select(*keys, "created_at", "ownership_friction").distinct()
    # of rows that arrive at once the one with the greater value comes last
    m = m.groupBy(*keys, "created_at").agg(F.max("ownership_friction").alias("ownership_friction"))
    source, target, state = own_path(spark, "stream"), own_path(spark, "streamed"), own_path(spark, "state")
    late = F.col("created_at") >= F.lit("2025-08-01").cast("timestamp")
    for part in (~late, late):
        m.where(part).write.mode("append").parquet(source)
        incremental.upsert_stream(spark.readStream.schema(m.schema).parquet(source), target, state, keys, "created_at").awaitTermination()
    return incremental.latest(spark, target).select(*keys, "ownership_friction")


def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """2.N: hourly counts of the events as a stream, in the same code as over a table."""
    source, target, state = own_path(spark, "events"), own_path(spark, "windows"), own_path(spark, "state")
    e = _t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.write.parquet(source)
    w = incremental.windowed_counts(spark.readStream.schema(e.schema).parquet(source), "ts", "event_type", "value")
    # one portion in update mode: each window comes once, as it stands at the end
    w.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(target)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def _pair_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``function_id, sig, body``: unit vectors of the functions that have both, once each."""
    t = _t(spark, d, "function_student_targets").select("function_id", vectors.as_double("sig_embedding").alias("sig"), vectors.as_double("body_embedding").alias("body"))
    ok = t.where((F.size("sig") == 64) & (F.size("body") == 64) & vectors.finite(F.col("sig")) & vectors.finite(F.col("body"))).dropDuplicates(["function_id"])
    return ok.select("function_id", vectors.normalise(F.col("sig")).alias("sig"), vectors.normalise(F.col("body")).alias("body"))


def random_pair_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of signatures with their own bodies, and of bodies with another function's by chance."""
    v = _pair_vectors(spark, d)
    p = sampling.random_partners(v, "function_id", 42).join(v, "function_id").join(v.select(F.col("function_id").alias("partner"), F.col("body").alias("other")), "partner")
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vectors.dot(F.col("sig"), F.col("body"))), 6).alias("own"), F.round(F.avg(vectors.dot(F.col("body"), F.col("other"))), 6).alias("chance"))


def infonce_negatives(spark: SparkSession, d: str) -> DataFrame:
    """I14, D-19: contrastive loss in batches of 32 functions in hashed order, with their hard negatives."""
    v = _pair_vectors(spark, d)
    placed = sampling.global_position(v.select("function_id"), [sampling.shuffle_key(F.col("function_id"), seed=42), F.col("function_id")])
    batches = placed.select("function_id", F.floor(F.col("position") / 32).alias("batch")).join(v, "function_id")
    hard = pairs.hard_negatives(_t(spark, d, "knn_pairs"), _t(spark, d, "function_embeddings"), "id", 0.5, 1)
    hard = hard.select(F.col("query_id").alias("function_id"), F.col("neighbour_id").alias("negative")).distinct()
    loss = vectors.contrast_with_negatives(batches, "batch", "function_id", "sig", "body", hard)
    return loss.select("function_id", F.round("loss", 6).alias("loss"))


def masked_token_loss(spark: SparkSession, d: str) -> DataFrame:
    """Smooth difference of signature and body vectors where the signature is positive."""
    v = _pair_vectors(spark, d)
    loss = vectors.masked_smooth_l1(F.col("sig"), F.col("body"), F.transform("sig", lambda x: x > 0))
    return v.select("function_id", F.round(loss, 6).alias("loss"))


_SOURCE = 'def {name}(a, b):\n    """Adds.\n\n    More."""\n    # sum\n    return a + b'


def source_views(spark: SparkSession, d: str) -> DataFrame:
    """Signature, stub, unnamed text and named part of a source made for each function."""
    f = _t(spark, d, "function_static_props").select(F.col("feature_function").alias("name")).where(F.col("name").rlike("^[a-z_]+$")).distinct()
    s = f.withColumn("source", F.concat(F.lit("def "), F.col("name"), F.lit(_SOURCE.partition("{name}")[2])))
    return s.select(
        "name", code.text_column("source", code.signature).alias("signature"), code.text_column("source", code.stub).alias("stub"), code.text_column("source", code.anonymous).alias("anonymous"),
        F.length(code.named_column(F.concat(F.lit("x = 1\n"), F.col("source")), "name")).alias("n_named"),
    )


def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """D-18: recorded names against qualified ones: by themselves, by their last part if only one has it, by their end."""
    f = _t(spark, d, "function_static_props").select(F.col("feature_function").alias("name")).where(F.col("name").rlike("^[a-z_]+$") & (F.col("name") != "main")).distinct()
    known = F.array(F.concat(F.lit("A."), "name"), F.concat(F.lit("B.C."), "name"), F.lit("main"))
    asked = F.explode(F.array(F.concat(F.lit("C."), "name"), F.col("name"), F.concat(F.lit("A."), "name"), F.lit("Q.main")))
    return f.select("name", asked.alias("asked"), known.alias("known")).select("name", "asked", code.resolved_column("asked", "known").alias("meant"))


def dedented(spark: SparkSession, d: str) -> DataFrame:
    """Bodies without their common indentation."""
    t = _t(spark, d, "function_student_targets").select("function_id", "body_text").where("body_text is not null").distinct()
    return t.select("function_id", code.text_column("body_text", code.dedent).alias("body")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        filtered_scan, pr_code_scan, first_functions_per_file, task_scan, round_robin_chunks, json_lines_roundtrip, first_judged_lines, negatives_by_bucket, stored_vectors, cached_scores,
        listed_repos, streamed_upsert, streamed_windows, empty_or_example, tree_blobs, candidate_choice, inferred_vectors, random_pair_baseline, infonce_negatives, masked_token_loss, source_views, resolved_names, dedented,
    )
}

_OK = "judge IS NOT NULL AND judge.error IS NULL AND judge.skipped IS NULL"
_HARD = f"""SELECT DISTINCT query_id, neighbour_id, judge.score_c AS score FROM knn_pairs
    WHERE {_OK} AND judge.score_c BETWEEN 0 AND 1 AND cosine_similarity >= 0.5
    AND query_id IN (SELECT id FROM function_embeddings) AND neighbour_id IN (SELECT id FROM function_embeddings)"""
_GOOD = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
_UNIT = "list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-9))"
_BOTH = f"""t AS (SELECT function_id, any_value(CAST(sig_embedding AS DOUBLE[])) AS s, any_value(CAST(body_embedding AS DOUBLE[])) AS b
        FROM function_student_targets WHERE {_GOOD.format(v="sig_embedding")} AND {_GOOD.format(v="body_embedding")} GROUP BY 1),
    u AS (SELECT function_id, {_UNIT.format(v="s")} AS s, {_UNIT.format(v="b")} AS b FROM t),
    o AS (SELECT function_id, row_number() OVER (ORDER BY md5(function_id || '|42'), function_id) - 1 AS p, count(*) OVER () AS n FROM u)"""
_NAMES = "n AS (SELECT DISTINCT feature_function AS name FROM function_static_props WHERE regexp_full_match(feature_function, '[a-z_]+'))"
SQL = {
    "filtered_scan": """SELECT DISTINCT id, model_name, feature_file FROM function_embeddings
        WHERE layer_index = 18 AND model_name IN ('quill-coder-3b', 'quill-coder-8b')""",
    "pr_code_scan": r"""SELECT id, repo, changed_files FROM (SELECT DISTINCT id, changed_files, created_at,
        nullif(regexp_replace(regexp_replace(lower(repo), '^\s+', ''), '(\.git|/|\s)+$', ''), '') AS repo
        FROM prs_copy WHERE patch IS NOT NULL AND changed_files BETWEEN 1 AND 30)""",
    "first_functions_per_file": """SELECT instance_id, feature_file, id FROM (SELECT DISTINCT instance_id, feature_file, id FROM function_static_props)
        QUALIFY row_number() OVER (PARTITION BY instance_id, feature_file ORDER BY id) <= 30""",
    "task_scan": """SELECT id FROM (SELECT DISTINCT id, created_at FROM prs_copy ORDER BY created_at DESC NULLS FIRST, id LIMIT 600)
        ORDER BY md5(id || '|42'), id LIMIT 100""",
    "round_robin_chunks": "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INTEGER) AS chunk FROM documents",
    "json_lines_roundtrip": f"""SELECT query_model, count(*) AS n_pairs, count(*) FILTER (WHERE {_OK}) AS n_judged,
        count(*) FILTER (WHERE {_OK} AND cosine_similarity >= 0.5) AS n_near,
        count(*) FILTER (WHERE {_OK} AND cosine_similarity >= 0.5 AND judge.score_c BETWEEN 0 AND 1) AS n_kept,
        CAST(sum(length(judge.reasoning_c)) AS BIGINT) AS reason_chars FROM knn_pairs GROUP BY 1""",
    "first_judged_lines": f"""SELECT DISTINCT query_id, neighbour_id, judge.score_c AS score FROM knn_pairs
        WHERE {_OK} AND judge.score_c >= 2 ORDER BY 1, 2, 3 LIMIT 50""",
    "negatives_by_bucket": f"SELECT query_id AS id, CAST(score AS VARCHAR) AS bucket, neighbour_id AS other FROM ({_HARD})",
    "stored_vectors": f"""WITH e AS (SELECT DISTINCT ON (id) id, model_name, layer_index, CAST(embedding AS DOUBLE[]) AS v FROM function_embeddings
        WHERE len(embedding) = 64 ORDER BY id, model_name, layer_index)
        SELECT id, round(({_UNIT.format(v="v")})[1], 4) AS first FROM e WHERE model_name = 'quill-coder-8b' AND layer_index = 18 AND {_GOOD.format(v="v")}""",
    "cached_scores": """SELECT vec_id, CAST(label AS INTEGER) AS label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm2
        FROM embeddings WHERE label < 5""",
    "listed_repos": "SELECT DISTINCT repo AS item FROM repo_splits WHERE repo IS NOT NULL",
    "streamed_upsert": """SELECT DISTINCT ON (feature_instance_id, feature_file, feature_function) feature_instance_id, feature_file, feature_function, ownership_friction
        FROM followup_org_metrics ORDER BY feature_instance_id, feature_file, feature_function, created_at DESC, ownership_friction DESC NULLS LAST""",
    "streamed_windows": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "empty_or_example": "SELECT * FROM (VALUES ('own/one', 'train'), ('own/two', 'val')) AS t(repo, split_name)",
    "tree_blobs": """SELECT DISTINCT repo, path, CASE WHEN path LIKE 'src/%' THEN '# ' || repo || ' at c0ffee: ' || chr(65533) END AS content
        FROM (SELECT repo, unnest(['src/' || string_split(repo, '/')[-1] || '.py', 'lib/util.py']) AS path FROM repo_splits WHERE repo IS NOT NULL)""",
    "candidate_choice": """WITH s AS (SELECT doc_id, coalesce(n_chars, 0) % 2 AS a, coalesce(n_chars, 0) % 3 AS b, coalesce(n_chars, 0) % 5 AS c FROM documents)
        SELECT doc_id, CASE WHEN greatest(a, b, c) < 2 OR a = greatest(a, b, c) THEN 'cand_A' WHEN b = greatest(a, b, c) THEN 'cand_B' ELSE 'cand_C' END AS chosen,
        CASE WHEN greatest(a, b, c) < 2 THEN 3 ELSE 1 END AS n_asked FROM s""",
    "inferred_vectors": """SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) - length(replace(text, ' ',
        '')) AS BIGINT) AS n_blanks FROM documents""",
    "random_pair_baseline": f"""WITH {_BOTH} SELECT count(*) AS n, round(avg(list_dot_product(u.s, u.b)), 6) AS own, round(avg(list_dot_product(u.b, w.b)), 6) AS chance
        FROM o JOIN u USING (function_id) JOIN o q ON q.p = (o.p + 1) % o.n JOIN u w ON w.function_id = q.function_id""",
    "infonce_negatives": f"""WITH {_BOTH}, h AS ({_HARD}), m AS (SELECT function_id AS id, p // 32 AS batch FROM o),
        x AS (SELECT DISTINCT a.batch, h.neighbour_id AS other FROM h JOIN m a ON a.id = h.query_id JOIN m b ON b.id = h.neighbour_id WHERE a.batch <> b.batch),
        c AS (SELECT batch, id AS other FROM m UNION ALL SELECT batch, other FROM x),
        s AS (SELECT m.id, m.id = c.other AS own, list_dot_product(u.s, w.b) AS s FROM m JOIN c USING (batch) JOIN u ON u.function_id = m.id
        JOIN u w ON w.function_id = c.other)
        SELECT id AS function_id, round(-sum(s) FILTER (WHERE own) / 0.07 + ln(sum(exp(s / 0.07))), 6) AS loss FROM s GROUP BY 1""",
    "masked_token_loss": f"""WITH {_BOTH}, z AS (SELECT function_id, list_filter(list_zip(s, b), lambda p: p[1] > 0) AS z FROM u)
        SELECT function_id, round(coalesce(list_sum(list_transform(z, lambda p: CASE WHEN abs(p[1] - p[2]) < 1 THEN 0.5 * (p[1] - p[2]) ** 2
        ELSE abs(p[1] - p[2]) - 0.5 END)), 0)
            / greatest(1, len(z)), 6) AS loss FROM z""",
    "source_views": f"""WITH {_NAMES} SELECT name, 'def ' || name || '(a, b):' || chr(10) || '    \"\"\"Adds.' || chr(10) || chr(10) || '    More.\"\"\"' AS signature,
        'def ' || name || '(a, b):' || chr(10) || '    \"\"\"Adds.\"\"\"' || chr(10) || '    ...' AS stub,
        'def func_ANON(a, b):' || chr(10) || '    return a + b' AS anonymous, CAST({len(_SOURCE.format(name=''))} + length(name) AS INTEGER) AS n_named FROM n""",
    "resolved_names": f"""WITH {_NAMES} SELECT name, unnest(['C.' || name, name, 'A.' || name, 'Q.main']) AS asked,
        unnest(['B.C.' || name, NULL, 'A.' || name, 'main']) AS meant FROM n WHERE name <> 'main'""",
    "dedented": r"""WITH t AS (SELECT DISTINCT function_id, body_text FROM function_student_targets WHERE body_text IS NOT NULL),
        l AS (SELECT function_id, body_text, list_transform(string_split(body_text, chr(10)), lambda x: CASE WHEN trim(x, ' ' || chr(9)) = '' THEN ''
        ELSE x END) AS l FROM t),
        m AS (SELECT *, coalesce(list_min(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(x) - length(ltrim(x, ' ' || chr(9))))), 0) AS m FROM l)
        SELECT DISTINCT function_id, array_to_string(list_transform(l, lambda x: substr(x, m + 1)), chr(10)) AS body FROM m""",
}
