"""Judged pairs of functions (C7, C8, C19, D-17, E20 to E23, M14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(cross: Column, similarity: Column, least: float, copy: float = 0.999) -> Column:
    """Pairs worth judging: similar enough, and within a repository not a copy."""
    return F.when(cross, similarity >= least).otherwise((similarity >= least) & (similarity < copy))


def judged(judge: Column) -> Column:
    """A verdict is there, neither failed nor skipped."""
    return judge.isNotNull() & judge["error"].isNull() & judge["skipped"].isNull()


def hard_negatives(pairs: DataFrame, corpus: DataFrame, key: str, least: float, worst: int) -> DataFrame:
    """``query_id, neighbour_id, score`` of similar pairs judged different, both in the corpus (C8, D-19)."""
    ids = corpus.select(F.col(key).alias("__id")).distinct()
    hit = pairs.where(judged(F.col("judge")) & F.col("judge.score_c").between(0, worst) & (F.col("cosine_similarity") >= least))
    for side in ("query_id", "neighbour_id"):
        hit = hit.join(ids, F.col(side) == F.col("__id"), "left_semi")
    return hit.select("query_id", "neighbour_id", F.col("judge.score_c").alias("score")).distinct()


def nested(found: DataFrame, anchor: str, bucket: str, other: str) -> DataFrame:
    """``id, buckets``: each anchor's others as a map from bucket to sorted ids."""
    lists = found.groupBy(anchor, bucket).agg(F.array_sort(F.collect_set(other)).alias("ids"))
    entry = F.struct(F.col(bucket).cast("string").alias("k"), F.col("ids").alias("v"))
    return lists.groupBy(F.col(anchor).alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("buckets"))


def with_sources(pairs: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """Both sides' text joined on, and ``skipped = no_source`` where one is missing (D-17)."""
    one = sources.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("__t"))
    q = one.select(F.col(key).alias("query_id"), F.col("__t").alias("query_text"))
    n = one.select(F.col(key).alias("neighbour_id"), F.col("__t").alias("neighbour_text"))
    both = pairs.join(q, "query_id", "left").join(n, "neighbour_id", "left")
    return both.withColumn("skipped_now", F.when(F.col("query_text").isNull() | F.col("neighbour_text").isNull(), "no_source"))


def judge_pairs(pairs: DataFrame, judge: Callable[[str, str], tuple[int, int, int]]) -> DataFrame:
    """Scores of an outside judge for each pair with both texts (M14): a seam, tests pass a rule.

    ``judge`` gets two texts and gives three scores from 0 to 3; if it raises, the pair gets the message as ``error``
    and the others go on.
    """
    schema = "query_id bigint, neighbour_id bigint, score_a int, score_b int, score_c int, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for q, n, a, b in zip(p.query_id, p.neighbour_id, p.query_text, p.neighbour_text):
                try:
                    rows.append((q, n, *map(int, judge(a, b)), None))
                except Exception as e:
                    rows.append((q, n, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["query_id", "neighbour_id", "score_a", "score_b", "score_c", "error"]).astype({c: "Int32" for c in ("score_a", "score_b", "score_c")})

    return pairs.where("skipped_now is null").select("query_id", "neighbour_id", "query_text", "neighbour_text").mapInPandas(run, schema)
