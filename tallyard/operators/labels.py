"""Labels and counts of anchors (E1 to E7, C9, D-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchor_labels(events: DataFrame, keys: list[str], category: str, item: str, overlap: str, wanted: list[str]) -> DataFrame:
    """One row for each anchor: for each wanted category ``has_<c>`` (0/1), ``n_<c>`` different items and
    ``max_<c>_overlap`` (0.0 if there is none). One aggregation for all; other categories give zeros."""
    aggs = []
    for c in wanted:
        hit = F.col(category) == c
        aggs += [
            F.max(F.when(hit, 1).otherwise(0)).alias(f"has_{c}"),
            F.count_distinct(F.when(hit, F.col(item))).alias(f"n_{c}"),
            F.coalesce(F.max(F.when(hit, F.col(overlap))), F.lit(0.0)).alias(f"max_{c}_overlap"),
        ]
    return events.groupBy(*keys).agg(*aggs)


def relabel(flag: Column, count: Column, strength: Column, least: float) -> tuple[Column, Column]:
    """Flag and count set to 0 where the flag is set but its strength is under ``least``; the row stays."""
    weak = (flag == 1) & (F.coalesce(strength, F.lit(0.0)) < least)
    return F.when(weak, 0).otherwise(flag), F.when(weak, 0).otherwise(count)


def churn(df: DataFrame, keys: list[str], change: str) -> DataFrame:
    """Different changes of each key (E5) and its rows."""
    return df.groupBy(*keys).agg(F.count_distinct(change).alias("churn"), F.count(F.lit(1)).alias("n_rows"))
