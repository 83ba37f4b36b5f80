"""Small numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    """A number or 0."""
    return F.coalesce(c.cast("bigint"), F.lit(0))


def log_scale(c: Column) -> Column:
    """ln(1 + x) of a count; null and negative count as 0."""
    return F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)))


def risk_scope(n_files: Column) -> Column:
    """min(1, ln(1 + files) / ln 40)."""
    return F.least(F.lit(1.0), F.log1p(n_files.cast("double")) / F.lit(math.log(40.0)))


def disconnect(a: Column, b: Column) -> Column:
    """Scores two apart: ``name_misleads`` if the body scores higher, else ``name_overclaims``; else null."""
    return F.when(F.abs(a - b) >= 2, F.when(b > a, "name_misleads").otherwise("name_overclaims"))


def sigmoid(x: Column, clip: float = 20.0) -> Column:
    """J22."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def from_log(x: Column) -> Column:
    """exp(max(x, 0)) - 1, the way back from a log target."""
    return F.expm1(F.greatest(x, F.lit(0.0)))


def per_thousand(value: Column, cost: Column) -> Column:
    """Value per thousand units of cost; null where the cost is 0."""
    return F.when(cost != 0, value / cost * 1000)


def warm_cosine(epoch: Column, warm_up: int, total: int, least: float) -> Column:
    """Learning-rate factor: linear up to ``warm_up``, then half a cosine down to ``least``."""
    e = epoch.cast("double")
    part = F.least(F.lit(1.0), (e - warm_up) / max(1, total - warm_up))
    return F.when(e < warm_up, (e + 1) / max(1, warm_up)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * part)))


def pair_tier(cross: Column, similarity: Column, score: Column) -> Column:
    """Kind of a judged pair."""
    return (
        F.when(~cross & (similarity >= 0.999), "copy")
        .when(cross & (score == 3), "gold")
        .when(cross & (score == 2), "strong")
        .when(~cross & (score >= 2), "variant")
        .otherwise("other")
    )
