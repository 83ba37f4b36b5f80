"""Candidate packs: a change and variants of it, each worse in one way (K9), and the fields that a ranker sees."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_unit, shuffle_key


class Rule(NamedTuple):
    """New value of a field: times a factor, plus a shift, both drawn from a range, kept within bounds."""

    field: str
    factor: tuple[float, float] = (1.0, 1.0)
    shift: tuple[float, float] = (0.0, 0.0)
    low: float | None = None
    high: float | None = None


#: What every candidate gets, so that no kind is told by a field that stands still.
JITTER = [
    Rule("changed_files", shift=(-0.4, 0.4), low=1.0), Rule("additions", (0.94, 1.06), low=1.0), Rule("deletions", (0.94, 1.06), low=1.0),
    Rule("cross_module_ratio", shift=(-0.03, 0.03), low=0.0, high=1.0), Rule("naming_quality", shift=(-0.04, 0.04), low=0.0, high=1.0),
    Rule("ownership_friction", shift=(-0.03, 0.03), low=0.0, high=1.0), Rule("interface_stress", shift=(-0.1, 0.1), low=0.0, high=10.0),
    Rule("cochange_cross_ratio", shift=(-0.03, 0.03), low=0.0, high=1.0),
]
#: What makes each kind of variant worse.
KINDS = {
    "naming_drift": [Rule("naming_quality", (0.4, 0.75), low=0.05), Rule("risk_scope", shift=(0.05, 0.14))],
    "cross_cutting": [
        Rule("changed_files", (1.25, 1.7), (1.0, 3.5)), Rule("module_count", shift=(1.0, 2.5)), Rule("cross_module_ratio", shift=(0.12, 0.28), high=1.0),
        Rule("cochange_cross_ratio", shift=(0.09, 0.2), high=1.0), Rule("risk_scope", shift=(0.12, 0.28)),
    ],
    "scope_bloat": [
        Rule("additions", (1.45, 1.95), (30.0, 120.0)), Rule("deletions", (1.35, 1.85), (20.0, 100.0)), Rule("changed_files", (1.2, 1.55), (1.0, 3.5)),
        Rule("risk_scope", shift=(0.14, 0.32)),
    ],
    "arch_boundary": [
        Rule("cross_module_ratio", shift=(0.14, 0.3), high=1.0), Rule("interface_stress", shift=(0.35, 1.0), high=10.0),
        Rule("cochange_cross_ratio", shift=(0.1, 0.24), high=1.0), Rule("risk_scope", shift=(0.12, 0.26)),
    ],
    "ownership_friction": [
        Rule("ownership_friction", shift=(0.1, 0.28), high=1.0), Rule("distinct_authors", shift=(1.0, 3.5), high=30.0), Rule("n_reviewers", shift=(0.0, 2.0)),
        Rule("risk_scope", shift=(0.08, 0.24)),
    ],
}
#: Fields of a candidate; those of ``LOGS`` enter a ranker as ln(1 + x).
LOGS = ["changed_files", "additions", "deletions", "module_count", "n_reviewers", "n_threads", "n_comments", "distinct_authors"]
FIELDS = [*LOGS, "cross_module_ratio", "has_issue", "naming_quality", "ownership_friction", "interface_stress", "cochange_cross_ratio", "risk_scope"]


def _changed(value: Column, rule: Rule, key: Column, kind: str, seed: int) -> Column:
    def draw(span: tuple[float, float], what: str) -> Column:
        lo, hi = span
        return F.lit(lo) if lo == hi else lo + (hi - lo) * hash_unit(key, F.lit(kind), F.lit(rule.field), F.lit(what), seed=seed)

    out = value * draw(rule.factor, "x") + draw(rule.shift, "+")
    if rule.low is not None:
        out = F.greatest(F.lit(rule.low), out)
    return out if rule.high is None else F.least(F.lit(rule.high), out)


def candidate_packs(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``key, candidate, kind, label`` and the fields: six candidates of each row, the real one (label 1) and one of each
    kind. All fields count as numbers, null as 0. Draws come from hashes of key, kind and field, so a pack is the same in
    any run. Candidates are named by hashed order, so a name tells nothing."""
    k, rows = F.col(key), []
    for kind in ["real", *KINDS]:
        value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FIELDS}
        for i, rule in enumerate([*JITTER, *KINDS.get(kind, [])]):
            value[rule.field] = _changed(value[rule.field], rule, k, f"{kind}{i >= len(JITTER)}", seed)
        rows.append(F.struct(shuffle_key(k, F.lit(kind), F.lit("name"), seed=seed).alias("o"), F.lit(kind).alias("kind"), F.lit(int(kind == "real")).alias("label"), *[value[f].alias(f) for f in FIELDS]))
    placed = df.where(k.isNotNull()).select(key, F.posexplode(F.array_sort(F.array(*rows))).alias("at", "c"))
    name = F.concat(F.lit("cand_"), F.element_at(F.split(F.lit("A B C D E F"), " "), F.col("at") + 1))
    return placed.select(key, name.alias("candidate"), "c.kind", "c.label", *[f"c.{f}" for f in FIELDS])


def as_features(df: DataFrame) -> DataFrame:
    """The fields as a ranker sees them."""
    return df.withColumns({f: F.log1p(F.greatest(F.col(f), F.lit(0.0))) for f in LOGS})
