"""Seams to models outside the engine: choices among candidates (M15) and inference (L24). Tests pass rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_choice(answer: str, names: list[str], field: str = "best_candidate") -> str | None:
    """The name that an answer chooses: ``field`` of the first JSON object in it, else its first word."""
    found = re.search(r"\{.*\}", answer, re.DOTALL)
    if found:
        try:
            chosen = str(json.loads(found.group()).get(field, "")).strip()
        except (ValueError, AttributeError):
            return None
    else:
        chosen = (answer.split() or [""])[0]
    return chosen if chosen in names else None


def choose(packs: DataFrame, pack: str, candidate: str, told: list[str], ask: Callable[[pd.DataFrame], str], retries: int = 2, default: str | None = None) -> DataFrame:
    """``pack, chosen, n_asked``: one candidate of each pack, chosen by ``ask``, which gets the pack's rows in order of
    candidate and gives an answer in words.

    An answer that names no candidate, or a failure, is asked again up to ``retries`` times; then ``default``, or without
    one the first candidate, stands. A pack is a handful of rows.
    """
    kinds = {c: packs.schema[c].dataType.simpleString() for c in (pack, candidate)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(candidate)
        names, chosen, n = [str(x) for x in rows[candidate]], None, 0
        while chosen is None and n <= retries:
            n += 1
            try:
                chosen = read_choice(ask(rows), names)
            except Exception:  # noqa: BLE001  an outside model may fail in any way
                chosen = None
        return pd.DataFrame({pack: rows[pack].iloc[:1], "chosen": [chosen or default or names[0]], "n_asked": [n]})

    return packs.select(pack, candidate, *told).groupBy(pack).applyInPandas(run, f"{pack} {kinds[pack]}, chosen string, n_asked int")


def infer(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """``key, vec``: vectors of texts by an outside model. ``load`` runs once in each task and gives a function from
    texts to rows of numbers. Null texts have a null vector; texts go in portions of ``batch``, longest together."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for p in parts:
            there = np.flatnonzero(p["__text"].notna())
            there = there[np.argsort([-len(x) for x in p["__text"].iloc[there]], kind="stable")]
            out: list = [None] * len(p)
            for i in range(0, len(there), batch):
                at = there[i : i + batch]
                for j, v in zip(at, model(list(p["__text"].iloc[at]))):
                    out[j] = [float(x) for x in v]
            yield pd.DataFrame({key: p[key], "vec": out})

    return df.select(key, F.col(text).alias("__text")).mapInPandas(run, f"{key} {kind}, vec array<double>")
