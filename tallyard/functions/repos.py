"""Names of repositories (J1): spellings and the three shapes of an instance id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_name(c: Column | str) -> Column:
    """Lower-case ``owner/name``: letter case, surrounding blanks, trailing slashes and ``.git`` don't matter.

    Null, empty and blank give null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+", ""), r"(\.git|/|\s)+$", "")
    return F.when(bare != "", bare)


def repo_of_instance(c: Column | str) -> Column:
    """The repository that an instance id names.

    Shapes: ``owner/repo#N``; ``number__owner__repo`` (a first part of digits only); ``owner__repo__N``. Any other
    text with at least two parts gives the first two; a text of one part gives itself; null gives null.
    """
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, "__")
    n = F.size(parts)
    pair = (
        F.when(c.contains("#"), F.substring_index(c, "#", 1))
        .when((n >= 3) & parts[0].rlike(r"^\s*\d+$"), F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))
        .when(n >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
        .otherwise(c)
    )
    return repo_name(pair)
