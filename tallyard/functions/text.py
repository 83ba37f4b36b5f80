"""Text and JSON functions (J2 to J11, J17, J18, J26). All are column expressions; null gives what each docstring says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words of review language that ask for a change of structure.
REFACTOR = r"(?i)\b(refactor|restructure|split\s+this|extract\s+\w+|too\s+large|too\s+big|naming|cleanup|architecture|design)\b"
#: Binary units of a human-readable size.
UNITS = ("B", "K", "M", "G", "T", "P")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_module(path: Column | str) -> Column:
    """First part of a path without outer slashes; ``__root__`` for null, empty or only slashes."""
    first = F.substring_index(F.regexp_replace(F.coalesce(_col(path), F.lit("")), r"^/+|/+$", ""), "/", 1)
    return F.when(first == "", "__root__").otherwise(first)


def base_name(path: Column | str) -> Column:
    """What follows the last slash; null stays null."""
    return F.substring_index(_col(path), "/", -1)


#: The lines of a unified diff that name a file, and the Python files among them.
DIFF_LINE, NEW_PATH, OLD_PATH = r"(?m)^(?:diff --git a/(?:.+?) b/.+|\+\+\+ b/.+)$", r"^\+\+\+ b/(.+)$", r"^diff --git a/(.+?) b/.+$"
PYTHON_FILE = r"\.pyx?$"


def diff_paths(patch: Column | str) -> Column:
    """Python files that a unified diff names, each once in order of appearance.

    A ``diff --git`` line gives the old path, ``+++ b/`` the new one, so a rename lists both. Null gives an empty array.
    """
    text = F.coalesce(_col(patch), F.lit(""))
    both = F.regexp_extract_all(text, F.lit(DIFF_LINE), F.lit(0))
    paths = F.transform(both, lambda x: F.when(x.startswith("+++"), F.regexp_extract(x, NEW_PATH, 1)).otherwise(F.regexp_extract(x, OLD_PATH, 1)))
    return F.array_distinct(F.filter(paths, lambda p: p.rlike(PYTHON_FILE)))


#: An identifier, and one that says nothing.
IDENTIFIER, BARE_IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*", "^[a-z][0-9]*$"


def name_quality(title: Column | str) -> Column:
    """Share of identifiers with three letters or more that aren't a letter with digits; 0.5 without any."""
    words = F.regexp_extract_all(F.coalesce(_col(title), F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    good = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(BARE_IDENTIFIER))
    return F.when(F.size(words) == 0, 0.5).otherwise(F.size(good) / F.size(words))


def json_items(text: Column | str) -> Column:
    """Items of a JSON list as text, strings without their quotes; anything else, malformed or null gives an empty
    array (J8)."""
    items = F.from_json(_col(text), ArrayType(StringType()), {"mode": "PERMISSIVE"})
    return F.when(F.json_array_length(_col(text)).isNotNull(), F.coalesce(items, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def json_length(text: Column | str) -> Column:
    """Length of a JSON list; 0 for anything else."""
    return F.coalesce(F.json_array_length(_col(text)), F.lit(0))


def first_json_object(text: Column | str) -> Column:
    """From the first brace to the last one in free text; null if there are none."""
    hit = F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)
    return F.when(hit != "", hit)


def patch_files(text: Column | str) -> Column:
    """Paths of a list of strings, of objects with ``file_path``, ``path``, ``file`` or ``filename``, or of both; each
    once, in order; malformed or null gives an empty array (J11)."""

    def path(x: Column) -> Column:
        keys = [F.get_json_object(x, f"$.{k}") for k in ("file_path", "path", "file", "filename")]
        return F.when(F.ltrim(x).startswith("{"), F.coalesce(*[F.when(k != "", k) for k in keys])).otherwise(x)

    return F.array_distinct(F.filter(F.transform(json_items(text), path), lambda p: p.isNotNull() & (p != "")))


def comment_bodies(text: Column | str) -> Column:
    """Bodies of a JSON list of comment objects; a comment without one gives an empty text, other items none."""
    objects = F.filter(json_items(text), lambda c: F.ltrim(c).startswith("{"))
    return F.transform(objects, lambda c: F.coalesce(F.get_json_object(c, "$.body"), F.lit("")))


def thread_bodies(text: Column | str) -> Column:
    """For each review thread the bodies of its comments; the inner list may itself be JSON text."""
    objects = F.filter(json_items(text), lambda t: F.ltrim(t).startswith("{"))
    return F.transform(objects, lambda t: comment_bodies(F.get_json_object(t, "$.comments")))


def mentions(bodies: Column, pattern: str = REFACTOR) -> Column:
    return F.size(F.filter(bodies, lambda b: b.rlike(pattern)))


def human_size(text: Column | str) -> Column:
    """Bytes of ``1.5GB``, ``12k`` or ``300`` in binary units; null for anything else."""
    t = F.upper(F.trim(_col(text)))
    n = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([BKMGTP]?)(?:I?B)?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([BKMGTP]?)(?:I?B)?$", 2)
    power = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(u) for u in UNITS]), unit), F.lit(0)), F.lit(1)) - 1
    return F.when(n != "", F.floor(n.cast("double") * F.pow(F.lit(1024.0), power)).cast("bigint"))


def line_count(text: Column | str) -> Column:
    """Lines as split at line ends; empty and null give 0, a last line end opens no line."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?:\r\n|\r|\n)\z", "")
    whole = F.coalesce(_col(text), F.lit(""))
    return F.when(whole == "", 0).otherwise(F.size(F.split(t, r"\r\n|\r|\n")))


def api_base(base: Column | str) -> Column:
    """An API address that ends in ``/v1``."""
    b = F.regexp_replace(_col(base), "/+$", "")
    return F.when(b.endswith("/v1"), b).otherwise(F.concat(b, F.lit("/v1")))


def stripped_length(text: Column | str) -> Column:
    """Length without outer white space of any kind."""
    return F.length(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)^\s+|\s+$", ""))
