"""Python source as data (M1 to M13, D-18): properties and places of functions, signature and body.

Syntax trees never leave the worker: each function takes text and gives plain values, and the Spark surfaces below send
Arrow batches through them.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of callees that count as side effects, grouped by what they do.
SIDE_EFFECTS = {
    # files
    "open", "print", "write", "read", "readline", "readlines", "flush", "close", "seek", "truncate",
    # processes
    "system", "popen", "run", "call", "check_call", "check_output", "Popen", "exec", "execv", "execve", "execvp", "fork", "spawn",
    # sockets and requests
    "send", "sendall", "recv", "recvfrom", "connect", "bind", "listen", "accept", "get", "post", "put", "delete", "patch", "request",
    # logs and messages
    "log", "debug", "info", "warning", "error", "critical", "exception", "emit", "publish", "push",
    # databases
    "execute", "executemany", "commit", "rollback", "insert", "update",
}
#: Names of primitive types, and of their values.
PRIMITIVE = {"int", "float", "str", "bool", "bytes", "complex", "NoneType", "None", "True", "False"}
#: Names of collection types.
COLLECTION = {
    "list", "dict", "set", "tuple", "frozenset", "List", "Dict", "Set", "Tuple", "FrozenSet", "Sequence", "Mapping", "Iterable",
    "Iterator", "Generator", "deque", "OrderedDict", "defaultdict",
}

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_DISPLAY = (ast.List, ast.Dict, ast.Set, ast.Tuple)
#: What a node adds to (complexity, branches, loops). Asynchronous loops and with-blocks add nothing.
_ONE = {
    ast.For: (1, 0, 1), ast.While: (1, 0, 1), ast.With: (1, 0, 0), ast.Assert: (1, 0, 0), ast.IfExp: (1, 0, 0), ast.ExceptHandler: (1, 1, 0),
}


def _adds(n: ast.AST) -> tuple[int, int, int]:
    if (fixed := _ONE.get(type(n))) is not None:
        return fixed
    match n:
        case ast.If(orelse=rest):
            return 1, 1 + bool(rest), 0
        case ast.BoolOp(values=v):
            return len(v) - 1, 0, 0
        case ast.ListComp(generators=g) | ast.SetComp(generators=g) | ast.DictComp(generators=g) | ast.GeneratorExp(generators=g):
            return len(g), 0, 1
        case ast.Match(cases=c):
            return len(c), len(c), 0
    return 0, 0, 0


def _has_doc(body: list[ast.stmt]) -> bool:
    match body:
        case [ast.Expr(value=ast.Constant(value=str())), *_]:
            return True
    return False


def _kind_of_name(name: str) -> str | None:
    return "none" if name in ("None", "NoneType") else "primitive" if name in PRIMITIVE else "collection" if name in COLLECTION else None


def _return_kind(f: ast.AST) -> str:
    """Category of the return type: from a plain annotation, else from the first return met; a subscripted or other
    complex annotation says nothing."""
    match f.returns:
        case ast.Constant(value=None) if f.returns is not None:
            return "none"
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return _kind_of_name(name) or "custom"
    for n in ast.walk(f):
        match n:
            case ast.Return(value=None) | ast.Return(value=ast.Constant(value=None)):
                return "none"
            case ast.Return(value=ast.Constant(value=v)) if v is not ...:
                return "primitive"
            case ast.Return(value=v) if isinstance(v, _DISPLAY):
                return "collection"
            case ast.Return(value=ast.Name(id=name)):
                return "primitive" if name in PRIMITIVE else "collection" if name in COLLECTION else "custom"
            case ast.Return():
                return "custom"
    return "none"


def properties(f: ast.AST) -> dict:
    """The properties of one function, nested functions included (M2 to M6)."""
    total = [1, 0, 0]
    returns = calls = 0
    effects = False
    for n in ast.walk(f):
        for i, x in enumerate(_adds(n)):
            total[i] += x
        if isinstance(n, ast.Return):
            returns += 1
        elif isinstance(n, ast.Call):
            attribute = isinstance(n.func, ast.Attribute)
            calls += attribute
            effects |= (n.func.attr if attribute else getattr(n.func, "id", None)) in SIDE_EFFECTS
    a = f.args
    named = [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]
    return {
        "loc": f.end_lineno - f.lineno + 1, "cyclomatic_complexity": total[0], "n_branches": total[1], "n_loops": total[2], "n_returns": returns, "return_type_cat": _return_kind(f),
        "has_side_effects": effects, "n_api_calls": calls, "n_args": sum(x.arg not in ("self", "cls") for x in named), "has_decorators": bool(f.decorator_list), "has_docstring": _has_doc(f.body),
    }


def _parse(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def functions_of(source: str | None) -> list[dict]:
    """Every function in breadth-first order with name, body span in characters, and properties.

    Source that can't be parsed gives none. ``is_last``: the last of its name, the one that counts in a map by name.
    """
    tree = _parse(source)
    if tree is None:
        return []
    starts = [0]
    for line in (source or "").splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    qualified = {id(n): q for q, n in qualified_functions(tree)}
    rows = []
    for n in ast.walk(tree):
        if isinstance(n, _FUNCTION):
            rows.append({"name": n.name, "qualified_name": qualified.get(id(n)), "start_char": starts[n.body[0].lineno - 1], "end_char": starts[min(n.end_lineno, len(starts) - 1)], **properties(n)})
    last = {r["name"]: i for i, r in enumerate(rows)}
    for i, r in enumerate(rows):
        r["is_last"] = last[r["name"]] == i
    return rows


def qualified_functions(tree: ast.Module) -> Iterator[tuple[str, ast.AST]]:
    """Functions of the module and, through any depth, of its classes; functions inside functions are left out."""
    stack = [("", tree.body)]
    while stack:
        prefix, body = stack.pop()
        for n in body:
            if isinstance(n, _FUNCTION):
                yield prefix + n.name, n
            elif isinstance(n, ast.ClassDef):
                stack.append((f"{prefix}{n.name}.", n.body))


def resolve(name: str, known: list[str]) -> str | None:
    """The qualified name that a recorded name means (D-18): itself; else the only one with its last part; else the
    first that ends with it."""
    if name in known:
        return name
    same = [k for k in known if k.rpartition(".")[2] == name.rpartition(".")[2]]
    if len(same) == 1:
        return same[0]
    return next((k for k in same if k.endswith(name)), None) if "." in name else None


class Layout(NamedTuple):
    """Where the parts of a text's outermost, first function lie, as offsets into ``text``, which has plain line ends and
    no common indentation. ``name``: of its definition; ``line``: the line that has the name; ``code``: from the line
    after the docstring, or of the first statement if there is none; ``first`` to ``end``: from the line of the first
    statement that is no docstring to the end of the function; nothing if a docstring is all there is."""

    text: str
    name: tuple[int, int]
    line: tuple[int, int]
    doc: str
    code: int
    first: int
    end: int

    @classmethod
    def of(cls, source: str | None) -> Layout | None:
        text = "\n".join(textwrap.dedent(source or "").splitlines())
        f = _find(_parse(text), lambda n: True)
        if f is None:
            return None
        starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]  # of each line, and one behind the last
        top = starts[f.lineno - 1]
        name = re.compile(r"def\s+").search(text, top).end()
        told, end = _has_doc(f.body), starts[f.end_lineno] - 1
        after = f.body[0].end_lineno if told else f.body[0].lineno - 1
        first = starts[f.body[told].lineno - 1] if len(f.body) > told else end
        return cls(text, (name, name + len(f.name)), (top, starts[f.lineno] - 1), told and ast.get_docstring(f) or "", starts[after], first, end)


def _find(tree: ast.Module | None, wanted: Callable[[ast.AST], bool]) -> ast.AST | None:
    """The first function, level by level, that is wanted."""
    return next((n for n in ast.walk(tree) if isinstance(n, _FUNCTION) and wanted(n)), None) if tree else None


def split_source(source: str | None, least_sig: int = 0, least_body: int = 5) -> tuple[str, str] | None:
    """Signature with docstring, and body, of the first function (M7): the text before and after the place where its code
    begins. None without a function, or if a part has fewer characters than asked, blanks at its ends not counted.
    ``least_sig`` of 5 is the stricter variant, which leaves out functions of one line."""
    if (at := Layout.of(source)) is None:
        return None
    parts = at.text[: at.code].removesuffix("\n"), at.text[at.code :]
    return parts if all(len(p.strip()) >= n for p, n in zip(parts, (least_sig, least_body))) else None


#: Lines that may stand before a body: blank, a definition, comment, decorator or docstring; and one line more.
_HEAD = re.compile(r"""(?:[^\S\n]*(?:(?:async[ ])?def[ ].*|[#@].*|(?:\"{3}|'{3}).*)?\n)*.*""")


def signature(source: str | None, least: int = 5) -> str | None:
    """Signature with docstring (M8). Of source that can't be parsed, the lines that may stand before a body and the one
    behind them; None of source without a function, or if there is too little."""
    if (at := Layout.of(source)) is not None:
        sig = at.text[: at.code].strip()
        return sig if len(sig) >= least else None
    text = textwrap.dedent(source or "")
    return None if _parse(text) else _HEAD.match("\n".join(text.splitlines())).group().strip() or None


def stub(source: str, longest_doc: int = 120) -> str:
    """What a function's name tells, for scoring by name (M10): its definition line, the first line of its docstring, and dots for
    the code. Without a function, the source's first line stands for the definition."""
    if (at := Layout.of(source)) is None:
        return f"{source.partition(chr(10))[0]}\n    ..."
    told = at.doc.partition("\n")[0].strip()[:longest_doc]
    return "\n    ".join([at.text[slice(*at.line)], *([f'"""{told}"""'] if told else []), "..."])


def anonymous(source: str, name: str = "func_ANON") -> str:
    """What a function's code tells, for scoring by body (M10): another name and no docstring. Without a function, every
    definition in the text is renamed."""
    if (at := Layout.of(source)) is None:
        return re.sub(r"\bdef \w+", f"def {name}", source)
    (a, b), (top, line_end) = at.name, at.line
    head = at.text[top:a] + name + at.text[b:line_end]
    return f"{head}\n{at.text[at.first : at.end] or '    pass'}"


def named_function(source: str | None, name: str) -> str | None:
    """Source of the first function of a name (M9); the map of M1 takes the last."""
    f = _find(_parse(source), lambda n: n.name == name)
    return "\n".join(source.splitlines()[f.lineno - 1 : f.end_lineno]) if f else None


# -------------------------------------------------------------- Spark surfaces

_PROPERTIES = (
    "name string, qualified_name string, start_char int, end_char int, loc int, cyclomatic_complexity int, n_branches int, n_loops int, n_returns int, return_type_cat string, "
    "has_side_effects boolean, n_api_calls int, n_args int, has_decorators boolean, has_docstring boolean, is_last boolean"
)


def code_functions(df: DataFrame, key: str, source: str) -> DataFrame:
    """One row for each function of each source: the key and the columns of ``functions_of``."""
    names = [c.split()[0] for c in _PROPERTIES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, *[r[n] for n in names]) for k, s in zip(p[key], p["__source"]) for r in functions_of(s)]
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(source).alias("__source")).mapInPandas(run, f"{key} {kind}, {_PROPERTIES}")


def split_column(source: Column | str) -> Column:
    """``struct<sig, body>`` of each source, null where it has no two parts (M7)."""

    @F.pandas_udf("sig string, body string")
    def split(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_source(x) or (None, None) for x in s], columns=["sig", "body"], dtype=object)

    return split(source)


def dedent(source: str) -> str:
    """A text without the indentation that all its lines have in common."""
    return textwrap.dedent(source)


def text_column(source: Column | str, make: Callable[[str], str | None]) -> Column:
    """``make`` of each source that is there: ``signature``, ``stub``, ``anonymous``."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else make(x) for x in s], dtype=object)

    return run(source)


def named_column(source: Column | str, name: Column | str) -> Column:
    """Source of the function of that name in each source (M9)."""

    @F.pandas_udf("string")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else named_function(x, y) for x, y in zip(s, n)], dtype=object)

    return run(source, name)


def resolved_column(name: Column | str, known: Column | str) -> Column:
    """The qualified name among ``known`` (an array) that a recorded name means (D-18)."""

    @F.pandas_udf("string")
    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else resolve(x, list(y)) for x, y in zip(s, k)], dtype=object)

    return run(name, known)
