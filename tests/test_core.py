import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyard.functions import code, scores, text
from tallyard.functions.repos import repo_name, repo_of_instance
from tallyard.operators import heads, labels, ml, org, packs, ranking, sampling, seams, vectors
from tallyard.operators.skew import join_unique, skewed_group_metrics
from tallyard.scratch import Stored
from tallyard.sources import readers, sinks, vector_store
from tallyard.streaming import incremental


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_repo_names(spark):
    rows = [("Own/Name ",), ("own/name.git",), (" own/name/",), ("own/name.git/",), ("",), ("  ",), (None,)]
    assert one(spark, repo_name("c"), "c string", rows) == ["own/name"] * 4 + [None] * 3
    ids = [("A__b__1",), ("123__A__b",), ("a/B#4",), ("plain",), ("a__b",), (None,), ("1__2",)]
    assert one(spark, repo_of_instance("c"), "c string", ids) == ["a/b", "a/b", "a/b", "plain", "a/b", None, "1/2"]


def test_skewed_metrics_match_plain_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice("xyz") + str(rng.randrange(9)), rng.choice([None, 1.0, 2.5, -3.0]), i % 3) for i in range(3000)]
    rows += [("hot", "same", 1.0, 0)] * 2000 + [("", None, None, None)]
    df = spark.createDataFrame(rows, "key string, anchor string, v double, part int").repartition(7)
    got = {r["key"]: r for r in skewed_group_metrics(df, "key", ["anchor"], ["v"], chunk_rows=100).collect()}
    keys = {r[0] for r in rows}
    assert set(got) == keys
    for k in keys:
        own = [r for r in rows if r[0] == k]
        vals = [r[2] for r in own if r[2] is not None]
        assert got[k]["n_rows"] == len(own)
        assert got[k]["n_distinct"] == len({r[1] for r in own})
        assert got[k]["cnt_v"] == len(vals)
        assert got[k]["max_v"] == max(vals, default=None)
        if vals:
            assert got[k]["sum_v"] == pytest.approx(sum(vals))
    assert got["hot"]["n_chunks"] == -(-got["hot"]["n_rows"] // 100)


def test_skewed_metrics_of_nothing(spark):
    assert skewed_group_metrics(spark.createDataFrame([], "key string, anchor string, v double"), "key", ["anchor"], ["v"]).count() == 0


def test_join_unique_with_a_heavy_key(spark):
    rows = spark.createDataFrame([("hot",)] * 3000 + [("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, v int")
    assert join_unique(rows, table, "k").count() == 3001
    assert join_unique(rows, table, "k", "left").count() == 3003


def test_text_functions(spark):
    assert one(spark, text.top_module("c"), "c string", [("/src/a.py",), ("a.py",), ("",), ("//",), (None,)]) == ["src", "a.py", "__root__", "__root__", "__root__"]
    patch = "diff --git a/old.py b/new.py\n--- a/old.py\n+++ b/new.py\ndiff --git a/x.txt b/x.txt\n+++ b/k.pyx\n+++ b/new.py\n"
    assert one(spark, text.diff_paths("c"), "c string", [(patch,), (None,), ("",)]) == [["old.py", "new.py", "k.pyx"], [], []]
    assert one(spark, text.name_quality("c"), "c string", [("fix the x1 bug",), (None,), ("123",)]) == [0.75, 0.5, 0.5]
    sizes = one(spark, text.human_size("c"), "c string", [("1.5GB",), ("12k",), ("300",), ("x",), (None,)])
    assert sizes == [1610612736, 12288, 300, None, None]
    assert one(spark, text.line_count("c"), "c string", [("a\nb\n",), ("",), (None,), ("a\r\nb",), ("\n\n",)]) == [2, 0, 0, 2, 2]
    files = one(spark, text.patch_files("c"), "c string", [('["a.py", {"path": "b.py"}, {"file": ""}, "a.py", {"filename": "c.py"}]',), ("[broken",), ('{"a": 1}',), (None,)])
    assert files == [["a.py", "b.py", "c.py"], [], [], []]
    assert one(spark, text.json_length("c"), "c string", [("[1, 2]",), ("{}",), ("[",), (None,)]) == [2, 0, 0, 0]
    threads = '[{"comments": [{"body": "please refactor"}, {"body": "refactoring can wait"}]}, {"comments": "[{\\"body\\": \\"Split\\\\nthis\\"}]"}, "plain"]'
    per = F.transform(text.thread_bodies("c"), lambda b: text.mentions(b))
    assert one(spark, per, "c string", [(threads,), ("[",), (None,)]) == [[1, 1], [], []]
    assert one(spark, text.first_json_object("c"), "c string", [('so: {"a": {"b": 1}} ok',), ("none",)]) == ['{"a": {"b": 1}}', None]


def test_scores(spark):
    got = spark.range(1).select(scores.disconnect(F.lit(0), F.lit(3)), scores.disconnect(F.lit(3), F.lit(1)), scores.disconnect(F.lit(1), F.lit(2)), scores.sigmoid(F.lit(100.0)), scores.from_log(F.lit(-1.0))).first()
    assert got[0] == "name_misleads" and got[1] == "name_overclaims" and got[2] is None
    assert got[3] == pytest.approx(1 / (1 + math.exp(-20))) and got[4] == 0


@pytest.mark.parametrize("authors", [["a"], ["a", "b"], ["a"] * 9 + ["b"], list("abcdefghij")])
def test_ownership(spark, authors):
    got = org.ownership(spark.createDataFrame([("f", a) for a in authors], "file string, who string"), ["file"], "who").first()
    n, k = len(authors), len(set(authors))
    p = [authors.count(a) / n for a in set(authors)]
    h = -sum(x * math.log(x + 1e-12) for x in p)
    even = h / math.log(max(2, k)) if k > 1 else 0
    want = max(0, min(1, 0.6 * (1 - max(p)) + 0.4 * even)) * min(1, math.log1p(k) / math.log(10))
    assert (got.n_touches, got.n_authors) == (n, k)
    assert got.friction == pytest.approx(want) and got.entropy == pytest.approx(h, abs=1e-9)


def test_cochange(spark):
    rows = [("r", "c1", "a/x.py"), ("r", "c1", "a/y.py"), ("r", "c1", "b/z.py"), ("r", "c1", "a/x.py"), ("r", "c2", "a/x.py")]
    rows += [("r", "wide", f"w/{i}.py") for i in range(6)]
    edges = {(e.src, e.dst): e.weight for e in org.cochange(spark.createDataFrame(rows, "repo string, change string, file string"), ["repo", "change"], "file", 5).collect()}
    assert edges == {("a/x.py", "a/y.py"): 1.0, ("a/y.py", "a/x.py"): 1.0, ("a/x.py", "b/z.py"): 1.25, ("b/z.py", "a/x.py"): 1.25, ("a/y.py", "b/z.py"): 1.25, ("b/z.py", "a/y.py"): 1.25}


def test_upper_median(spark):
    df = spark.createDataFrame([("e", 1), ("e", 2), ("e", 3), ("e", 9), ("o", 5), ("o", 1), ("o", 7), ("n", None)], "k string, v int")
    assert {r.k: r.v for r in org.upper_median(df, ["k"], ["v"]).collect()} == {"e": 3, "o": 5}


def test_labels(spark):
    e = spark.createDataFrame([("a", "bugfix", 1, 0.5), ("a", "bugfix", 1, None), ("a", "docs", 2, 0.9), ("b", "docs", 3, None)], "k string, cat string, pr int, o double")
    got = {r.k: r for r in labels.anchor_labels(e, ["k"], "cat", "pr", "o", ["bugfix"]).collect()}
    assert (got["a"].has_bugfix, got["a"].n_bugfix, got["a"].max_bugfix_overlap) == (1, 1, 0.5)
    assert (got["b"].has_bugfix, got["b"].n_bugfix, got["b"].max_bugfix_overlap) == (0, 0, 0.0)


def test_recall_and_mrr(spark):
    rows = [("g", 1, 0, 0.9), ("g", 2, 1, 0.9), ("g", 3, 1, 0.1), ("none", 4, 0, 1.0), ("all", 5, 1, None)]
    got = ranking.recall_mrr(spark.createDataFrame(rows, "g string, id int, y int, s double"), "g", "y", "s", "id", (1, 2, 10)).first()
    assert (got.n_groups, got.mrr, got.recall_1, got.recall_2, got.recall_10) == (2, 0.75, 0.5, 0.75, 1.0)


def test_auroc_with_ties_and_positions(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 20, 500).astype(float)
    df = spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id int, y int, s double")
    got = ranking.auroc_ap(df, "y", "s").first()
    pos, neg = s[y == 1], s[y == 0]
    assert got.auroc == pytest.approx(((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()))
    placed = ranking.global_position(df, [F.desc("s"), F.col("id")]).collect()
    want = {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-s[i], i)))}
    assert {r.id: r.position for r in placed} == want
    run = {r.id: r.run_y for r in ranking.running_sums(df, [F.col("id")], ["y"]).collect()}
    assert run == {i: int(v) for i, v in enumerate(np.cumsum(y))}


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(f"g{i % 30}" if i % 3 else "hot", i, i % 2) for i in range(900)], "g string, id int, y int")
    s = {r.g: r.split for r in sampling.group_split(df, "g", 1).collect()}
    assert len(s) == 21 and list(s.values()).count("val") == 2
    assert s == {r.g: r.split for r in sampling.group_split(df.repartition(1), "g", 1).collect()}
    cap = sampling.largest_cap(df, "g", 200)
    sizes = [r["count"] for r in df.groupBy("g").count().collect()]
    assert sum(min(c, cap) for c in sizes) <= 200 < sum(min(c, cap + 1) for c in sizes)
    assert sampling.largest_cap(df, "g", 10**6) == max(sizes)
    folds = sampling.group_folds(df, "g", 3).collect()
    assert sum(r.n for r in folds) == 900 and len({r.g for r in folds}) == len(folds) == 21
    f = sampling.class_folds(df, "y", "id", 5, 1).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in f} == {90}
    draws = sampling.pair_draws(df, "g", "y", "id", 10, 1).collect()
    label = {r.id: r.y for r in df.collect()}
    assert draws and all(label[r.pos] == 1 and label[r.neg] == 0 for r in draws)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 8), (501, None)], "id bigint, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    want = {i: list(np.argsort(-s[i], kind="stable")[:4]) for i in range(300)}
    for size in (20_000, 70):
        got: dict = {}
        for r in vectors.exact_knn(df, "id", "v", 4, block_rows=size).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["neighbour"])
        assert got == want
    z = df.where("id in (7, 500)").select(vectors.finite(F.col("v")), F.get(vectors.zero_bad(F.col("v")), F.lit(0))).collect()
    assert [r[0] for r in z] == [True, False] and z[1][1] == 0.0
    assert vectors.exact_knn(df.limit(0), "id", "v", 3).count() == 0


SOURCE = '''
import os

class A:
    @property
    def f(self, x: int, *rest, y=1, **more) -> int:
        """Doc."""
        for i in rest:
            if i and x or y:
                return os.path.join(i)
            elif x:
                pass
        return [a for a in rest if a]

    def g(self):
        def g():
            return None
        match self:
            case 1: return {}
            case _: pass

async def f():
    print(1)
'''


def test_code_properties():
    rows = code.functions_of(SOURCE)
    assert [(r["name"], r["qualified_name"], r["is_last"]) for r in rows] == [("f", "f", False), ("f", "A.f", True), ("g", "A.g", False), ("g", None, True)]
    p = rows[1]
    assert (p["loc"], p["cyclomatic_complexity"], p["n_branches"], p["n_loops"], p["n_returns"]) == (8, 7, 3, 2, 2)
    assert (p["return_type_cat"], p["has_side_effects"], p["n_api_calls"], p["n_args"], p["has_decorators"], p["has_docstring"]) == ("primitive", False, 1, 4, True, True)
    assert rows[2]["cyclomatic_complexity"] == 3 and rows[0]["has_side_effects"] and rows[0]["return_type_cat"] == "none"
    assert SOURCE[rows[0]["start_char"] : rows[0]["end_char"]] == "    print(1)\n"
    assert code.functions_of("def (") == [] and code.functions_of(None) == []


def test_code_texts():
    assert code.split_source('  def f():\n      """D."""\n      return 1 + 2\n') == ('def f():\n    """D."""', "    return 1 + 2")
    assert code.split_source("def f(): pass") is not None and code.split_source("def f(): pass", least_sig=5) is None
    assert code.split_source("x = 1") is None and code.split_source(None) is None
    assert code.signature("def f(a):\n    return a") == "def f(a):"
    assert code.signature("def f(:\n    x = 1\n    y") == "def f(:\n    x = 1"
    assert code.stub('def f():\n    """One\n    two"""\n    return 1') == 'def f():\n    """One"""\n    ...'
    assert code.anonymous('def f():\n    "doc"\n    return 1') == "def func_ANON():\n    return 1"
    assert code.anonymous('def f():\n    "doc"\n    # why\n    return 1') == "def func_ANON():\n    return 1" and code.anonymous('def f():\n    "doc"') == "def func_ANON():\n    pass"
    assert code.anonymous("def f(:\n  def g") == "def func_ANON(:\n  def func_ANON" and code.stub("x = 1\ny") == "x = 1\n    ..."
    assert code.split_source('def f(\n    a,\n):\r\n    """D"""\n\n    return a\n') == ('def f(\n    a,\n):\n    """D"""', "\n    return a")
    assert code.named_function("def a(): pass\nclass B:\n    def a(self): return 1", "a") == "def a(): pass"
    assert code.resolve("B.a", ["A.a", "C.B.a"]) == "C.B.a" and code.resolve("a", ["A.a"]) == "A.a" and code.resolve("a", ["A.a", "B.a"]) is None


def test_sinks(spark):
    old = spark.createDataFrame([(1, "x", 1), (None, "n", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "y", 2), (1, "z", 3), (2, "w", 1), (None, "m", 2)], "k int, v string, t int")
    key = lambda rows: sorted((str(r.k), r.v) for r in rows)
    assert key(sinks.upsert_last_wins(old, new, ["k"], [F.desc("t")]).collect()) == [("1", "z"), ("2", "w"), ("None", "m")]
    assert key(sinks.insert_ignore(old, new, ["k"], [F.col("t")]).collect()) == [("1", "x"), ("2", "w"), ("None", "n")]
    got = sinks.update_by_key(old, spark.createDataFrame([(1, "q")], "k int, extra string"), "k", ["extra"])
    assert {r.v: r.extra for r in got.collect()} == {"x": "q", "n": None}
    assert sinks.markdown(spark.createDataFrame([(1, "a|b")], "x int, y string")).splitlines()[-1] == "| 1 | a\\|b |"


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a\n\n b \n")
    assert [r.item for r in readers.list_file(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    (tmp_path / "m.json").write_text('{"7": {"0": [1, 2], "1": []}}')
    assert sorted(map(tuple, readers.json_id_map(spark, str(tmp_path / "m.json")).collect())) == [(7, "0", 1), (7, "0", 2)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n')
    assert sorted((r.a is None, r.a) for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [(False, 1), (True, None)]
    p = tmp_path / "12__own__repo"
    p.mkdir()
    (p / "f").write_text("x")
    assert [tuple(r) for r in readers.listing(spark, f"{tmp_path}/*/f").collect()] == [("12", "own", "repo")]
    empty = spark.createDataFrame([], "a int")
    assert readers.or_example(empty, [(1,)], "a int").count() == 1
    made = []
    for _ in range(2):
        readers.cached_table(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3).toDF("id"), "v1")
    assert made == [1]


def test_streamed_upserts_equal_batch(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 2)], [(3, "d", 1), (2, "e", 0)]]):
        spark.createDataFrame(rows, "k int, v string, t int").coalesce(1).write.mode("append").parquet(str(src))
        q = incremental.upsert_stream(spark.readStream.schema("k int, v string, t int").parquet(str(src)), out, str(tmp_path / "state"), ["k"], "t")
        q.awaitTermination()
    assert sorted(map(tuple, incremental.latest(spark, out).select("k", "v").collect())) == [(1, "c"), (2, "e"), (3, "d")]
    with pytest.raises(FileNotFoundError):
        incremental.latest(spark, str(tmp_path / "nothing"))


def test_heads_match_their_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3))
    y = (x[:, 0] + 0.5 * rng.standard_normal(200) > 0.3).astype(int)
    t = x @ [1.0, -2.0, 0.5] + rng.standard_normal(200)
    df = spark.createDataFrame([(i, *map(float, r), int(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, t))], "id int, a double, b double, c double, y int, t double")
    z = ml.standardise(df, ["a", "b", "c"])
    s = (x - x.mean(0)) / x.std(0)
    m = heads.fit_ridge(df, ["a", "b", "c"], "t", alpha=1.0)
    want = np.linalg.solve(s.T @ s + np.eye(3), s.T @ (t - t.mean()))
    assert np.allclose(m.coef, want, atol=1e-9) and np.isclose(m.intercept, t.mean())
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    beta, b0 = np.zeros(3), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(s @ beta + b0)))
        d = np.column_stack([s, np.ones(200)])
        g = d.T @ (w * (p - y)) + np.append(beta, 0)
        h = (d * (w * p * (1 - p))[:, None]).T @ d + np.diag([1, 1, 1, 0])
        step = np.linalg.solve(h, g)
        beta, b0 = beta - step[:3], b0 - step[3]
    got = ml.logistic(z, "y")
    assert np.allclose(got.coefficients.toArray(), beta, atol=1e-3) and got.intercept == pytest.approx(b0, abs=1e-3)
    own = heads.fit_logistic(df, ["a", "b", "c"], "y")
    assert np.allclose(own.coef, beta, atol=1e-6) and own.intercept == pytest.approx(b0, abs=1e-6)
    p = 1 / (1 + np.exp(-(s @ beta + b0)))
    assert np.allclose([r.p for r in df.select("id", own.probability().alias("p")).orderBy("id").collect()], p, atol=1e-6)
    tied = heads.fit_logistic(df, ["a", "b", "c"], "y", penalise_intercept=True)
    w1 = np.append(tied.coef, tied.intercept)
    q = 1 / (1 + np.exp(-(d @ w1)))
    assert np.abs(d.T @ (w * (q - y)) + w1).max() < 1e-5
    one = heads.fit_logistic(df.where("y = 1"), ["a"], "y")
    assert one.intercept > 20 and heads.fit_logistic(df.limit(0), ["a"], "y").intercept < -20


def test_head_is_written_and_read(spark, tmp_path):
    head = heads.Head(["a", "b"], [0.5, 1.0], [2.0, 0.0], [1.5, 9.0], -0.25)
    head.write(spark, f"file://{tmp_path}/head")
    back = heads.Head.read(spark, f"file://{tmp_path}/head")
    assert back == head
    df = spark.createDataFrame([(2.5, 7.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(back.linear()).collect()] == [1.25, -0.25]
    with pytest.raises(FileNotFoundError):
        heads.Head.read(spark, f"file://{tmp_path}/none")


def test_cross_validation(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((240, 2)) * [3, 0.1] + [10, -4]
    t = x @ [0.5, 2.0] + 0.3 * rng.standard_normal(240)
    k = np.arange(240) % 4
    c = np.where(x[:, 0] > 11, 2, np.where(x[:, 1] > -4, 1, 0))
    df = spark.createDataFrame([(*map(float, r), float(a), int(f), int(y)) for r, a, f, y in zip(x, t, k, c)] + [(None, 1.0, 1.0, 0, None)], "a double, b double, t double, fold int, y int")
    want = []
    for i in range(4):
        tr, te = k != i, k == i
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x - m) / s
        w = np.linalg.solve(z[tr].T @ z[tr] + np.eye(2), z[tr].T @ (t[tr] - t[tr].mean()))
        r = t[te] - z[te] @ w - t[tr].mean()
        want.append(1 - (r @ r) / ((t[te] - t[te].mean()) ** 2).sum())
    assert np.allclose(heads.cross_validated_ridge(df, ["a", "b"], "t", "fold", 4), want, atol=1e-9)
    got = heads.cross_validated_classes(df, ["a", "b"], "y", 3, "fold", 4)
    assert len(got) == 4 and min(got) > 0.85
    table = heads.Table(df.where("y is not null"), heads.scaler(df.where("y is not null"), ["a", "b"]), F.col("y"))
    w = heads._softmax(table.df.select("x", "y"), 2, np.ones(3), 1.0, False)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(240)])
    p = np.exp(z @ w)
    p /= p.sum(1, keepdims=True)
    g = z.T @ (p - np.eye(3)[c])
    g[:2] += w[:2]
    assert np.abs(g).max() < 1e-4  # the gradient is zero


def test_percentiles_and_sessions(spark):
    rng = random.Random(3)
    v = [rng.choice([1.0, 1.0, 1.0, 2.5, rng.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 9, "v double").repartition(5)
    assert np.allclose(ranking.percentiles(df, "v", [0, 0.1, 0.5, 0.9, 1]), np.percentile(v, [0, 10, 50, 90, 100]))
    assert ranking.percentiles(df.limit(0), "v", [0.5]) == [None]
    logs = [("a", 0, "lost"), ("a", 1, "@@@h1\tx"), ("a", 2, " f.py "), ("a", 3, ""), ("a", 4, "@@@h2\ty"), ("a", 5, "g.py"), ("b", 0, "no mark"), ("c", 0, "@@@h3"), ("c", 1, "z.py"), ("c", 2, None)]
    got = readers.marked_sessions(spark.createDataFrame(logs, "log string, n int, line string").repartition(4), "log", "n", "line").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, "h1", "x", "f.py"), ("a", 2, "h2", "y", "g.py"), ("c", 1, "h3", None, "z.py")]


def test_small_network(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1200, 2))
    df = spark.createDataFrame([(*map(float, r), int(r[0] * r[1] > 0)) for r in x], "a double, b double, y int")
    head, w = heads.small_network(df, ["a", "b"], "y", hidden=32, rounds=80, rate=5e-3)
    s = heads.network_score(df, head, w).select("y", "score").collect()
    assert np.mean([(r.score > 0.5) == r.y for r in s]) > 0.9  # no linear head can


def test_words_come_from_the_fitted_texts(spark):
    fitted = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None)], "id int, t string")
    other = spark.createDataFrame([(9, "aa dd dd dd"), (8, "dd"), (7, "")], "id int, t string")
    words = ml.TfIdf(fitted, "id", "t", 10, bias=True)
    assert {r.w: r.i for r in words.words.collect()} == {"aa": 0, "bb": 1, "cc": 2}
    rows = words.transform(other).collect()
    assert [(r.id, r.features.indices.tolist(), r.features.values.tolist()) for r in rows] == [(9, [0, 10], [1.0, 1.0])]
    v = {r.id: r.features.toArray() for r in words.transform(fitted).collect()}
    a, b = (1 + math.log(2)) * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert np.allclose(v[1][:2], np.array([a, b]) / math.hypot(a, b))


def test_candidate_packs(spark):
    df = spark.createDataFrame([(i, *[0.5] * len(packs.FIELDS)) for i in range(60)] + [(99, *[None] * len(packs.FIELDS))], "id int, " + ", ".join(f"{f} double" for f in packs.FIELDS))
    rows = packs.candidate_packs(df, "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, {})[r.kind] = r
    assert all(set(p) == {"real", *packs.KINDS} and {r.candidate for r in p.values()} == {f"cand_{x}" for x in "ABCDEF"} for p in by.values()) and len(by) == 61
    assert len({p["real"].candidate for p in by.values()}) == 6 and sum(r.label for r in rows) == 61
    p = by[5]
    assert p["real"].risk_scope == 0.5 and 0.55 <= p["naming_drift"].risk_scope <= 0.64 and p["scope_bloat"].additions > 30 and p["real"].n_threads == 0.5
    assert rows == packs.candidate_packs(df.repartition(7), "id").orderBy("id", "candidate").collect() or sorted(rows) == sorted(packs.candidate_packs(df.repartition(7), "id").collect())


def test_seams(spark):
    def answer(pack):
        if pack["id"].iloc[0] == 1:
            return 'I take {"best_candidate": "b"}.'
        if pack["id"].iloc[0] == 2:
            raise OSError("no model")
        return "c is it"

    def model():
        return lambda texts: np.array([[len(t)] for t in texts])

    packs_ = spark.createDataFrame([(i, c, 0) for i in (1, 2, 3) for c in "abc"], "id int, name string, x int")
    got = {r.id: (r.chosen, r.n_asked) for r in seams.choose(packs_, "id", "name", ["x"], answer, retries=1).collect()}
    assert got == {1: ("b", 1), 2: ("a", 2), 3: ("c", 1)}
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abcdef")], "k int, t string")
    assert {r.k: r.vec for r in seams.infer(texts, "k", "t", model, batch=2).collect()} == {1: [3.0], 2: None, 3: [0.0], 4: [6.0]}


def test_vector_store(spark, tmp_path):
    df = spark.createDataFrame([(2, "m/x", 1, [3.0, 4.0]), (1, "m/x", 1, [0.0, 2.0]), (3, "m/x", 2, [1.0, 0.0]), (4, "m/x", 1, [float("nan"), 1.0]), (None, "m/x", 1, [1.0, 1.0])], "id int, model_name string, layer_index int, v array<double>")
    place = f"file://{tmp_path}"
    assert vector_store.write_vectors(df, place, "id", "v", "m/x", 1).endswith("vectors-m_x-layer1")
    rows = vector_store.load_vectors(spark, place, "m/x", 1).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2] and np.allclose([r.vec for r in rows], [[0, 1], [0.6, 0.8]])
    assert vector_store.write_vectors(df, place, "id", "v", "none") == ""
    with pytest.raises(FileNotFoundError):
        vector_store.load_vectors(spark, place, "none")


def test_vectors_of_other_lengths_are_left_out(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    whole = spark.createDataFrame(rows, "id int, v array<double>")
    ragged = spark.createDataFrame([(100, [1.0, 2.0]), *rows[:20], (101, [1.0] * 6), *rows[20:], (102, None)], "id int, v array<double>")
    key = lambda t: sorted((r.query, r["rank"], r.neighbour) for r in t.collect())
    want = key(vectors.exact_knn(whole, "id", "v", 3))
    assert key(vectors.exact_knn(ragged, "id", "v", 3)) == want
    asked = ragged.where("id in (3, 101, 7)")
    for few in (100, 0):  # sent to the collection, and in blocks
        assert key(vectors.exact_knn(ragged, "id", "v", 3, asked, few=few)) == [t for t in want if t[0] in (3, 7)]
    q = spark.createDataFrame([(i, (v + 0.3).tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    u, w = x / np.linalg.norm(x, axis=1, keepdims=True), (x + 0.3) / np.linalg.norm(x + 0.3, axis=1, keepdims=True)
    s = w @ u.T
    got = {r.id: r["rank"] for r in vectors.true_ranks(q, whole, "id", "v", block_rows=15, ask_rows=7).collect()}
    assert got == {i: 1 + int((s[i] > s[i, i]).sum()) for i in range(40)}


def test_ranks_without_copied_rows(spark):
    """Many blocks, equal rows and rows without query: right ranks, and the shuffle doesn't grow with the blocks."""
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((60, 4)), 1)
    v[30:40], v[50] = v[:10], 0
    q = np.round(v + 0.6 * rng.standard_normal((60, 4)), 1)
    rows = [(i, q[i].tolist() if i % 7 else None, v[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, q array<float>, v array<float>")
    unit = lambda x: np.float32(x).astype(float) / (np.linalg.norm(np.float32(x).astype(float), axis=1, keepdims=True) + 1e-9)
    s = np.round(np.einsum("ik,jk->ij", unit(q), unit(v)), 12)
    want = {i: 1 + sum(s[i, j] > s[i, i] or s[i, j] == s[i, i] and j < i for j in range(60) if j != i) for i in range(60) if i % 7}
    for blocks in (5, 100):
        assert {r.id: r["rank"] for r in vectors.own_ranks(df, "id", "q", "v", block_rows=blocks, ask_rows=4).collect()} == want
        assert {r.id: r["rank"] for r in vectors.own_ranks(df, "id", "q", "v", block_rows=blocks, ask_rows=4, up_to=3).collect()} == {i: k if k <= 3 else None for i, k in want.items()}
    plan = vectors.own_ranks(df, "id", "q", "v", block_rows=5)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_pairs_without_broadcast_rows(spark, monkeypatch):
    """Drawing and looking up pairs sends no table of all rows to the driver, however small its files are; each pair is written once."""
    df = spark.range(80).select("id", (F.col("id") % 5).alias("g"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y"), (F.col("id") % 7 + F.pmod(F.xxhash64("id"), F.lit(2))).alias("x"))
    written = []
    monkeypatch.setattr(heads, "Stored", lambda t, label: written.append((Stored(t, label), t._jdf.queryExecution().executedPlan().toString())) or written[-1][0])
    draws = sampling.pair_draws(df, "g", "y", "id", 10, 1)
    monkeypatch.setattr(Stored, "drop", lambda self: None)
    head = heads.fit_pairwise(df, ["x"], draws, "id")
    (kept, plan), = written
    assert kept.df.count() == draws.count() > 0 and head.coef[0] > 0 and abs(head.intercept) < 1e-6
    assert not re.search(r"BroadcastHashJoin \[(pp|nq|pos|neg)#", plan) and len(re.findall(r"SortMergeJoin \[(?:pp|nq|pos|neg)#", plan)) == 4


def test_sources_by_rule(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, v string")
    assert sorted(r.v for r in readers.in_list(df, "k", [2, 2, None, 7]).collect()) == ["b", "d"] and readers.in_list(df, "k", []).count() == 0
    assert [r.v for r in readers.first_matching(df, F.col("k") == 2, [F.desc("v")], 1).collect()] == ["d"]
    assert sorted(r.chunk for r in sampling.round_robin(spark.range(10), [F.col("id")], 4).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    partner = {r.id: r.partner for r in sampling.random_partners(spark.range(7), "id", 1).collect()}
    assert sorted(partner.values()) == list(range(7)) and all(a != b for a, b in partner.items())
    (tmp_path / "n.jsonl").write_text('{"id": 7, "buckets": {"0": [1, 2], "1": []}}\nbroken\n')
    assert sorted(map(tuple, readers.json_id_lines(spark, str(tmp_path / "n.jsonl")).collect())) == [(7, "0", 1), (7, "0", 2)]
