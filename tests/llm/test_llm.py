import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyard.llm import components, fmindex, knn, leak, lexicon, overlap, registry, subjects, topn
from tallyard.llm.words import words

DIM = 64


def find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


# ------------------------------------------------------------------ problem 1


@pytest.mark.parametrize("parts", [1, 7])
def test_top_n_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(200)}", rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6]), i) for i in range(4000)]
    rows += rows[:500] + [(None, 3, 3, 90_000), ("", 1, None, 90_001), ("g1", 3, 6, None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "grp string, a int, b int, item bigint, place int, part string").repartition(parts)
    got = sorted(tuple(r) for r in topn.top_n(df, "grp", [("a", "desc"), ("b", "desc")], "item", 3).collect())
    by = defaultdict(set)
    for g, a, b, i in rows:
        if g is not None and a is not None and i is not None:
            by[g].add((-a, b is None, -(b or 0), i))
    want = sorted((g, x[3], n + 1) for g, s in by.items() for n, x in enumerate(sorted(s)[:3]))
    assert got == want


def test_top_n_of_one_group_over_many_partitions(spark):
    df = spark.range(5000).select(F.lit("only").alias("g"), (F.col("id") % 7).alias("s"), "id")
    got = topn.top_n(df, "g", [("s", "desc")], "id", 1500).orderBy("position").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 7), i))[:1500]
    assert [r.item for r in got] == want and [r.position for r in got] == list(range(1, 1501))


def test_top_n_keeps_types(spark):
    rows = [("g", 0.1, "a"), ("g", 0.9, "b"), ("g", 0.5, "c"), ("g", float("nan"), "d"), ("g", float("nan"), "d"), ("h", -0.5, "e"), ("h", -0.25, "f"), ("h", None, "g")]
    df = spark.createDataFrame(rows, "g string, s double, id string").repartition(3)
    got = {(r.grp, r.position): r.item for r in topn.top_n(df, "g", [("s", "desc")], "id", 3).collect()}
    assert got == {("g", 1): "d", ("g", 2): "b", ("g", 3): "c", ("h", 1): "f", ("h", 2): "e"}
    days = spark.sql("select date'2024-01-01' + cast(id % 3 as int) g, timestamp_seconds(id) s, cast(id as decimal(9,2)) id from range(30)")
    got = topn.top_n(days, "g", [("s", "asc")], "id", 1)
    assert dict(got.dtypes) == {"grp": "date", "item": "decimal(9,2)", "position": "bigint"} and sorted(int(r.item) for r in got.collect()) == [0, 1, 2]


def test_top_n_of_nothing(spark):
    assert topn.top_n(spark.createDataFrame([], "g string, s int, id bigint"), "g", [("s", "desc")], "id", 3).count() == 0


# ------------------------------------------------------------- problems 4 and 5


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(700)],
        "chain": [(i, i + 1) for i in range(300)],
        "hub": [(500, i) for i in range(1200)] + [(5000, 5001), (1, 9999)],
        "loops": [(1, 1), (2, 2), (2, 3), (3, 3)],
    }[kind]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (7, None)], "a bigint, b bigint").repartition(6)
    want = find(edges)
    for limit in (40, 10**6):
        rows = components.forest_components(df, "a", "b", part_edges=limit, fan_in=2).collect()
        assert dict(map(tuple, rows)) == want and len(rows) == len(want)
    linked = {x: r for x, r in find([e for e in edges if e[0] != e[1]]).items()}
    rows = components.star_components(df, "a", "b", heavy_share=2).collect()
    assert dict(map(tuple, rows)) == linked and len(rows) == len(linked)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert components.forest_components(df, "a", "b").count() == 0
    assert components.star_components(df, "a", "b").count() == 0


def test_splits_are_proportional(spark):
    rng = random.Random(2)
    rows = [("big", 30_000), ("next", 9000)] + [(f"g{i}", rng.randrange(1, 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, n bigint")
    got = dict(map(tuple, components.proportional_splits(df, "g", "n").collect()))
    assert set(got) == {g for g, _ in rows}
    total = sum(n for _, n in rows)
    for s, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert sum(n for g, n in rows if got[g] == s) / total == pytest.approx(share, abs=0.005)
    assert components.proportional_splits(df.limit(0), "g", "n").count() == 0


# ------------------------------------------------------------------ problem 7


TEXTS = ["", None, "Hello  world\n\n it's  we'll  ", "a" * 4000, "ab" * 2000, "<|endoftext|> x", "漢字 naïve ​　 x", "def f(x):\n\treturn x_1 ** 22", " ", "\r\n \n"]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{lexicon.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    for size in (0, 3, 1000):
        assert {r.doc_id: list(r.ids) for r in lexicon.encode_ids(df, "doc_id", "text", lexicon_size=size).collect()} == want
    assert lexicon.encode_ids(df.limit(0), "doc_id", "text").count() == 0


def test_automaton_is_minimal_and_exact(tmp_path):
    held = {w.encode(): [i, -i] for i, w in enumerate(["walking", "talking", "king", "walk", "talk", "a", "é"])}
    p = tmp_path / "a"
    p.write_bytes(lexicon.compile_automaton(held))
    a = lexicon.Automaton(str(p))
    asked = [*held, b"wal", b"kings", b"", b"walkin", b"z"]
    n = a.numbers(asked)
    assert [a.ids[a.starts[i] : a.starts[i + 1]].tolist() for i in n[: len(held)]] == list(held.values())
    assert (n[len(held) :] == -1).all()
    assert len(a.final) <= 12  # suffixes are shared: a trie would have 20 states


# ------------------------------------------------------------------ problem 2


def relatives(rng, n, size, noise):
    x = rng.standard_normal((n, DIM))
    out = np.concatenate([x] + [x[: n // 4] + noise * rng.standard_normal((n // 4, DIM)) for _ in range(size)])
    return (out * rng.uniform(0.5, 3, (len(out), 1))).astype(np.float32)


def brute(x, ids, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    order = np.argsort(ids)
    return {int(ids[i]): [int(ids[order[j]]) for j in np.argsort(-s[i][order], kind="stable")[:k]] for i in range(len(x))}


@pytest.mark.parametrize("cell", [65_536, 400])
def test_neighbours_recall(spark, cell):
    x = relatives(np.random.default_rng(7), 1200, 3, 0.25)
    ids = np.random.default_rng(8).permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), "m") for i, v in zip(ids, x)], "id bigint, v array<float>, space string").repartition(3)
    want = brute(x, ids, 5)
    got = defaultdict(set)
    for r in knn.top_similar(df, F.col("space"), "id", "v", 5, cell_rows=cell).collect():
        got[r.id].add(r.neighbour)
    assert all(len(g) == 5 for g in got.values()) and len(got) == len(x)
    recall = np.mean([len(got[i] & set(w)) / 5 for i, w in want.items()])
    assert recall > 0.9


def test_equal_directions_tie(spark):
    v = np.random.default_rng(3).standard_normal(DIM).astype(np.float32)
    df = spark.createDataFrame([(i, ((1 + i % 2) * v).tolist()) for i in range(1, 30)], "id bigint, v array<float>").repartition(4)
    got = defaultdict(list)
    for r in knn.top_similar(df, F.lit("s"), "id", "v", 5).collect():
        got[r.id].append(r.neighbour)
    assert {i: sorted(g) for i, g in got.items()} == {i: [j for j in range(1, 7) if j != i][:5] for i in range(1, 30)}


def test_crowded_cells_are_cut_on_both_sides(spark):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal(DIM) + 0.4 * rng.standard_normal((1500, DIM))).astype(np.float32)  # one crowd
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id bigint, v array<float>")
    rows = knn.with_class(df, F.lit("s"), "id", "v", DIM)
    cells = knn.fit_cells(rows, DIM, 100, 64, 0.3, 8)
    assert len(cells.book["s"]) > 1 and cells.members.max() > 2 and cells.guests.max() > 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    who, task, member, asks = cells.visit("s", u, np.random.default_rng(1).integers(-(2**62), 2**62, len(x)))
    assert (np.bincount(task[member]) <= 500).all() and (np.bincount(task[asks]) <= 900).all()
    want = brute(x, ids, 5)
    got = defaultdict(set)
    for r in knn.top_similar(df, F.lit("s"), "id", "v", 5, cell_rows=100, sample_rows=64).collect():
        got[r.id].add(r.neighbour)
    assert np.mean([len(got[i] & set(w)) / 5 for i, w in want.items()]) > 0.9


def test_hot_copies_and_dirt(spark):
    rng = np.random.default_rng(1)
    hot, other = rng.standard_normal(DIM).tolist(), rng.standard_normal(DIM).tolist()
    rows = [(i, hot) for i in range(100, 400)] + [(100, hot), (1, other), (2, other), (50, [h + 0.01 for h in hot])]
    rows += [(900, None), (901, [0.0] * DIM), (902, [float("nan")] * DIM), (903, [1.0]), (904, [None] * DIM), (905, [float("inf")] * DIM), (None, hot)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "id bigint, v array<float>, h1 string").repartition(5)
    got = defaultdict(set)
    for r in knn.top_similar(df, F.lit("s"), "id", "v", 5, 0.9).collect():
        got[r.id].add(r.neighbour)
    assert got[399] == {100, 101, 102, 103, 104} and got[102] == {100, 101, 103, 104, 105}
    assert got[1] == {2} and got[2] == {1} and got[50] == {100, 101, 102, 103, 104}
    assert not {900, 901, 902, 903, 904, 905} & (set(got) | {n for s in got.values() for n in s})
    assert knn.top_similar(df.limit(0), F.lit("s"), "id", "v").count() == 0


# ------------------------------------------------------------------ problem 3


def test_backward_search_finds_what_it_should():
    rng = np.random.default_rng(3)
    for _ in range(40):
        strings = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(rng.integers(1, 30))]
        index = fmindex.FMIndex(np.concatenate(strings), [len(s) for s in strings])
        asked = [rng.integers(1, 5, n) for n in (1, 2, 3, 4, 7)] + [np.array([9])]
        lens = np.array([len(a) for a in asked])
        which, lo, hi = index.search(index.numbers(np.concatenate(asked)), np.cumsum(lens), lens)
        at, place = index.places(lo, hi)
        string = np.searchsorted(index.starts, place, side="right") - 1
        got = set(zip(which[at].tolist(), string.tolist(), (place - index.starts[string]).tolist()))
        assert got == {(i, j, o) for i, a in enumerate(asked) for j, s in enumerate(strings) for o in range(len(s) - len(a) + 1) if (s[o : o + len(a)] == a).all()}


def test_maximal_matches_at_their_places():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 3, (n, 9)) + np.arange(9) * 3 + 1 for n in (20, 15))
    p, s, n, size = fmindex.place_matches(fmindex.FMIndex(b.ravel(), [9] * 15), a, 2)
    got = {(i, j): (k, m) for i, j, k, m in zip(p.tolist(), s.tolist(), n.tolist(), size.tolist())}
    want = {}
    for i in range(20):
        for j in range(15):
            pieces = "".join("x" if e else " " for e in a[i] == b[j]).split()
            if own := [len(x) for x in pieces if len(x) > 1]:
                want[i, j] = (len(own), sum(own))
    assert got == want


def test_maximal_matches_of_texts():
    x = np.arange(10, 60)
    y = x.copy()
    y[20] = 5
    index = fmindex.FMIndex(np.concatenate([y, np.arange(100, 140), [7], np.tile([3, 4], 20_000)]), [50, 40, 1, 40_000])
    m = fmindex.text_matches(index, x, [50], 5, 0.8)
    assert {k: v.tolist() for k, v in m.items()} == {"pattern": [0], "string": [0], "spans": [2], "matched": [49], "lo": [0], "hi": [50]}
    m = fmindex.text_matches(index, np.concatenate([[7], np.tile([3, 4], 20_000), x[:30], x[::-1]]), [1, 40_000, 30, 50], 5, 0.8)
    assert m["pattern"].tolist() == [0, 1] and m["string"].tolist() == [2, 3] and m["spans"].tolist() == [1, 1] and m["matched"].tolist() == [1, 40_000]


def test_near_texts_in_shards(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(5000))
    kept = [[word() for _ in range(rng.choice([3, 30, 60]))] for _ in range(120)]
    sent = []
    for i, t in enumerate(kept):
        t = list(t)
        if i % 3:
            t[len(t) // 2] = "other"
        sent.append(t)
    rows = [(False, i, i, ".".join(t)) for i, t in enumerate(kept)] + [(True, i if i % 3 == 0 else 1000 + i, i, ".".join(t)) for i, t in enumerate(sent)]
    df = spark.createDataFrame(rows, "train boolean, h1 bigint, h2 bigint, txt string").repartition(3)
    for tokens in (10**6, 2000):
        got = {r.e1: r for r in overlap.matching_texts(df, 0.8, shard_tokens=tokens).collect()}
        for i, t in enumerate(kept):
            if i % 3 == 0:
                assert got[i].n_spans == 1 and got[i].n_matched == got[i].n_train == got[i].n_eval
            elif len(t) > 3:
                assert got[i].t1 == 1000 + i and got[i].n_spans == 2 and got[i].n_matched == got[i].n_train - 1 and got[i].first == 0 and got[i]["last"] == got[i].n_train
            else:
                assert i not in got  # too short to have a run of nine
        assert {r.e1 for r in overlap.matching_texts(df, 1.0, shard_tokens=tokens).collect()} == set(range(0, 120, 3))


def test_cross_split_overlaps(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, DIM))
    y = np.concatenate([x[:60], x[60:120] + 0.1 * rng.standard_normal((60, DIM)), rng.standard_normal((100, DIM))])
    body = lambda i: f"def f{i}(a):\n    return {i}"
    rows = [(i, True, f"Name{i}", body(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, False, f"name {i}" if i < 90 else f"other{i}", body(i).replace(" ", "  ").upper() if i % 2 else None, v.tolist()) for i, v in enumerate(y)]
    rows += [(5000, None, "Name1", body(1), x[1].tolist()), (5001, False, None, body(2), None), (5002, False, "", "", [0.0] * DIM), (5003, True, "", "", [1.0])]
    df = spark.createDataFrame(rows + rows[:50], "id bigint, train boolean, name string, body string, vec array<float>").repartition(4)
    got = {tuple(r) for r in overlap.cross_split_matches(df).collect()}
    u, w = (z.astype(np.float32).astype(float) for z in (x, y))
    u, w = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (u, w))
    want = {(int(a), 1000 + int(b)) for a, b in zip(*np.nonzero(u @ w.T >= 0.98))}
    assert len(want) > 90
    want |= {(i, 1000 + i) for i in range(90) if i % 2} | {(5003, 5002)}
    assert got == want
    n = defaultdict(int)
    for _, e in want:
        n[e] += 1
    assert {r.eval_id: r.n for r in overlap.Overlaps(df).counts().collect()} == n
    assert overlap.Overlaps(df.where("train")).counts().count() == 0
    assert overlap.cross_split_matches(df.where("train")).count() == 0
    assert overlap.cross_split_matches(df.limit(0)).count() == 0


# ------------------------------------------------------------------ problem 8


def test_words():
    assert words("Ruf​t-Doren_x \xad12\n> A") == ["ruft", "doren", "x", "12", "a"]
    assert words(None) == words("") == []


def test_leaks(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(900)]
    items = [(i, " ".join(rng.sample(names, 60 if i % 3 else 17)).capitalize() + ".") for i in range(40)]
    long = lambda i: items[i][1].split()
    filler = lambda n: " ".join(rng.choice(["the", "server", "writes", "a", "row", "and", "then", "stops"]) for _ in range(n))
    changed = lambda w: " ".join("zzz" if n % 12 == 5 else x for n, x in enumerate(w))
    docs = {
        1: filler(30) + " " + items[1][1] + " " + filler(30),
        2: filler(9) + "\n> " + "\n> ".join(" ".join(long(2)[n : n + 8]).upper() for n in range(0, 60, 8)),
        3: filler(200) + " " + changed(long(4)[10:40]) + " " + filler(500),
        4: items[3][1],
        5: filler(10) + " " + " ".join(rng.sample(long(5), 60)),
        6: filler(10) + " " + " ".join(long(7)[5:17]) + " " + filler(10),
        7: " ".join(long(8)[:22]) + " " + filler(40) + " " + " ".join(long(8)[30:52]),
        8: None, 9: "", 10: " \n ", 11: filler(3000), 12: " ".join(long(6)[:14]),
        13: filler(5) + "".join(f" {a[:2]}​{a[2:]}," for a in long(10)[20:45]),
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(1, docs[1], "x")], "doc_id bigint, text string, ids string").repartition(3)
    i = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = sorted(map(tuple, leak.leaked_items(d, i).collect()))
    assert got == [(1, 1), (2, 2), (3, 4), (4, 3), (7, 8), (13, 10)]
    assert leak.leaked_items(d.limit(0), i).count() == 0
    assert leak.leaked_items(d, i.limit(0)).count() == 0


def test_short_items_are_whole_or_not_there(spark):
    texts = [(1, "red paint and blue paint on walls"), (2, "so Red,\nblue GREEN it is"), (3, "red blue"), (4, "walls")]
    docs = spark.createDataFrame([*texts, (5, "nothing of that at all")], "doc_id bigint, text string")
    long = [(100 + i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(60)]
    for extra in ([], long):  # other items change nothing
        items = spark.createDataFrame([(7, "red blue green"), (8, "walls"), *extra], "item_id int, text string")
        for size in (4_000_000, 4000):
            got = sorted(map(tuple, leak.leaked_items(docs, items, shard_chars=size).collect()))
            assert got == [(1, 8), (2, 7), (4, 8)]


def test_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leak.lcs_length(a, b) == t[-1][-1]


# ------------------------------------------------------------------ problem 9


def test_subjects(spark):
    rng = random.Random(9)
    terms = {s: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)] for s in ("law", "sport", "music")}
    plain = ["the server writes a row", "tests were split", "this change restores the cache", "nothing else calls it"]

    def text(subject, n, m):
        lines = [f"the {rng.choice(terms[subject])} view reads the {rng.choice(terms[subject])}" for _ in range(n)] if subject else []
        lines += [rng.choice(plain) for _ in range(m)]
        rng.shuffle(lines)
        return ". ".join(lines) + "."

    truth, rows = {}, []
    for i in range(600):
        s = rng.choice([*terms, None])
        truth[i] = s
        rows.append((i, text(s, rng.randrange(2, 6), rng.randrange(2, 6))))
    rows += [(700, None), (701, ""), (702, text("law", 1, 30)), (703, text("law", 1, 0)), (704, "x " * 20000), (705, " ".join(terms["sport"][0].title() + terms["sport"][1].title() for _ in range(2)) + "\n" + "_".join(terms["sport"]))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(300)] + [(0, truth[0]), (None, "law"), (9999, "law")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, f"about {s}") for s in terms], "subject string, description string")
    model, f1 = subjects.fit(docs, labels, areas)
    got = defaultdict(set)
    for r in subjects.assign(docs, model).collect():
        got[r.doc_id].add(r.subject)
    unseen = [i for i in range(300, 600)]
    assert np.mean([got[i] == ({truth[i]} if truth[i] else set()) for i in unseen]) > 0.95 and f1 > 0.95
    assert not got[700] and not got[701] and not got[702] and got[703] == {"law"} and not got[704]
    empty, _ = subjects.fit(docs, labels.limit(0), areas)
    assert subjects.assign(docs, empty).count() == 0
    none, _ = subjects.fit(docs.limit(0), labels, areas.limit(0))
    assert subjects.assign(docs.limit(0), none).count() == 0


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    n_segments, n_features = np.array([3, 0, 2]), np.array([2, 0, 3, 1, 4])
    idx, words = rng.integers(0, 7, n_features.sum()), rng.integers(1, 9, 5)
    y = rng.integers(0, 2, (3, 2)).astype(float)
    p = [rng.standard_normal(x).astype(np.float64) for x in ((7, 3), (3, 2), (2,))]

    def loss():
        h = np.array([p[0][idx[lo : lo + n]].sum(0) for lo, n in zip(np.cumsum(n_features) - n_features, n_features)]) * subjects.segment_scale(words)[:, None] / 16
        q = subjects.certainty(subjects.per_document(subjects.sigmoid(16 * h @ p[1] + p[2]), n_segments), np.maximum(1, n_segments))[2]
        q = np.clip(q, 1e-5, 1 - 1e-5)
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()

    got = subjects.gradient(*p, idx, n_features, words, n_segments, y)
    for x, g in zip(p, got):
        for at in np.ndindex(x.shape):
            kept = x[at]
            x[at] = kept + 1e-5
            up = loss()
            x[at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            x[at] = kept
            assert g[at] == pytest.approx(slope, rel=2e-2, abs=2e-3)


# ------------------------------------------------------------------- registry


COLUMNS = {
    "p1_found": "src string, group_key string, item_id bigint", "p2_found": "vec_set string, id_a bigint, id_b bigint", "p3_found": "function_id_a bigint, function_id_b bigint",
    "p4_found": "function_id bigint, group_id bigint", "p5_found": "repo string, group_repo string", "p7_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, subject string",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, data, name):
    df = registry.queries()[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    n = df.count()
    assert df.distinct().count() == n
    if name in registry.oracle_sql():
        from pathlib import Path

        import duckdb

        from tools.oracle_check import canon

        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert canon(df.toArrow().to_pandas()).equals(canon(con.execute(registry.oracle_sql()[name]).df()))
