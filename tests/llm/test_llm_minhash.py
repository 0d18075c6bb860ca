import random
import re

from llm_cases import EDGE, docs

from softlab.llm import minhash
from softlab.llm.graph import components


def brute(rows, k, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def run(spark, rows, k=4):
    got = minhash.near_duplicates(docs(spark, rows), shingle=k).collect()
    return [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got]


def test_chains_copies_and_borders_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for base in range(25):
        w = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows) * 13 % 1009, " ".join(w).upper() if rng.random() < .2 else " ".join(w)))
            w = list(w)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    assert len({r[0] for r in rows}) == len(rows)
    assert sorted(run(spark, rows)) == sorted(brute(rows, 4))


def test_edge_rows(spark):
    rows = [r for r in EDGE if r[0] is not None]
    assert sorted(set(run(spark, rows))) == sorted(set(brute([r for i, r in enumerate(rows) if r not in rows[:i]], 4)))
    assert len(run(spark, rows)) == len(rows)
    assert (None, 4, None, True) in run(spark, EDGE)
    assert run(spark, []) == []


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 5000: 200}


def test_rows_of_one_id_and_different_texts_are_one_document(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (5, a + " tail"), (6, b + " tail"), (7, b + " other"), (9, " ".join(f"c{i}" for i in range(40)))]
    assert {(r[0], r[2], r[3]) for r in run(spark, rows)} == {(1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (9, 9, True)}


def test_ids_of_any_type(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([("b", t), ("a", t + " x"), ("c", "something else"), (None, t)], "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True)}


def test_random_components_against_union_find(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: find(i) for i in range(400) if find(i) != i}
