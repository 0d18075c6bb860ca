import random
import re

from llm_cases import EDGE, docs

from softlab.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, bench, n):
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, items = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k:k + size])):
                    hit[k:k + size] = [True] * size
                    items |= found
        out.append((i, len(w), sum(hit), sorted(items)))
    return out


def run(spark, rows, bench, n=10, **kw):
    items = spark.createDataFrame(bench, "item_id long, text string")
    return decontam.contamination(docs(spark, rows), items, window=n, **kw).collect()


def same(got, want):
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def case(seed):
    rng = random.Random(seed)
    some = [[rng.choice("abc") + str(rng.randrange(6)) for _ in range(rng.randrange(1, 25))] for _ in range(12)]
    bench = [(i, " ".join(w)) for i, w in enumerate(some)] + [(3, "Extra Text of item three"), (20, " ".join(some[0])), (21, None), (22, "?!")]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(5)):
            own = rng.choice(some)
            a = rng.randrange(len(own))
            w += own[a:] if rng.random() < .5 else own
            w += [rng.choice("xy") for _ in range(rng.randrange(4))]
        rows.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    return rows, bench


def test_random_texts_against_brute_force(spark, monkeypatch):
    rows, bench = case(2)
    for n in (10, 3, 1):
        same(run(spark, rows, bench, n), brute(rows, bench, n))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)      # several passes give the same
    same(run(spark, rows, bench), brute(rows, bench, 10))


def test_edge_rows_and_empty_tables(spark):
    bench = [(1, "a row without id has words too"), (2, "w0x0 w1x0 w2x0")]
    same(run(spark, EDGE, bench), brute(EDGE, bench, 10))
    same(run(spark, EDGE, []), brute(EDGE, [], 10))
    assert run(spark, [], bench) == []


def test_longest_match_and_its_places(spark):
    item = " ".join(f"q{i}" for i in range(30))
    text = "x " + " ".join(f"q{i}" for i in range(4, 25)) + " y " + " ".join(f"q{i}" for i in range(12))
    got = run(spark, [(1, text)], [(9, item)], carry=("lang", "key"))[0]
    assert [tuple(m) for m in got["matches"]] == [("9", 1, 4, 21)]
    assert got["n_hit"] == 21 + 12 and got["lang"] == "en" and got["key"] == "k"


def test_items_without_id_are_searched_but_not_named(spark, monkeypatch):
    bench = [(None, "one two three four"), (5, "five six seven"), (None, "five six seven"), (None, None)]
    rows = [(1, "x one two three four y"), (2, "five six seven"), (3, "none of them")]
    for _ in range(2):
        got = {r["doc_id"]: r for r in run(spark, rows, bench, 3)}
        assert [(got[i]["n_hit"], list(got[i]["items"]), got[i]["contaminated"]) for i in (1, 2, 3)] == [(4, [], True), (3, ["5"], True), (0, [], False)]
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
