import random
import re

from llm_cases import EDGE, docs

from softlab.llm import substring


def brute(rows, n):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k:k + n])
            if x in seen:
                gone[k:k + n] = [True] * n
            seen.add(x)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def run(spark, rows, n, **kw):
    done = substring.repeats(docs(spark, rows), n=n, **kw)
    return done.collect()


def same(got, want):
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == sorted(want, key=repr)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    passages = [[rng.choice("abcd") + str(rng.randrange(9)) for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages)[rng.randrange(4):] if rng.random() < .6 else [rng.choice("xyz") for _ in range(rng.randrange(30))]
        rows.append((i * 7 % 150, rng.choice([" ", "\n", "  "]).join(w)))
    for n in (2, 5, 6, 20):
        same(run(spark, rows, n), brute(rows, n))


def test_edge_rows(spark):
    rows = [r for r in EDGE if r[0] != 6]
    same(run(spark, rows, 20), brute(rows, 20))
    got = run(spark, [(6, "tie tie tie"), (6, "tie tie tie")], 3)
    assert sorted(r["n_removed"] for r in got) == [0, 3]
    assert got[0]["bucket"] == 1 and got[0]["_text"] == "y"     # other columns are carried
    assert run(spark, [], 20) == []


def test_cut_texts_keep_what_stays(spark):
    p = " ".join(f"p{i}" for i in range(6))
    got = {r["doc_id"]: r for r in run(spark, [(1, f"a\n{p}  b"), (2, f" c {p}\n\nd  e "), (3, None)], 5, keep="text")}
    assert got[1]["kept"] == f"a\n{p}  b" and got[2]["kept"] == " c d  e " and got[3]["kept"] == ""
    assert [(s["start"], s["end"]) for s in got[2]["removed"]] == [(1, 7)]
