import hashlib
import random

from llm_cases import EDGE, docs
from pyspark.sql import functions as F

from softlab.llm import fingerprint as FP


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["fp"] for r in FP.fingerprints(df, "text", "fp").orderBy("i").collect()]


def lanes(fp):
    out = []
    for x in fp:
        out += [((x >> (16 * k)) & 0xFFFF) for k in range(4)]
    return out


def test_order_does_not_matter_and_sums_add_up(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    p = prints(spark, ["\n".join(x) for x in ((a, b, c), (c, a, b), (a, b), (c,), (a, a, c))] + ["", None, "\n\n"])
    assert p[0] == p[1] and len({tuple(x) for x in p[:5]}) == 4
    assert [(x + y) % 2**16 for x, y in zip(lanes(p[2]), lanes(p[3]), strict=True)] == lanes(p[0])
    assert p[5] == p[6] == p[7] == [0] * (FP.LANES // 4)
    df = spark.createDataFrame([(p[0], p[2], p[3])], "x array<long>, y array<long>, z array<long>")
    r = df.select(FP.insert(F.col("y"), F.col("z")).alias("i"), FP.delete(F.col("x"), F.col("z")).alias("d")).first()
    assert list(r["i"]) == p[0] and list(r["d"]) == p[2]


def test_many_units_run_over_no_field(spark, monkeypatch):
    text = "\n".join(["same"] * 3000)
    whole = prints(spark, [text])[0]
    monkeypatch.setattr(FP, "FIELD", 7)
    assert prints(spark, [text])[0] == whole
    assert {x for x in lanes(whole)} == {3000, 2**16 - 3000}


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def run(spark, rows, buckets):
    return FP.edited(docs(spark, rows), buckets=buckets).collect()


def test_edited_texts_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 3, "".join(rng.choices("ab é🙂\n", k=rng.randrange(90)))) for i in range(60)]
    rng.shuffle(rows)
    for table, buckets in ((rows, 1), (rows, 7), (rows[:1], 4), (EDGE, 3)):
        got = run(spark, table, buckets)
        assert sorted(((r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest()) for r in got), key=repr) \
            == sorted(brute(table), key=repr)
    assert run(spark, [], 4) == []


def test_likeness(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(400)) for _ in range(30)]
    got = run(spark, list(enumerate([*texts, texts[-1], None, ""])), 3)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] < 29:
            assert r["near_edited"] > 0.5 > 0.3 > r["near_next"]
    by = {r["doc_id"]: r for r in got}
    assert by[29]["near_next"] == 1.0 and by[31]["near_next"] == 1.0 and by[30]["near_next"] == 0.0


def test_plan_has_no_python(spark):
    plan = FP.edited(docs(spark, []).filter("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan and "MapIn" not in plan
