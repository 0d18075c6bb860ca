"""Calls of a client in small batches leave a task as one frame."""

import pandas as pd

from softlab.operators import inference as INF


def test_one_frame_for_many_calls(spark, monkeypatch):
    def client(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[len(t)] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 7 else "x" * i) for i in range(50)], "id long, t string").coalesce(1)
    made = []
    plain = type(df).mapInPandas

    def kept(self, run, schema):
        made.append(run)
        return plain(self, run, schema)

    monkeypatch.setattr(type(df), "mapInPandas", kept)
    out = INF.embed(df, "t", client, batch=1, retries=0)
    frames = list(made[0](iter([pd.DataFrame({"id": range(50), "t": ["bad" if i == 7 else "x" * i for i in range(50)]})])))
    assert len(frames) == 1 and len(frames[0]) == 50
    got = {r["id"]: (r["embedding"], r["error"]) for r in out.collect()}
    assert got[7] == (None, "ValueError: no") and all(got[i] == ([float(i)], None) for i in range(50) if i != 7)
