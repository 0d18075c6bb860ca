"""Remaining inventory queries: P1, F12, S3, S4, S6, S7, S9, W6, W7, M8,
M11, X3, X4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import calibration as C
from ..operators import filters as Fi
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import reshape as RS
from ..operators.ranking import top_k
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import readers as RD
from ..sources import writers as WR
from .q_metrics import _OVR_SRC, _PER_CLASS, _auc_sql
from .q_models import _split
from .registry import query, rounded
from .sqlhelp import bin_rc, dbl

K = X.K_VECTOR


@query("rename_drop", ops="P1 S4", sql="SELECT doc_id AS id, quality AS labels FROM labels")
def rename_drop(spark, sf_dir):
    lab = X.table(spark, sf_dir, "labels")
    return RS.rename_drop(lab, {"doc_id": "id", "quality": "labels"}, ["toxic"])


def _nib(col, i=1):
    return F.substring(F.md5(F.concat(col.cast("string"), F.lit(":shape"))), i, 1)


@query("vector_jsonl_roundtrip", ops="S2 F12 F7 P12", sql="""
SELECT CASE WHEN substr(md5(CAST(id AS VARCHAR) || ':shape'), 1, 1) = '0' THEN 'not_list'
            WHEN substr(md5(CAST(id AS VARCHAR) || ':shape'), 1, 1) = '1' THEN 'bad_length'
            ELSE 'valid' END AS status, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM soft_vector JOIN texts USING (id) GROUP BY 1""")
def vector_jsonl_roundtrip(spark, sf_dir):
    sv = RD.load_synthetic("soft_vector", spark, sf_dir).join(X.texts(spark, sf_dir).select("id", "text"), "id")
    nib = _nib(F.col("id"))
    as_list = F.to_json(F.struct(F.when(nib == "1", F.slice("label", 1, K - 1)).otherwise(F.col("label")).alias("label"), "text"))
    as_scalar = F.to_json(F.struct(F.col("label")[0].alias("label"), "text"))
    path = scratch_path(spark, "vec-jsonl")
    sv.select(F.when(nib == "0", as_scalar).otherwise(as_list).alias("value")).write.text(path)
    back = RD.read_generated(spark, path, "vector")
    lists = Fi.require_list_label(back)
    status = F.when(Fi.valid_vector("label", K) & L.validate_soft_label("label").isNotNull(), F.lit("valid")) \
        .otherwise(F.lit("bad_length"))
    kept = lists.select(status.alias("status"), "text")
    dropped = back.filter(F.col("label").isNull() | F.col("_corrupt_record").isNotNull()) \
        .select(F.lit("not_list").alias("status"), "text")
    return kept.unionByName(dropped).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("run_sweep_roundtrip", ops="S6 S8", sql="""
SELECT event_type AS setting, count(*) AS n,
       round(sum(CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) / 100), 6) AS label_sum,
       CAST(sum(length(props)) AS BIGINT) AS chars
FROM events GROUP BY 1""")
def run_sweep_roundtrip(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    recs = ev.select("event_type", (F.from_json("props", "k INT").getField("k").cast("double") / 100).alias("label"),
                     F.col("props").alias("text"))
    root = scratch_path(spark, "sweep")
    # one folder per setting, written in one job (folders named event_type=...)
    recs.write.partitionBy("event_type").json(root)
    back = RD.read_run_sweep(spark, root)
    return back.groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("label"), 6).alias("label_sum"),
                                       F.sum(F.length("text")).alias("chars"))


MARGINS = [0.0, 0.1, 0.2, 0.3]
_COLS = [f"m{round(m * 100):03d}" for m in MARGINS]


def _wide(sb, inclusive: bool):
    pred = Fi.margin_inclusive if inclusive else Fi.margin_strict
    return sb.groupBy("y").agg(*[F.count_if(pred("p", m)).alias(c) for m, c in zip(MARGINS, _COLS)])


def _wide_sql(inclusive: bool, flag: str) -> str:
    cond = (lambda m: f"p <= {dbl(0.5 - m)} OR p >= {dbl(0.5 + m)}") if inclusive else \
        (lambda m: f"p < {dbl(0.5 - m)} OR p > {dbl(0.5 + m)}")
    cols = ", ".join(f"count(*) FILTER (WHERE {cond(m)}) AS {c}" for m, c in zip(MARGINS, _COLS))
    return f"SELECT y, {cols}, '{flag}' AS cot FROM soft_binary GROUP BY y"


@query("result_tables_roundtrip", ops="S7 U4", sql=f"""
UNPIVOT ({_wide_sql(False, 'false')} UNION ALL {_wide_sql(True, 'true')})
ON {', '.join(_COLS)} INTO NAME margin VALUE n""")
def result_tables_roundtrip(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    base = scratch_path(spark, "results")
    files = {}
    for flag, incl in (("false", False), ("true", True)):
        _wide(sb, incl).write.option("header", True).csv(f"{base}/{flag}")
        files[flag] = f"{base}/{flag}"
    schema = "y INT, " + ", ".join(f"{c} BIGINT" for c in _COLS)
    t = RD.read_result_tables(spark, files, "cot", schema)
    return RS.unpivot(t, ["y", "cot"], _COLS, "margin", "n")


@query("metrics_sink_roundtrip", ops="S9 A15", sql=f"""
WITH b AS (SELECT {bin_rc('p', 10)} AS bin, p, CAST(y AS DOUBLE) AS y FROM soft_binary),
g AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin),
e AS (SELECT (SELECT count(*) FROM b) AS n_total,
             round(coalesce((SELECT sum(CAST(n AS DOUBLE) / (SELECT count(*) FROM b) * abs(acc - conf)) FROM g), 0.0), 9) AS ece)
SELECT 'run-a' AS run_id, n_total, ece FROM e UNION ALL SELECT 'run-b', n_total, ece FROM e""")
def metrics_sink_roundtrip(spark, sf_dir):
    res = rounded(C.ece_binary(X.soft_binary(spark, sf_dir), "y", "p"))
    path = scratch_path(spark, "metrics")
    for run in ("run-a", "run-b", "run-a"):      # a re-run replaces only its own partition
        WR.write_metrics(res, path, run)
    return WR.read_metrics(spark, path).select("run_id", "n_total", "ece")


@query("head_rows", ops="W6", sql="SELECT id, p, y FROM soft_binary ORDER BY id LIMIT 20")
def head_rows(spark, sf_dir):
    return top_k(X.soft_binary(spark, sf_dir), [F.col("id")], 20)


@query("sample_comparisons", ops="W7", sql="""
SELECT conv_id, turn, CASE WHEN length(prompt) > 80 THEN substr(prompt, 1, 80) || '...' ELSE prompt END AS prompt_preview
FROM responses ORDER BY conv_id, turn LIMIT 5""")
def sample_comparisons(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    prev = F.when(F.length("prompt") > 80, F.concat(F.substring("prompt", 1, 80), F.lit("..."))).otherwise(F.col("prompt"))
    return top_k(r.select("conv_id", "turn", prev.alias("prompt_preview")), [F.col("conv_id"), F.col("turn")], 5)


@query("evaluate_registry", ops="X4 A38 (weighted)", sql=_PER_CLASS + f""",
auc AS ({_auc_sql(_OVR_SRC, 'yy', 'p', 'cls')})
SELECT round((SELECT avg(CAST(y = yhat AS DOUBLE)) FROM s), 9) AS accuracy,
       round((SELECT sum(f1 * support) / sum(support) FROM prf2), 9) AS f1_score,
       round((SELECT sum(roc_auc * n_pos) / sum(n_pos) FROM auc), 9) AS roc_auc""")
def evaluate_registry(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    return rounded(M.evaluate(sv, "y", "label", ["accuracy", "f1_score", "roc_auc"], average="weighted"))


@query("linear_probe", ops="M11 X3")
def linear_probe(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    out = []
    for target in ("soft", "hard"):
        m = MD.fit_linear_probe(train, "embedding", probs="soft", label="label", target=target,
                                weight_decay=0.01)
        sc = m.predict_proba(test, "proba").withColumn("pred", L.argmax("proba"))
        out.append(sc.agg(F.lit(target).alias("target"), M.accuracy("label", "pred").alias("accuracy")))
    est = MD.SoftLogisticRegression(C=1.0, features="embedding", probs="soft").fit(train)
    sc = est.predict(test, "pred")
    out.append(sc.agg(F.lit("estimator").alias("target"), M.accuracy("label", "pred").alias("accuracy")))
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), 4)


@query("gce_lr_cv", ops="M8 X3")
def gce_lr_cv(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    est = MD.SoftLogisticRegression(q_gce=0.9, cv=2, Cs=[0.1, 10.0], scoring="accuracy",
                                    features="embedding", probs="soft", seed=2)
    est.fit(train)
    return rounded(est.cv_scores_.withColumn("is_best", F.col("C") == F.lit(est.C_)), 4)
