"""Plan-shape guards: no cartesian / nested-loop joins anywhere, filters and
column pruning reach the Parquet scan."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from softlab.plans import REGISTRY
from tests.conftest import SF_SMALL

# queries that run jobs while building their result (fits, streams, writes)
EAGER = {"soft_lr_summary", "soft_lr_cv_best", "standard_lr_cv", "gce_lr_summary", "gce_lr_cv",
         "gold_judge_alignment", "platt", "margin_sweep", "subset_curve", "entropy_sweep",
         "oracle_relabel", "refine_labels", "refine_converge", "influence_topk", "linear_probe",
         "stream_ingest", "stream_progress", "generated_jsonl_roundtrip", "csv_labeled_roundtrip",
         "vector_jsonl_roundtrip", "run_sweep_roundtrip", "result_tables_roundtrip",
         "metrics_sink_roundtrip"}
LAZY = sorted(n for n in REGISTRY if n not in EAGER)


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pushdown_and_pruning(spark):
    plan = _plan(E.queries()["margin_strict"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan
    plan = _plan(E.queries()["roc_auc_big"](spark, SF_SMALL))
    assert "l_extendedprice" not in plan     # only the needed lineitem columns are read
