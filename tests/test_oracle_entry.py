"""Registered queries vs the DuckDB oracle on the smallest scale, and the
driver entry point."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
FAST = ["calibration_table_margin", "ece_binary", "ece_top_label", "roc_auc", "average_precision",
        "roc_auc_ovo", "classification_report", "bin_mae", "pearson_spearman", "intra_inter_cosine",
        "multilabel_cosine", "distinct_2", "vocab_size_by_lang", "undersample", "bootstrap_weights",
        "kfold_assign", "sample_n", "validate_vector", "threshold_sweep", "few_shot_prompts",
        "best_margin", "select_by_index", "evaluate_binary", "evaluate_multiclass"]


def _norm(v):
    import math
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)
    out = [tuple(None if (x is pd.NA) else _norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    dpdf = con.sql(E.oracle_sql()[name]).df()
    assert _rows(sdf) == _rows(dpdf)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert [f.name for f in df.schema.fields][:3] == ["bin", "bin_lo", "bin_hi"]


def test_every_query_has_a_function_and_most_an_oracle():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(s) >= 100
