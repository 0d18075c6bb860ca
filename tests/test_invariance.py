"""Results do not depend on the number of shuffle partitions (1 / 4 / 16)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = ["ece_binary", "roc_auc", "average_precision", "undersample", "distinct_2",
           "intra_inter_cosine", "bootstrap_weights", "kfold_assign", "bin_mae", "pearson_spearman"]


def _collect(spark, name):
    rows = E.queries()[name](spark, SF_SMALL).collect()
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_partition_invariance(spark, name):
    results = []
    try:
        for parts in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            results.append(_collect(spark, name))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
