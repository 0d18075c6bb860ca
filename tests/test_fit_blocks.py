"""Fits read blocks of numbers; a pass over them is one small job."""

import numpy as np
from pyspark.sql import functions as F

from softlab.operators.cells import Blocks, Cell, evaluate_cells


def test_pass_is_one_stage(spark):
    rows = [([float(i), 1.0], [0.25, 0.75], i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "x array<double>, p array<double>, f int")
    blocks = Blocks(df, "x", F.col("p"), F.array(F.lit(1.0)), F.array("f"))
    try:
        assert blocks.n == 1000 and blocks.blocks.count() < 100
        sc = spark.sparkContext
        sc.setJobGroup("fit-pass", "one pass")
        got = evaluate_cells(blocks, [Cell(0, 0), Cell()], {0: np.zeros(6), 1: np.zeros(6)}, "gce", 0.7, False)
        jobs = sc.statusTracker().getJobIdsForGroup("fit-pass")
        assert len(jobs) == 1 and len(sc.statusTracker().getJobInfo(jobs[0]).stageIds) == 1
        assert abs(got[0][0] * 2 - got[1][0]) < 1e-9 * got[1][0]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        blocks.close()
