"""softlab: DataFrame operators for soft-labelled text corpora on Spark.

Every operator is a pure function ``DataFrame -> DataFrame`` (or a Column
builder).  Nothing here owns a global session; callers pass DataFrames in.

Sub-packages
------------
functions   Column-expression builders (label algebra, text, vectors).
sources     Readers, writers and the fixture views over the driver tables.
operators   Filters, binning/calibration, ranks, metrics, diversity,
            similarity, sampling, models, experiments, prompts.
streaming   Structured Streaming ingest and running progress.
plans       The query registry used by ``__spark_entry__`` and ``bench.py``.
"""

__version__ = "0.1.0"
