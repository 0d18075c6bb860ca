"""Readers (S1–S7).  Every reader takes an explicit schema; nothing is
inferred, so a scan never needs an extra pass over the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions.text import null_safe_concat
from .published import read_published
from .writers import EMBEDDINGS

BINARY_RECORD = "label DOUBLE, text STRING, reasoning STRING, _corrupt_record STRING"
VECTOR_RECORD = "label ARRAY<DOUBLE>, text STRING, reasoning STRING, _corrupt_record STRING"
TITLE_CONTENT_RECORD = "title STRING, content STRING, label ARRAY<DOUBLE>, _corrupt_record STRING"


def read_labeled_csv(spark: SparkSession, paths: dict[str, str], text_col: str, label_col: str,
                     mapping: dict[str, int], schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Per-split CSV files with a string label mapped to an int (P2);
    unmapped strings become null.  Returns (split, text, labels).  Quoted
    texts may hold line ends, so a file is one task; ``multi_line=False``
    splits files whose texts have none."""
    schema = schema or f"`{text_col}` STRING, `{label_col}` STRING"
    out = None
    for split, path in paths.items():
        df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
              .option("escape", '"').csv(path))
        df = df.select(F.lit(split).alias("split"), F.col(text_col).alias("text"),
                       L.map_label(label_col, mapping).cast("int").alias("labels"))
        out = df if out is None else out.unionByName(df)
    return out


def read_generated(spark: SparkSession, path: str | Sequence[str], kind: str = "binary",
                   with_row_id: bool = False) -> DataFrame:
    """Generated JSON lines ``{label, text, reasoning}``; malformed lines
    are kept in ``_corrupt_record`` (PERMISSIVE), never dropped silently."""
    schema = {"binary": BINARY_RECORD, "vector": VECTOR_RECORD,
              "title_content": TITLE_CONTENT_RECORD}[kind]
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return add_row_id(df) if with_row_id else df


def add_row_id(df: DataFrame, col: str = "row_id") -> DataFrame:
    """Row ids 0, 1, ... by line position: files in the order of their paths,
    then lines in the order of the file, whatever the split size.

    Rows are counted by (file, block start), which an ordered scan also knows
    of every row; each block's offset is the sum of those before it (one row
    per block, not per line), and rows are numbered within their block."""
    here = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at"))      # orders the rows of one block only
    blocks = here.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    return (here.join(offsets, ["_file", "_block"]).withColumn(col, (F.col("_offset") + inside - 1).cast("long"))
            .drop("_file", "_block", "_at", "_offset"))


def read_embeddings(spark: SparkSession, path: str, labels: DataFrame | None = None, split: str | None = None,
                    feature_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """S3: embeddings as ``array<float>`` from Parquet, those of ``split`` if the
    files have such a column, with ``labels`` (by ``id_col``) attached; the
    published table, if the path has one."""
    own = read_published(spark, path, EMBEDDINGS)
    df = spark.read.parquet(path) if own is None else own
    if split is not None:
        df = df.filter(F.col("split") == split)
    df = df.withColumn(feature_col, F.col(feature_col).cast("array<float>"))
    return df.join(labels, id_col) if labels is not None else df


def read_title_content(spark: SparkSession, path: str) -> DataFrame:
    """text = title + ' ' + content, null-safe (P3 keeps the space)."""
    df = read_generated(spark, path, "title_content")
    return df.withColumn("text", null_safe_concat("title", "content"))


def read_run_sweep(spark: SparkSession, root: str, kind: str = "binary") -> DataFrame:
    """One folder per setting under ``root``; the folder name (a
    ``key=`` prefix is stripped) becomes the ``setting`` column, taken from
    the file-path metadata, so all settings are read in one scan."""
    import re
    df = read_generated(spark, f"{root.rstrip('/')}/*", kind)
    pat = re.escape(root.rstrip("/").split(":", 1)[-1]) + r"/(?:[^/=]+=)?([^/]+)/"
    return df.withColumn("setting", F.regexp_extract(F.col("_metadata.file_path"), pat, 1))


def read_result_tables(spark: SparkSession, files: dict[str, str], flag: str = "CoT",
                       schema: str | None = None) -> DataFrame:
    """Stack result CSVs with a constant flag column per file."""
    out = None
    for value, path in files.items():
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema else r.option("inferSchema", False)
        df = r.csv(path).withColumn(flag, F.lit(value))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# ------------------------------------------------------------ S4 registry
LoaderFn = Callable[..., DataFrame]
_ORACLE: dict[str, LoaderFn] = {}
_SYNTHETIC: dict[str, LoaderFn] = {}


def register_oracle(name: str, fn: LoaderFn) -> None:
    _ORACLE[name] = fn


def register_synthetic(name: str, fn: LoaderFn) -> None:
    _SYNTHETIC[name] = fn


def load_oracle(name: str, *args, **kwargs) -> DataFrame:
    """Dataset registry; an unknown name raises."""
    if name not in _ORACLE:
        raise ValueError(f"unknown oracle dataset {name!r}; known: {sorted(_ORACLE)}")
    return _ORACLE[name](*args, **kwargs)


def load_synthetic(name: str, *args, **kwargs) -> DataFrame:
    if name not in _SYNTHETIC:
        raise ValueError(f"unknown synthetic dataset {name!r}; known: {sorted(_SYNTHETIC)}")
    return _SYNTHETIC[name](*args, **kwargs)
