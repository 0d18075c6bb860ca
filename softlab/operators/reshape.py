"""Joins, alignment and reshaping.

The reference aligns files by row position; here every alignment is an
equi-join on a stored row id, with the reference's count checks kept as
in-plan guards (``raise_error`` / scalar subqueries), never as a collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scalar_of

ColumnOrName = Column | str


def _count(df: DataFrame) -> Column:
    return scalar_of(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")


def align_embeddings(texts: DataFrame, emb: DataFrame, key: str = "id") -> DataFrame:
    """Text rows <-> embedding rows on the row id.  A row present on only
    one side fails the job (the reference asserts equal lengths); the check
    is a filter predicate, so Catalyst cannot prune it away."""
    t = texts.withColumn("_t", F.lit(True))
    e = emb.withColumn("_e", F.lit(True))
    j = t.join(e, key, "full_outer")
    bad = F.col("_t").isNull() | F.col("_e").isNull()
    guard = F.when(bad, F.raise_error(F.concat(F.lit("text/embedding row mismatch at id "),
                                               F.col(key).cast("string")))).otherwise(F.lit(True))
    return j.filter(guard).drop("_t", "_e")


def pair_prompt_response(prompts: DataFrame, responses: DataFrame, key: Sequence[str],
                         text: str = "response") -> DataFrame:
    """Prompts paired with their responses by id; empty responses dropped."""
    from .filters import non_blank
    return prompts.join(responses, list(key)).filter(non_blank(text))


def pair_labels(original: DataFrame, judged: DataFrame, key: str = "id") -> DataFrame:
    """Inner join of original and judged labels; if the two inputs have
    different row counts the result is empty (the reference's guard)."""
    j = original.join(judged, key)
    return j.filter(_count(original) == _count(judged))


def select_by_index(df: DataFrame, idx: DataFrame, row_id: str = "id",
                    idx_col: str = "idx", pos_col: str = "pos") -> DataFrame:
    """Rows at the listed positions; duplicates repeat (an inner join,
    not a semi join), ordered by the position in the index file."""
    return idx.join(df, idx[idx_col] == df[row_id]).drop(idx_col).orderBy(pos_col)


CONFIG_ROWS = 10_000     # configurations that may be broadcast


def lookup_config(df: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """Attach dataset configuration (template, K, class names).  A config
    of at most ``CONFIG_ROWS`` rows is broadcast; a longer one is joined as
    the planner sees fit.  The key must be a data column: a literal key is
    constant-folded and would turn the lookup into a nested-loop join."""
    small = config.limit(CONFIG_ROWS + 1).count() <= CONFIG_ROWS
    return df.join(F.broadcast(config) if small else config, key, "left")


def experiment_grid(base: DataFrame, **axes: Sequence) -> DataFrame:
    """The parameter grid as successive explodes of literal arrays (no
    join): margins x ratios x trials x Cs x folds."""
    out = base
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Stack splits with a ``split`` column."""
    out = None
    for name, df in splits.items():
        d = df.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def append_batch(train: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a new batch (columns may differ; missing ones are null)."""
    return train.unionByName(batch, allowMissingColumns=True)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            var: str = "variable", val: str = "value") -> DataFrame:
    """U4: wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)


def pivot_best(df: DataFrame, ids: Sequence[str], var: str, val: str,
               levels: Sequence) -> DataFrame:
    """Long -> wide plus the best level per id (max value, first level on
    ties), in one aggregation: a conditional ``first`` per known level and a
    ``max_by`` over (value, -level)."""
    cols = [F.first(F.when(F.col(var) == F.lit(lv), F.col(val)), ignorenulls=True).alias(str(lv))
            for lv in levels]
    return df.groupBy(*ids).agg(
        *cols,
        F.max_by(F.col(var), F.struct(F.col(val), -F.col(var).cast("double"))).alias(f"best_{var}"),
        F.max(val).alias(f"best_{val}"))


# fixed values: dataset configuration (class names in label order, K)
DATASETS = [
    ("imdb", 2, ["negative", "positive"]),
    ("sst", 2, ["negative", "positive"]),
    ("subj", 2, ["objective", "subjective"]),
    ("emotion", 6, ["sadness", "joy", "love", "anger", "fear", "surprise"]),
    ("agnews", 4, ["World", "Sports", "Business", "Sci/Tech"]),
]


def dataset_config(spark) -> DataFrame:
    """One row per dataset (name, K, class names, system and human
    templates); bounded by the number of datasets, so ``lookup_config`` may
    broadcast it."""
    from .prompts import TEMPLATES
    return spark.createDataFrame([(n, k, c, *TEMPLATES[n]) for n, k, c in DATASETS],
                                 "dataset string, k int, class_names array<string>, "
                                 "system_template string, human_template string")


def rename_drop(df: DataFrame, renames: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename and drop columns (e.g. sentence -> text, label -> labels)."""
    return df.withColumnsRenamed(renames).drop(*drop)


def rename_by_regex(df: DataFrame, prefix: str) -> DataFrame:
    """Strip a prefix from column names and lower-case them."""
    import re
    return df.toDF(*[re.sub(rf"^{re.escape(prefix)}", "", c).lower() for c in df.columns])
