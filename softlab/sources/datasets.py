"""Dataset loaders by name (S3, S4): files in a folder to one table.

Oracle (gold) corpora: (split, text, labels).  Generated corpora: (text,
labels, soft_labels).  A folder holds one Parquet file or folder per split
(``train``, ``validation``, ``test``, ``unsplit``), but for imdb, whose splits
are CSV files, and generated corpora, which are ``data.jsonl``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import clean_text, null_safe_concat
from ..operators.filters import drop_unlabelled, non_blank, valid_vector
from ..operators.reshape import rename_drop, select_by_index
from ..operators.sampling import undersample as cut_to_minority
from .readers import (add_row_id, load_oracle, load_synthetic, read_generated, read_labeled_csv, read_title_content,
                      register_oracle, register_synthetic)

#: The sentiment names of the imdb files, and each generated vector corpus's classes.
IMDB_LABELS = {"negative": 0, "positive": 1}
CLASSES = {"emotion": 6, "agnews": 4, "yahoo": 10}


def _splits(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [
        spark.read.parquet(f"{root}/{n}.parquet").withColumn("split", F.lit(n)) for n in names])


def _shaped(df: DataFrame) -> DataFrame:
    return df.select("split", "text", F.col("labels").cast("int").alias("labels"))


def imdb(spark: SparkSession, root: str) -> DataFrame:
    return read_labeled_csv(spark, {s: f"{root}/{s}.csv" for s in ("train", "test")}, "review", "sentiment", IMDB_LABELS)


def sst(spark: SparkSession, root: str) -> DataFrame:
    """Unlabelled sentences (-1) go; the rest are binarised above .5."""
    df = rename_drop(_splits(spark, root, ("train", "validation", "test")), {"sentence": "text", "label": "labels"}, ["tokens", "tree"])
    return _shaped(drop_unlabelled(df, "labels"))


def subj(spark: SparkSession, root: str) -> DataFrame:
    return _shaped(rename_drop(_splits(spark, root, ("train", "test")), {"label": "labels"}, ["label_text"]))


def emotion(spark: SparkSession, root: str, undersample: bool = False, seed: int = 0) -> DataFrame:
    """Train on the unsplit rows (on request cut to the smallest class), test on
    all split rows."""
    train = rename_drop(_splits(spark, root, ("unsplit",)), {"label": "labels"}, []).withColumn("split", F.lit("train"))
    test = rename_drop(_splits(spark, root, ("train", "validation", "test")), {"label": "labels"}, []).withColumn("split", F.lit("test"))
    if undersample:
        keyed = train.withColumn("_id", F.md5("text"))
        train = cut_to_minority(keyed, "labels", seed, "_id").drop("_id")
    return _shaped(train).unionByName(_shaped(test))


def agnews(spark: SparkSession, root: str) -> DataFrame:
    df = rename_drop(_splits(spark, root, ("train", "test")), {"label": "labels"}, ["label_text"])
    return _shaped(df.withColumn("text", clean_text("text")))


def yahoo(spark: SparkSession, root: str) -> DataFrame:
    """Question title and content as one text, classes from 0; of the training
    rows those that ``subsample_idx.txt`` lists by position."""
    def shaped(df: DataFrame) -> DataFrame:
        return _shaped(df.withColumn("text", null_safe_concat("question_title", "question_content"))
                       .withColumn("labels", F.col("class_index") - 1))
    train = add_row_id(_splits(spark, root, ("train",)))
    listed = add_row_id(spark.read.text(f"{root}/subsample_idx.txt"), "pos").select("pos", F.col("value").cast("double").cast("long").alias("idx"))
    return shaped(select_by_index(train, listed, "row_id")).unionByName(shaped(_splits(spark, root, ("test",))))


def generated_binary(spark: SparkSession, root: str) -> DataFrame:
    """Generated records of a binary corpus: p as soft label, its half-even rounding as hard."""
    df = read_generated(spark, f"{root}/data.jsonl", "binary").filter("label is not null")
    return df.select("text", L.round_half_even("label").cast("int").alias("labels"), L.to_binary_vector("label").alias("soft_labels"))


def generated_vector(name: str):
    k = CLASSES[name]

    def load(spark: SparkSession, root: str) -> DataFrame:
        """Records with ``k`` probabilities (and, but for emotion, a text that isn't
        blank): normalised as soft label, their argmax as hard."""
        path = f"{root}/data.jsonl"
        df = read_title_content(spark, path) if name == "yahoo" else read_generated(spark, path, "vector")
        df = df.filter(valid_vector("label", k))
        if name != "emotion":
            df = df.filter(non_blank("text"))
        return df.select("text", L.argmax("label").cast("int").alias("labels"), L.normalize(F.col("label")).alias("soft_labels"))
    return load


for _name, _loader in {"imdb": imdb, "sst": sst, "subj": subj, "emotion": emotion, "agnews": agnews, "yahoo": yahoo}.items():
    register_oracle(_name, _loader)
    register_synthetic(_name, generated_vector(_name) if _name in CLASSES else generated_binary)

__all__ = ["load_oracle", "load_synthetic", "imdb", "sst", "subj", "emotion", "agnews", "yahoo"]
