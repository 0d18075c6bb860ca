"""Tables that appear whole or not at all.

A table is written aside (``_data/<name>-<attempt>``) and published by one small
file, ``_manifest/<name>.<version>``, that names its folder and is moved into
place by a rename that refuses an existing target.  Readers follow the manifest
of the highest version: they see a whole table or none, whatever a writer that
died has left, and of two writers of one version one is refused.  Old versions
stay readable to whoever has begun with them.

Names may be any strings.  The paths are those of any file system that Spark
reaches; on one whose rename isn't atomic, the manifest isn't either.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


class AlreadyPublished(FileExistsError):
    """The table is there, or another writer has just published it."""


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """Name -> latest version and its manifest's path."""
    fs = _file_system(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_manifest/*.*")) or ()
    out: dict[str, tuple[int, str]] = {}
    for status in found:
        name, _, version = status.getPath().getName().rpartition(".")
        if version.isdigit():
            out[unquote(name)] = max(out.get(unquote(name), (-1, "")), (int(version), status.getPath().toString()))
    return out


def _named(spark: SparkSession, manifest: str) -> tuple[str, str]:
    """Folder and format in a manifest."""
    opened = _file_system(spark, manifest).open(spark._jvm.org.apache.hadoop.fs.Path(manifest))
    try:
        text = bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()
    folder, fmt = text.split("\n")[:2]
    return folder, fmt


def publish(df: DataFrame, path: str, name: str, fmt: str = "parquet", overwrite: bool = False, **options) -> str:
    """Write ``df`` as the next version of ``name``; its folder.  Refused
    (``AlreadyPublished``) if there is one, unless ``overwrite``, and in any case if
    another writer publishes the same version first."""
    spark, path, safe = df.sparkSession, path.rstrip("/"), quote(name, safe="")
    latest = _versions(spark, path).get(name, (-1, ""))[0]
    if latest >= 0 and not overwrite:
        raise AlreadyPublished(f"{name} is published in {path}")
    folder = f"_data/{safe}-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(f"{path}/{folder}")
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    aside, final = (hadoop.Path(f"{path}/{x}") for x in (f"_aside/{uuid.uuid4().hex}", f"_manifest/{safe}.{latest + 1:06d}"))
    fs = _file_system(spark, path)
    fs.mkdirs(final.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(f"{folder}\n{fmt}\n".encode()))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(aside), fs.makeQualified(final), how)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise AlreadyPublished(f"version {latest + 1} of {name} was published by another writer") from None
        raise
    return f"{path}/{folder}"


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables published in ``path``."""
    return sorted(_versions(spark, path))


def read_published(spark: SparkSession, path: str, name: str, schema=None, **options) -> DataFrame | None:
    """The latest version of ``name``, or None."""
    found = _versions(spark, path).get(name)
    if found is None:
        return None
    folder, fmt = _named(spark, found[1])
    reader = spark.read.options(**options).format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(f"{path.rstrip('/')}/{folder}")


def read_all_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest versions of all names, in one table (of one format and schema)."""
    folders = [_named(spark, manifest) for _, manifest in _versions(spark, path).values()]
    if not folders:
        return None
    return spark.read.format(folders[0][1]).load([f"{path.rstrip('/')}/{f}" for f, _ in folders])
