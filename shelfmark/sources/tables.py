"""Folders of tables that are replaced as a whole and appended to in parts.

A replacement is written to a new part folder beside the old ones. Only when all of it is there
does the pointer file change, by a rename, so a reader sees the old parts or the new one, and a
write that fails leaves everything as it was. An appended part joins the list of the pointer in the same
way. Parts that the last replacement left behind are deleted with the next one, so that
readers of what was just replaced can finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
PART = "part-"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _child(spark: SparkSession, folder, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder, name)


def _read(spark: SparkSession, files, at) -> str | None:
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def parts(spark: SparkSession, path: str) -> list[str]:
    """The folders that readers of ``path`` should use, the first one from the last replacement."""
    files, folder = _files(spark, path)
    names = _read(spark, files, _child(spark, folder, POINTER))
    if names is None:
        raise FileNotFoundError(f"{path} holds no whole table")
    return [f"{path.rstrip('/')}/{name}" for name in names.split()]


def has_table(spark: SparkSession, folder: str, table: str) -> bool:
    files, at = _files(spark, f"{folder}/{table}")
    return files.exists(at)


def read_parts(spark: SparkSession, folders: list[str], table: str, schema: str) -> DataFrame:
    """A table of all parts. Each part has partition folders of its own, which filters prune."""
    return reduce(DataFrame.unionAll, [spark.read.schema(schema).parquet(f"{f}/{table}") for f in folders])


def _write(spark: SparkSession, path: str, write: Callable[[str], None], keep: list[str]) -> str:
    files, folder = _files(spark, path)
    name = f"{PART}{uuid.uuid4().hex}"
    try:
        write(f"{path.rstrip('/')}/{name}")
        _point(spark, path, [*keep, name])
    except BaseException:
        files.delete(_child(spark, folder, name), True)
        raise
    return name


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Run ``write(new folder)`` and make that folder all of ``path``. One writer at a time."""
    files, folder = _files(spark, path)
    before = (_read(spark, files, _child(spark, folder, POINTER)) or "").split()
    name = _write(spark, path, write, [])
    for status in files.listStatus(folder):
        found = status.getPath().getName()
        if found.startswith(PART) and found != name and found not in before:
            files.delete(status.getPath(), True)


def append_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Run ``write(new folder)`` and add that folder to the parts of ``path``. One writer at a time."""
    _write(spark, path, write, [p.rsplit("/", 1)[1] for p in parts(spark, path)])


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    """Let readers use these parts from now on."""
    files, folder = _files(spark, path)
    jvm = spark._jvm.org.apache.hadoop.fs
    fresh = files.makeQualified(_child(spark, folder, f"{POINTER}-{uuid.uuid4().hex}"))
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(" ".join(names).encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    whole = jvm.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    whole.rename(fresh, files.makeQualified(_child(spark, folder, POINTER)), options)


def swap_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Run ``write(other folder)`` and let that folder take the place of the plain table at ``path``.

    A write that fails leaves the old table as it was. The swap itself is two renames; should the
    driver be lost between them, the old table is beside, under the name that ends in ``-before``.
    """
    name = path.rstrip("/")
    files, folder = _files(spark, name)
    fresh, before = (spark._jvm.org.apache.hadoop.fs.Path(f"{name}-{uuid.uuid4().hex}{end}") for end in ("-next", "-before"))
    try:
        write(fresh.toString())
    except BaseException:
        files.delete(fresh, True)
        raise
    old = files.exists(folder)
    if old and not files.rename(folder, before):
        files.delete(fresh, True)
        raise OSError(f"{path} cannot be moved aside")
    if not files.rename(fresh, folder):
        if old:
            files.rename(before, folder)
        raise OSError(f"{path} cannot be replaced")
    if old:
        files.delete(before, True)
