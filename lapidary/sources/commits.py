"""A numbered log of commits in a folder, on any file system that Spark reaches.

A commit is one small file named by its number. It is written beside the log and moved to its name by a rename that
fails if the name is taken, so of two writers that follow the same commit one wins and the other gets an error. Readers
take the highest number; no clock plays a role. On stores whose rename is not atomic the log needs a file system layer
that makes it so.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME = re.compile(r"(\d{20})\.json")


class CommitConflict(RuntimeError):
    """Another writer has made the commit of this number."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _file_system(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all commits, in order; none where there is no log."""
    files = _file_system(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(_path(spark, folder))]
    return sorted(int(found[1]) for name in names if (found := _NAME.fullmatch(name)))


def folders(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the folders in ``folder`` that begin with ``prefix``, without it, in order."""
    found = _file_system(spark, folder).listStatus(_path(spark, folder))
    names = [status.getPath().getName() for status in found if status.isDirectory()]
    return sorted(name.removeprefix(prefix) for name in names if name.startswith(prefix))


def newest(spark: SparkSession, folder: str) -> int:
    """Number of the newest commit, 0 before the first."""
    return max(numbers(spark, folder), default=0)


def read(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/{number:020d}.json", wholetext=True).first().value)


def commit(spark: SparkSession, folder: str, number: int, record: dict) -> None:
    """Make commit ``number``; an error if it exists, whoever made it."""
    files = _file_system(spark, folder)
    # A leading point hides the file from readers of the folder.
    made, name = _path(spark, f"{folder}/.{uuid.uuid4().hex}"), _path(spark, f"{folder}/{number:020d}.json")
    stream = files.create(made, False)
    try:
        stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = getattr(rename, "NONE")
    try:
        context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(made), files.makeQualified(name), options)
    except Py4JJavaError as error:
        files.delete(made, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise CommitConflict(f"commit {number} exists already") from error
        raise
