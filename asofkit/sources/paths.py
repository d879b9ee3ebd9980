"""File-system checks that work on any Hadoop-compatible store."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs_and_path(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs_and_path(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def delete_tree(spark: SparkSession, path: str) -> bool:
    fs, target = _fs_and_path(spark, path)
    return fs.delete(target, True)


def touch(spark: SparkSession, path: str) -> None:
    fs, target = _fs_and_path(spark, path)
    fs.create(target, True).close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs_and_path(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file with its whole content unless it exists; of several callers one gets true."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, target = _fs_and_path(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")  # never over another file
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as refused:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" not in refused.java_exception.toString():
            raise
        return False
    return True
