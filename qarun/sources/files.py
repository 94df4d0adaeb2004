"""Paths as Spark, its workers and the driver name them."""

from pyarrow import fs
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, as Spark's own readers see it, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = hadoop_path(spark, path)
    return system.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that it means the same to every process."""
    system, where = hadoop_path(spark, path)
    return system.makeQualified(where).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system for Python workers, for the schemes Arrow has (file, hdfs, s3, gs, abfs)."""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def move_over(system: fs.FileSystem, source: str, target: str) -> None:
    """Move a file to where another attempt of its task may have put the same one."""
    if system.get_file_info(target).type != fs.FileType.NotFound:
        system.delete_file(target)
    system.move(source, target)
