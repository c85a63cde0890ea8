"""Single files and folders of the store that the session's paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _opened(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all it holds; nothing happens if it is not there."""
    place, store = _opened(spark, path)
    store.delete(place, True)


def remove_uri(spark: SparkSession, uri: str) -> None:
    """The same for an encoded address, as `_metadata.file_path` has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small new file; False, and nothing written, if there is one already. The store decides between two writers."""
    place, store = _opened(spark, path)
    try:
        out = store.create(place, False)
    except Exception as refused:
        if store.exists(place):
            return False
        raise refused
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
