"""A log of versions: what a folder's tables consist of is decided by one file that is put in place at once.

Version files are numbered. A writer prepares its data under names of its own, then
puts the next number in place; that fails if another writer had it first, who then
looks at what has changed and tries again. Readers take the latest version, whose
data files are never changed.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it isn't there."""
    fs, at = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def put_if_absent(spark: SparkSession, path: str, body: bytes) -> bool:
    """Put a whole file in place unless there is one; whether it was put.

    A local rename replaces what is there, so a hard link is made instead, which
    doesn't. Elsewhere the store's rename must refuse to replace, as HDFS does.
    """
    aside = f"{path}.{uuid.uuid4().hex}.aside"
    fs, at = hadoop(spark, aside)
    fs.mkdirs(at.getParent())
    out = fs.create(at, False)
    out.write(body)
    out.close()
    if urlsplit(str(at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())).scheme != "file":
        done = fs.rename(at, hadoop(spark, path)[1])
        if not done:
            fs.delete(at, False)
        return done
    local = urlsplit(str(at.toUri().getPath())).path
    try:
        os.link(local, urlsplit(str(hadoop(spark, path)[1].toUri().getPath())).path)
    except FileExistsError:
        return False
    finally:
        fs.delete(at, False)
    return True


class Log:
    """The versions of a folder; a state is a JSON object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/_log"

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, self.folder) if n.endswith(".json")]

    def read(self, number: int) -> dict:
        fs, at = hadoop(self.spark, f"{self.folder}/{number:010d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, state); (0, {}) before the first version."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, number: int, state: dict) -> bool:
        """Make ``state`` the version ``number``; False if that number is taken."""
        return put_if_absent(self.spark, f"{self.folder}/{number:010d}.json", json.dumps(state, sort_keys=True).encode())

    def forget(self, before: int) -> None:
        """Drop the versions below a number, never the latest."""
        for n in self.numbers()[:-1]:
            if n < before:
                delete(self.spark, f"{self.folder}/{n:010d}.json")
