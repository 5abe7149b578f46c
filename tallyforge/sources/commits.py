"""Numbered commits: small text files, each number written by one writer only, on any file system that Hadoop knows."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class CommitLog:
    """A folder of files named by their number. A file appears whole or not at all, and never twice."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def ages(self) -> dict[int, float]:
        """The number of each commit with the time at which it was written, in seconds."""
        fs, at = self._fs(self.folder)
        found = fs.listStatus(at) if fs.exists(at) else []
        return {int(x.getPath().getName()): x.getModificationTime() / 1000 for x in found if x.getPath().getName().isdigit()}

    def numbers(self) -> list[int]:
        return sorted(self.ages())

    def last(self) -> int:
        """The last number, 0 before the first."""
        return max(self.ages(), default=0)

    def texts(self, numbers: list[int] | None = None) -> dict[int, str]:
        """What the commits say; their numbers go through the driver like the file list of any table."""
        numbers = self.numbers() if numbers is None else numbers
        if not numbers:
            return {}
        rows = self.spark.read.text([f"{self.folder}/{n:012d}" for n in numbers], wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).cast("long"), "value")
        return dict(map(tuple, rows.collect()))

    def publish(self, text: str, number: int) -> bool:
        """Write a commit, unless its number is taken.

        A draft is renamed, which fails if the target is there; on a local file system, whose rename may replace it, a hard
        link is made instead.
        """
        fs, draft = self._fs(f"{self.folder}/draft-{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.folder}/{number:012d}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def forget(self, number: int) -> None:
        fs, at = self._fs(f"{self.folder}/{number:012d}")
        fs.delete(at, False)
