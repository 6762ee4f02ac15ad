"""Numbered commits in a folder: each appears whole or not at all, and one writer wins each number.

A commit is a small JSON file ``_commits/NNNNNNNNNNNN``.  It is written under another name and
then renamed, which fails if the number is taken; so a reader never meets half of one, and
the second of two writers that began from the same commit is told so.  Data folders are
written before and named by the commit; those that no commit names are leavings of stopped
writers, and do no harm.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class StateError(RuntimeError):
    """Saved state is there but cannot be read; taking it for empty would announce everything again."""


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


class Files:
    """The file operations that commits need, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, path: str) -> list[tuple[str, int]]:
        """(name, milliseconds of the last change) of what a folder holds; none if there is no such folder."""
        fs = self._fs(path)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(self._path(path))] if fs.exists(self._path(path)) else []

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Give a file its final name; False if something has that name already."""
        fs = self.jvm.org.apache.hadoop.fs
        option = getattr(fs, "Options$Rename")
        options = self.gateway.new_array(option, 1)
        options[0] = option.NONE
        whole = self._fs(new).makeQualified(self._path(new))
        try:
            fs.FileContext.getFileContext(whole.toUri(), self.conf).rename(self._fs(old).makeQualified(self._path(old)), whole, options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


class Commits:
    """The commits of one folder."""

    def __init__(self, spark: SparkSession, path: str, files: Files | None = None) -> None:
        self.path, self.files = path, files or Files(spark)
        self.folder = f"{path}/_commits"

    def numbers(self) -> list[int]:
        return sorted(int(n) for n, _ in self.files.names(self.folder) if n.isdigit())

    def read(self, number: int) -> dict:
        try:
            return json.loads(self.files.read(f"{self.folder}/{number:012d}"))
        except ValueError as e:
            raise StateError(f"commit {number} in {self.path} cannot be read") from e

    def newest(self) -> tuple[int, dict] | None:
        """Number and content of the highest commit; None if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def add(self, number: int, content: dict) -> None:
        draft = f"{self.folder}/.{number:012d}-{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(content))
        if not self.files.rename(draft, f"{self.folder}/{number:012d}"):
            self.files.delete(draft)
            raise Conflict(f"commit {number} in {self.path} was made by another writer")
