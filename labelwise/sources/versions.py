"""Tables that change under their readers: immutable versions, switched
atomically (S3, S7, S8).

``root/data/<name>`` holds one version, written once and never touched again;
``root/log/<number>`` names the version with that number, and the entry with
the largest number is the current one.  A writer reads the current version,
writes the next one in full, and then claims the next number by one atomic
rename that fails if the number is taken.  So

* a reader meets an old or a new version, never a mixture: a frame it has made
  goes on reading the version it was made from;
* a writer that was overtaken finds its number taken, reads what the other has
  written and makes its version again: no entry is lost;
* a writer that dies leaves a folder that no log entry names; ``prune`` removes
  it after ``grace`` seconds, and all but the last ``keep`` versions.

The store needs a rename that does not replace (HDFS and the like; on a local
disk a hard link does it).  Where it has none, let one job write at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import local_path


class Overtaken(RuntimeError):
    """Another writer has claimed the number first."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, keep: int = 10, grace: float = 86_400.0, fmt: str = "parquet"):
        if keep < 2:
            raise ValueError("keep at least 2 versions: readers may be at the one before")
        self.spark, self.root, self.keep, self.grace, self.fmt = spark, root.rstrip("/"), keep, grace, fmt
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._is_local = self._fs.getUri().getScheme() == "file"

    # --- readers ---

    def versions(self) -> list[Version]:
        """The versions that the log names, oldest first."""
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        out = []
        for name in sorted(n for n in names if n.isdigit()):
            entry = self._entry(name)
            if entry is not None:
                out.append(Version(int(name), f"{self.root}/data/{entry['data']}"))
        return out

    def current(self) -> Version | None:
        found = self.versions()
        return found[-1] if found else None

    def is_current(self, version: Version | None) -> bool:
        return self.current() == version

    def read(self, schema: T.StructType | str | None = None, at: Version | None = None) -> DataFrame:
        """The current version (or that ``at``); without any, an empty frame
        of ``schema``."""
        version = at or self.current()
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"no version at {self.root}")
            return self.spark.createDataFrame([], schema)
        source = self.spark.read.format(self.fmt)
        return (source.schema(schema) if schema is not None else source).load(version.path)

    # --- writers ---

    def write(self, df: DataFrame, base: Version | None, partition_by: tuple[str, ...] = ()) -> Version:
        """``df`` as the version after ``base``; ``Overtaken`` if there is one."""
        data = uuid.uuid4().hex
        df.write.format(self.fmt).partitionBy(*partition_by).save(f"{self.root}/data/{data}")
        number = base.number + 1 if base else 1
        self._claim(number, {"data": data, "time": time.time()})
        self.prune()
        return Version(number, f"{self.root}/data/{data}")

    def update(
        self, make: Callable[[DataFrame], DataFrame], schema: T.StructType | str, tries: int = 20, partition_by: tuple[str, ...] = ()
    ) -> Version:
        """The next version, made from the current one (an empty frame of
        ``schema`` at first); made again when another writer was faster."""
        for _ in range(tries):
            base = self.current()
            try:
                return self.write(make(self.read(schema, base)), base, partition_by)
            except Overtaken:
                continue
        raise Overtaken(f"{self.root}: overtaken {tries} times")

    def replace(self, df: DataFrame, tries: int = 20, partition_by: tuple[str, ...] = ()) -> Version:
        """``df`` as the next version, whatever the current one holds."""
        return self.update(lambda _: df, df.schema, tries, partition_by)

    def prune(self) -> None:
        """Remove all but the last ``keep`` versions, and what no log entry has
        named for ``grace`` seconds."""
        found = self.versions()
        named = {v.path.rsplit("/", 1)[1] for v in found}
        for v in found[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/log/{v.number:020}"), False)
            self._fs.delete(self._path(v.path), True)
        data = self._path(f"{self.root}/data")
        if self._fs.exists(data):
            for f in self._fs.listStatus(data):
                old = time.time() - f.getModificationTime() / 1000 > self.grace
                if old and f.getPath().getName() not in named:
                    self._fs.delete(f.getPath(), True)

    # --- log entries ---

    def _entry(self, name: str) -> dict | None:
        try:
            stream = self._fs.open(self._path(f"{self.root}/log/{name}"))
        except Py4JJavaError as exc:
            if "FileNotFoundException" in exc.java_exception.getClass().getName():
                return None  # pruned meanwhile
            raise
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _claim(self, number: int, entry: dict) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        draft, final = f"{self.root}/log/_{uuid.uuid4().hex}", f"{self.root}/log/{number:020}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._is_local:
                os.link(local_path(draft), local_path(final))
            else:
                self._rename(draft, final)
        except FileExistsError as exc:
            raise Overtaken(f"version {number} of {self.root} is taken") from exc
        finally:
            self._fs.delete(self._path(draft), False)

    def _rename(self, draft: str, final: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            files.rename(self._path(draft), self._path(final), options)
        except Py4JJavaError as exc:
            if "FileAlreadyExistsException" in exc.java_exception.getClass().getName():
                raise FileExistsError(final) from exc
            raise
