"""Small control files on any file system that Spark reaches, and copies of data files by the executors.

Paths without a scheme or with ``file:`` are POSIX: creation is exclusive and
replacement atomic. Other schemes go through Spark's Hadoop layer, where creation
fails if the file is there and a rename moves the finished file into place.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from loomstone.workers import reachable

LEASE_SECONDS = 60.0


class Busy(RuntimeError):
    """Someone else holds a lock whose lease hasn't run out."""


class Files:
    """Text files under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.local = "://" not in self.root or self.root.startswith("file:")
        self.base = Path(self.root.removeprefix("file://").removeprefix("file:")) if self.local else None

    def _hadoop(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def path(self, name: str) -> str:
        """The full path of a name, for Spark."""
        return f"{self.root}/{name}"

    def read(self, name: str) -> str | None:
        """The text of a file; None if there is none."""
        if self.local:
            path = self.base / name
            return path.read_text() if path.exists() else None
        system, target = self._hadoop(name)
        if not system.exists(target):
            return None
        stream = system.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if it is there already."""
        if self.local:
            path = self.base / name
            path.parent.mkdir(parents=True, exist_ok=True)
            own = path.with_name(f".{uuid.uuid4().hex}")
            own.write_text(text)
            try:
                os.link(own, path)
                return True
            except FileExistsError:
                return False
            finally:
                own.unlink()
        system, target = self._hadoop(name)
        if system.exists(target):
            return False
        stream = system.create(target, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Write a file in place of any that is there."""
        if self.local:
            path = self.base / name
            path.parent.mkdir(parents=True, exist_ok=True)
            own = path.with_name(f".{uuid.uuid4().hex}")
            own.write_text(text)
            os.replace(own, path)
            return
        system, target = self._hadoop(name)
        stream = system.create(target, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        """Remove a file or a folder, if it is there."""
        if self.local:
            path = self.base / name
            shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
            return
        system, target = self._hadoop(name)
        system.delete(target, True)

    def exists(self, name: str) -> bool:
        if self.local:
            return (self.base / name).exists()
        system, target = self._hadoop(name)
        return bool(system.exists(target))

    def names(self, folder: str, suffix: str = "") -> list[str]:
        """Names under a folder at any depth, relative to it, in order; hidden ones are left out."""
        if self.local:
            base = self.base / folder
            found = [str(p.relative_to(base)) for p in base.rglob(f"*{suffix}") if p.is_file()] if base.exists() else []
        else:
            system, target = self._hadoop(folder)
            found, listed = [], system.listFiles(target, True) if system.exists(target) else None
            above = target.toUri().getPath().rstrip("/") + "/"
            while listed is not None and listed.hasNext():
                found.append(listed.next().getPath().toUri().getPath().removeprefix(above))
            found = [n for n in found if n.endswith(suffix)]
        return sorted(n for n in found if not any(part.startswith(".") for part in n.split("/")))

    def folders(self, folder: str) -> list[str]:
        """Names of the folders right under a folder."""
        if self.local:
            base = self.base / folder
            return sorted(p.name for p in base.iterdir() if p.is_dir()) if base.exists() else []
        system, target = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()) if system.exists(target) else []

    @contextmanager
    def locked(self, name: str, owner: str | None = None, seconds: float = LEASE_SECONDS, wait: float = 10.0) -> Iterator[str]:
        """Hold a lock file with an owner and a lease; one whose lease ran out is taken over."""
        owner, until = owner or uuid.uuid4().hex, time.time() + wait
        while not self.create(name, json.dumps({"owner": owner, "until": time.time() + seconds})):
            held = json.loads(self.read(name) or "{}")
            if held.get("until", 0) < time.time():
                self.delete(name)
                continue
            if time.time() > until:
                raise Busy(f"{name} is held by {held.get('owner')}")
            time.sleep(0.05)
        try:
            yield owner
        finally:
            if json.loads(self.read(name) or "{}").get("owner") == owner:
                self.delete(name)


def copy_files(spark: SparkSession, pairs: list[tuple[str, str]]) -> int:
    """Copy files (source, target) byte by byte in parallel tasks; the number copied.

    A task writes under a name of its own and moves the finished copy into place,
    so a task that is run again does no harm.
    """
    if not pairs:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True):
                (from_system, from_path), (to_system, to_path) = fs.FileSystem.from_uri(_uri(source)), fs.FileSystem.from_uri(_uri(target))
                folder, _, name = to_path.rpartition("/")
                to_system.create_dir(folder, recursive=True)
                own = f"{folder}/.{uuid.uuid4().hex}-{name}"
                fs.copy_files(from_path, own, source_filesystem=from_system, destination_filesystem=to_system)
                to_system.move(own, to_path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    tasks = min(len(pairs), spark.sparkContext.defaultParallelism)
    reachable(spark)
    listed = spark.createDataFrame(pairs, "source string, target string").repartition(tasks)
    return listed.mapInArrow(run, "n long").groupBy().sum("n").first()[0]


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
