"""Several tables at once: a manifest names the folder of each, and one rename swaps all of them.

A store is a folder with ``tables/<name>/<version>`` and ``manifests/<n>``. A commit writes the changed tables into new
folders, then the next manifest beside the others, and renames it into place; the rename refuses if somebody else's is
there, so of two writers that read the same version one is told so. Readers take the newest manifest and read the
folders that it names, which nobody changes: they see all of a commit or nothing of it. A crash before the rename leaves
folders that no manifest names; :func:`Store.clean` removes those and old versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Digits of a manifest's number, so that names sort as numbers do.
DIGITS = 12


class Conflict(Exception):
    """Somebody else has committed since the tables were read."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of one version; ``version`` 0 has none."""

    version: int
    folders: dict[str, str]
    tables: dict[str, DataFrame]


class Store:
    """A folder of tables that change together, in any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._files.open(self._path(f"manifests/{version:0{DIGITS}d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> Snapshot:
        """The tables of the newest version, or of an older one that hasn't been cleaned away."""
        n = (self._versions() or [0])[-1] if version is None else version
        folders = self._folders(n)
        return Snapshot(n, folders, {name: self.spark.read.parquet(f"{self.root}/{folder}") for name, folder in folders.items()})

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables into new folders, which no reader sees yet."""
        folders = {name: f"tables/{name}/{uuid.uuid4().hex}" for name in tables}
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/{folders[name]}")
        return folders

    def publish(self, base: Snapshot, folders: dict[str, str]) -> int:
        """Make written folders the next version after ``base``; its number. Tables that aren't named stay as they
        are. Conflict if ``base`` isn't the newest version any more."""
        if (self._versions() or [0])[-1] != base.version:
            raise Conflict(f"version {base.version} is no longer the newest")
        self._files.mkdirs(self._path("manifests"))
        part = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(part, False)
        out.write(bytearray(json.dumps(base.folders | folders).encode()))
        out.close()
        target = self._path(f"manifests/{base.version + 1:0{DIGITS}d}")
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)  # so it never overwrites
        try:
            self._hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(part, target, none)
        except Exception as e:
            self._files.delete(part, False)
            if self._files.exists(target):
                raise Conflict(f"version {base.version + 1} is somebody else's") from e
            raise
        return base.version + 1

    def commit(self, base: Snapshot, tables: dict[str, DataFrame]) -> int:
        """Write changed tables and publish them together. What was written is deleted if that is refused."""
        folders = self.write(tables)
        try:
            return self.publish(base, folders)
        except Conflict:
            for folder in folders.values():
                self._files.delete(self._path(folder), True)
            raise

    def clean(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep``, and all folders that none of those names; how many folders. Only
        while nobody writes or reads an older version."""
        versions = self._versions()
        kept = versions[-keep:]
        for n in set(versions) - set(kept):
            self._files.delete(self._path(f"manifests/{n:0{DIGITS}d}"), False)
        named = {folder for n in kept for folder in self._folders(n).values()}
        gone = 0
        tables = self._path("tables")
        for table in self._files.listStatus(tables) if self._files.exists(tables) else []:
            for folder in self._files.listStatus(table.getPath()):
                name = f"tables/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in named:
                    self._files.delete(folder.getPath(), True)
                    gone += 1
        return gone
