"""Publishing a table as a whole: written aside, marked complete, then put in place by renaming folders.

A failing writer leaves the old table as it was. A job that is lost between the two renames leaves no table
at the place, but the complete new one beside it and the old one as backup; ``recover`` then finishes the
work. Renames are the file system's, so this needs one that renames folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

COMPLETE = "_complete"


class Folders:
    """The few folder operations needed, on the file system of ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)

    def mark(self, path: str) -> None:
        self._files.create(self._path(path), True).close()

    def move(self, path: str, to: str) -> None:
        self._files.mkdirs(self._path(to).getParent())
        if not self._files.rename(self._path(path), self._path(to)):
            raise OSError(f"cannot move {path} to {to}")


def _beside(path: str, kind: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{kind}-{name}"


def recover(spark: SparkSession, path: str, backup: str | None = None) -> None:
    """Finishes what a lost ``publish`` of ``path`` left: a complete table goes in place, a partial one is dropped."""
    folders, aside = Folders(spark, path), _beside(path, "next")
    if not folders.exists(f"{aside}/{COMPLETE}"):
        folders.delete(aside)
        return
    _swap(folders, path, aside, backup or _beside(path, "old"))
    if backup is None:
        folders.delete(_beside(path, "old"))


def _swap(folders: Folders, path: str, aside: str, backup: str) -> None:
    if folders.exists(path):
        if folders.exists(backup):
            raise FileExistsError(f"backup {backup} exists")
        folders.move(path, backup)
    folders.move(aside, path)


def publish(spark: SparkSession, write: Callable[[str], None], path: str, backup: str | None = None) -> None:
    """Replaces ``path`` by what ``write(folder)`` writes; the old table stays as ``backup``, if one is named.

    ``write`` may read the table it replaces. An existing backup is an error before anything is written.
    """
    recover(spark, path, backup)
    folders, aside, old = Folders(spark, path), _beside(path, "next"), backup or _beside(path, "old")
    if backup is None:
        folders.delete(old)
    elif folders.exists(backup):
        raise FileExistsError(f"backup {backup} exists")
    write(aside)
    folders.mark(f"{aside}/{COMPLETE}")
    _swap(folders, path, aside, old)
    if backup is None:
        folders.delete(old)
