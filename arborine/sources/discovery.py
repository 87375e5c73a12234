"""Source files of a folder as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from fnmatch import translate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborine.functions.languages import EXTENSIONS, IGNORED_DIRS, language_for
from arborine.functions.text import discoverable
from arborine.sources.scratch import Scratch


def selected(paths: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of ``paths`` (path, ...) that discovery takes; patterns match whole paths, ``*`` crosses folders."""
    keep = discoverable(F.col("path"))
    if include:
        keep &= F.greatest(*(F.col("path").rlike(f"^{_java(p)}$") for p in include), F.lit(False))
    for pattern in exclude:
        keep &= ~F.col("path").rlike(f"^{_java(pattern)}$")
    return paths.where(keep)


def _java(pattern: str) -> str:
    return translate(pattern).replace("\\Z", "").replace("\\z", "")


def discover_files(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), batch: int = 64) -> DataFrame:
    """(path, language, content, content_hash, error) of the source files below the shared folder ``root``, with paths relative to it.

    Folders are listed level by level as a Spark job, so one large repository is walked by many tasks, and the files are then
    spread by the hash of their path and read ``batch`` at a time. Ignored and hidden folders are not entered. Spark's own file sources leave out names that
    start with ``_`` or ``.``, which ``__init__.py`` does, so the tasks read the files themselves. A file that cannot be
    read has null content and an error. A folder without source files, or a missing one, gives no rows.
    """
    scratch = Scratch(spark, "discovery")
    folders, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        level = scratch.save(folders.repartition("path").mapInPandas(lambda batches: _listed(root, batches), "path string, folder boolean"), "level")
        files = level.where("not folder").select("path")
        found = files if found is None else found.unionByName(files)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            break

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for paths in batches:
            for at in range(0, len(paths), batch):
                yield pd.DataFrame([_content(root, p) for p in paths["path"][at : at + batch]], columns=["path", "content", "error"])

    wanted = selected(found, include, exclude)
    rows = wanted.repartition("path").mapInPandas(read, "path string, content binary, error string")
    return rows.select("path", language_for(F.col("path")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"), "error")


def _listed(root: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of folders: files that may be source files, and folders to enter."""
    for batch in batches:
        rows = []
        for folder in batch["path"]:
            try:
                entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name not in IGNORED_DIRS and not e.name.startswith("."):
                        rows.append((path, True))
                elif e.name.rpartition(".")[2].lower() in EXTENSIONS:
                    rows.append((path, False))
        yield pd.DataFrame(rows, columns=["path", "folder"]).astype({"path": object, "folder": bool})


def _content(root: str, path: str) -> tuple[str, bytes | None, str | None]:
    try:
        with open(os.path.join(root, path), "rb") as f:
            return path, f.read(), None
    except OSError as e:
        return path, None, f"read error: {e.strerror}"
