"""Directory trees on any file system that pyarrow reaches (local and mounted paths, hdfs, s3, gs).

A frontier of folders is expanded in rounds.  In a round every folder is listed by a task, which
goes on into the folders below until it has met ``budget`` entries and hands back the folders that
it has not listed; these are dealt anew.  So a small tree takes one round, and of a large one no
branch, wide or deep, stays with one task.  A local folder is read entry by entry, so a wide one needs
no more memory than a small one; of others pyarrow lists one folder as a whole.  Excluded folders are never listed.  A listing says of
every entry what becomes of it, so nothing is left out silently.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged, staging_folder

# Entries after which a task hands back the folders that are left.
BUDGET = 20_000
LISTED = "path string, size long, status string"
FOLDER, FILE, EXCLUDED, UNREADABLE = "folder", "file", "excluded", "unreadable"


def _opened(root: str):
    """The file system of a root, and the root's path in it."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def _lister(root: str, ignored: frozenset, budget: int):
    """A function over batches of folders, given by their paths below the root."""
    def listed(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            system, base = fs.FileSystem.from_uri(root)
        else:
            system, base = fs.LocalFileSystem(), os.path.abspath(root)
        local = isinstance(system, fs.LocalFileSystem)
        base = base.rstrip("/")

        def met_in(here):
            """``(name, kind, size)`` of the entries of a folder, one at a time where the file
            system allows; a link to a folder could lead back up, and one may lead nowhere."""
            full = f"{base}/{here}".rstrip("/")
            if not local:
                for info in system.get_file_info(fs.FileSelector(full)):
                    kind = {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(
                        info.type, "unreadable")
                    yield info.path.rstrip("/").rsplit("/", 1)[-1], kind, info.size
                return
            with os.scandir(full or "/") as found:
                for entry in found:
                    try:
                        if entry.is_dir():
                            kind = "excluded" if entry.is_symlink() else "folder"
                            yield entry.name, kind, None
                        elif entry.is_file():
                            yield entry.name, "file", entry.stat().st_size
                        else:
                            yield entry.name, "unreadable", None
                    except OSError:
                        yield entry.name, "unreadable", None

        def entries(folder):
            waiting, met = [folder], 0
            while waiting:
                if met >= budget:
                    yield from ((f, None, "folder") for f in waiting)
                    return
                here = waiting.pop()
                met += 1
                try:
                    for name, kind, size in met_in(here):
                        met += 1
                        path = f"{here}/{name}" if here else name
                        if name in ignored:
                            yield path, None, "excluded"
                        elif kind != "folder":
                            yield path, size if kind == "file" else None, kind
                        # Of many folders in one the rest is handed back at once.
                        elif len(waiting) < budget:
                            waiting.append(path)
                        else:
                            yield path, None, kind
                except OSError:
                    yield here, None, "unreadable"

        chunk = []
        for batch in batches:
            for folder in batch["path"]:
                for row in entries(folder):
                    chunk.append(row)
                    if len(chunk) == 10_000:
                        yield pd.DataFrame(chunk, columns=["path", "size", "status"])
                        chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=["path", "size", "status"])

    return listed


def listing(spark: SparkSession, root: str, ignored, partitions: int,
            budget: int | None = None) -> DataFrame:
    """``(path, size, status)``: each file under the root, each excluded entry, and each that could
    not be read; paths are relative to the root."""
    from pyarrow import fs

    system, base = _opened(root)
    if system.get_file_info(base).type == fs.FileType.NotFound:
        raise ValueError(f"no such directory: {root}")
    folder = staging_folder(spark)
    walk = _lister(root, frozenset(ignored), budget or BUDGET)
    frontier, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = staged(frontier.mapInPandas(walk, LISTED), f"{folder}/{len(rounds)}")
        rounds.append(found.filter(F.col("status") != FOLDER))
        frontier = found.filter(F.col("status") == FOLDER).select("path")
        if frontier.isEmpty():
            break
        frontier = frontier.repartition(partitions)
    return reduce(DataFrame.unionByName, rounds)


def contents(paths: DataFrame, root: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """``(path, data, error)`` of files below a root; ``error`` says why one could not be read."""
    columns = ["path", "data", "error"]

    def load(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            system, base = fs.FileSystem.from_uri(root)
        else:
            system, base = fs.LocalFileSystem(), os.path.abspath(root)
        base = base.rstrip("/")
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    with system.open_input_stream(f"{base}/{path}", compression=None) as f:
                        data, error = f.read(), None
                except OSError as e:
                    data, error = None, str(e)
                rows.append((path, data, error))
                size += len(data or b"")
                if size >= batch_bytes:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return paths.select("path").mapInPandas(load, "path string, data binary, error string")
