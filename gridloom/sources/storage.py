"""Folders and files that driver and executors share, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def store(path: str):
    """(file system, path there) of a path or URI, with range reads and streamed writes."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The file ``path``, or all files below the folder ``path`` with one of the endings, sorted; hidden ones are left out."""
    from pyarrow import fs

    at, root = store(path)
    if at.get_file_info(root).type == fs.FileType.File:
        return [path]
    found = at.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings)]
    inner = [n[len(root.rstrip("/")) + 1 :] for n in names]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(inner) if not any(p.startswith(("_", ".")) for p in n.split("/"))]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; data sources are found there by name."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_sources_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gridloom-")), "gridloom_sources.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(root)))
    sc.addPyFile(target)
    sc._gridloom_sources_shipped = True
