"""Versions of a folder of JSON lines: what is added becomes visible by one step that only one writer can win."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from twinlake.checkpoints import drop_folder

#: The folder of versions within a folder; readers of plain folders pass over it.
WITHIN = "_versions"


class Committed(NamedTuple):
    """Folders to read, the oldest first, and the number of the last version (0: none)."""

    folders: list[str]
    last: int


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> Committed:
    """What readers see of a folder: files directly in it, then each version that has its pointer. Data of a writer
    that was stopped has none and is not seen."""
    path, system = _system(spark, folder)
    within = f"{folder.rstrip('/')}/{WITHIN}"
    if not system.exists(path(within)):
        return Committed([folder], 0)
    own = [s.getPath().getName() for s in system.listStatus(path(folder))]
    folders = [folder] if any(n[0] not in "_." for n in own) else []
    numbers = sorted(int(n) for s in system.listStatus(path(within)) if re.fullmatch(r"\d+", n := s.getPath().getName()))
    for number in numbers:
        stream = system.open(path(f"{within}/{number:08}"))
        try:
            folders.append(f"{within}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}")
        finally:
            stream.close()
    return Committed(folders, numbers[-1] if numbers else 0)


def claim(spark: SparkSession, folder: str, number: int, data: str) -> bool:
    """Make the pointer of a version, with its content, unless it exists: false then. One step each: a hard link on local
    and mounted file systems, elsewhere a rename that does not overwrite, as single as the store's own is."""
    path, system = _system(spark, folder)
    within = f"{folder.rstrip('/')}/{WITHIN}"
    spare, pointer = path(f"{within}/.{uuid.uuid4().hex}"), path(f"{within}/{number:08}")
    out = system.create(spare, False)
    try:
        out.write(bytearray(data.encode()))
    finally:
        out.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(spare.toUri().getPath(), pointer.toUri().getPath())
        else:
            rename_new(spark, spare, pointer)
        return True
    except (FileExistsError, Py4JJavaError):
        if not system.exists(pointer):
            raise
        return False
    finally:
        system.delete(spare, False)


def rename_new(spark: SparkSession, source, target) -> None:
    """Rename a file of a Hadoop store; an error if the target exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    hadoop.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, plain)


def append(spark: SparkSession, folder: str, new_rows: Callable[[list[str]], DataFrame]) -> int:
    """Add ``new_rows(folders read so far)`` as a version; returns its number, 0 if there were no rows. A writer that another
    one forestalls starts anew from what that one has left, so each version holds what its predecessors lack. Stopped
    at any step, the folder reads as before or as after, and the next writer goes on."""
    while True:
        seen = committed(spark, folder)
        _, system = _system(spark, folder)
        first = system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder))
        data = f"data-{uuid.uuid4().hex}"
        place = f"{folder.rstrip('/')}/{WITHIN}/{data}"
        rows = new_rows(seen.folders if first else [])
        rows.write.mode("errorifexists").json(place)
        if spark.read.text(place).isEmpty():
            drop_folder(spark, place)
            return 0
        if claim(spark, folder, seen.last + 1, data):
            return seen.last + 1
        drop_folder(spark, place)
