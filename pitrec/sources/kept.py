"""Intermediate tables that many queries read, built once and addressed by what they were made from.

An address is a digest of a name, a configuration and the files of the inputs (path,
length, time of change). A later call with the same address reads the stored table; a
changed input or another configuration has another address. Tables lie below a folder
of the caller, or one in the shared folder that goes with the session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import versions
from .io import scratch, store

_folders: dict[str, str] = {}


def session_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = scratch(spark)
    return _folders[app]


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of each file of an input."""
    fs, root = store(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(path)
    out, found = [], fs.listFiles(root, True)
    while found.hasNext():
        x = found.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return sorted(out)


def address(spark: SparkSession, name: str, config: dict, inputs: list[str]) -> str:
    text = json.dumps([name, config, [files(spark, p) for p in sorted(inputs)]], sort_keys=True)
    return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def stored(spark: SparkSession, name: str, config: dict, inputs: list[str], make: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The table of this address; made and written if it is not there. A writer that dies leaves nothing that is read."""
    table = f"{folder or session_folder(spark)}/{address(spark, name, config, inputs)}"
    if versions.current(spark, table) is None:
        versions.write(make(), table, retries=1)
    return versions.read(spark, table)
