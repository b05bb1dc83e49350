"""Versioned tables: data folders that are written once, and a log that names the current one.

A table is a folder with `data/<id>` for each version and `log/<number>` for each
switch. A version is written whole before its log entry is; the entry is made only
if none of its number is there (put if absent), and its last byte is a newline. So a
reader sees an old version or a new one, never a part and never nothing: a writer
that dies earlier leaves the current version as it was, and what it left behind is
named by no entry. Writers that meet each other find the number taken; the later one
raises unless it was told to try again. Rolling back is one more entry with an
older folder.

The file system has to refuse to create a file that exists, as HDFS and local disks
do; object stores need conditional writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .io import outputs, store


class Conflict(RuntimeError):
    """Another writer took the number."""


def entries(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(number, data folder) of each complete log entry, in order."""
    out = []
    for name in outputs(spark, f"{table}/log"):
        if name.isdigit():
            fs, path = store(spark, f"{table}/log/{name}")
            stream = fs.open(path)
            try:
                text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):  # else its writer died
                out.append((int(name), text.strip()))
    return sorted(out)


def current(spark: SparkSession, table: str) -> str | None:
    """The data folder of the current version."""
    found = entries(spark, table)
    return f"{table}/data/{found[-1][1]}" if found else None


def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The current version, or that of a log entry; the frame goes on reading it when others are written."""
    for n, name in reversed(entries(spark, table)):
        if number is None or n == number:
            return spark.read.parquet(f"{table}/data/{name}")
    raise FileNotFoundError(f"{table}: no version" + ("" if number is None else f" {number}"))


def _append(spark: SparkSession, table: str, number: int, name: str) -> None:
    fs, path = store(spark, f"{table}/log/{number:012d}")
    try:
        stream = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            raise Conflict(f"{table}: version {number} is there already") from e
        raise
    try:
        stream.write(bytearray(f"{name}\n".encode()))
    finally:
        stream.close()


def _next(spark: SparkSession, table: str) -> int:
    """The number after all that are taken, also by writers that died."""
    return max((int(n) for n in outputs(spark, f"{table}/log") if n.isdigit()), default=0) + 1


def write(df: DataFrame, table: str, check: Callable[[DataFrame], None] | None = None, retries: int = 0) -> int:
    """Writes a new version, which may be made from the current one, and switches to it; its number.

    `check` gets the written rows and raises to refuse them; the current version then stays.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    number = _next(spark, table)
    df.write.parquet(f"{table}/data/{name}")
    if check is not None:
        check(spark.read.parquet(f"{table}/data/{name}"))
    for left in range(retries, -1, -1):
        try:
            _append(spark, table, number, name)
            return number
        except Conflict:
            if not left:
                raise
            number = _next(spark, table)
    raise AssertionError


def roll_back(spark: SparkSession, table: str, number: int) -> int:
    """Makes the version of an earlier entry current again, as a new entry."""
    for n, name in entries(spark, table):
        if n == number:
            to = _next(spark, table)
            _append(spark, table, to, name)
            return to
    raise FileNotFoundError(f"{table}: no version {number}")


def expire(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Deletes the data folders that none of the last `keep` entries names; their names. No writer may be at work."""
    kept = {name for _, name in entries(spark, table)[-keep:]}
    gone = [name for name in outputs(spark, f"{table}/data") if name not in kept]
    for name in gone:
        fs, path = store(spark, f"{table}/data/{name}")
        fs.delete(path, True)
    return gone
