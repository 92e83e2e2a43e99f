"""What writers need of a file system, wherever it is: moves, locks, room and small files, by Hadoop's interface."""

from __future__ import annotations

import os
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Bytes that a file system must have left before a table is written there.
LEAST_FREE = 2 << 30


class NoRoom(OSError):
    """Too little is left on a file system to write a table."""


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; what stands at the target is an error."""
    fs, p = _at(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{source} cannot be moved to {target}")


def swap(spark: SparkSession, fresh: str, target: str) -> None:
    """Put a folder in the place of another, which goes once the new one stands there."""
    old = f"{target.rstrip('/')}.replaced-{time.time_ns()}"
    head, _, tail = old.rpartition("/")
    old = f"{head}/_{tail}"  # no scan looks into a folder of such a name
    had = exists(spark, target)
    if had:
        move(spark, target, old)
    move(spark, fresh, target)
    if had:
        remove(spark, old)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or null if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, once: bool = False) -> bool:
    """A small file, replaced in one step; once: only if there is none yet, and whether it was written."""
    fs, p = _at(spark, path)
    if once:
        try:
            fs.mkdirs(p.getParent())
            stream = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True
    part = f"{path}.new-{time.time_ns()}"
    write_text(spark, part, text, once=True)
    fs.delete(p, False)
    move(spark, part, path)
    return True


def require_room(spark: SparkSession, path: str, least: int = LEAST_FREE) -> None:
    """Fail before anything is written where the file system says that less than this is left."""
    fs, p = _at(spark, path)
    left = fs.getStatus(p if fs.exists(p) else None).getRemaining()
    if left < least:
        raise NoRoom(f"{left / 2**30:.2f} GB left at {path}, {least / 2**30:.2f} GB needed")


def _me() -> str:
    return f"{socket.gethostname()}:{os.getpid()}"


def _gone(owner: str) -> bool:
    """Whether a lock's owner was a process of this machine that has ended."""
    host, _, pid = owner.rpartition(":")
    return host == socket.gethostname() and pid.isdigit() and not os.path.exists(f"/proc/{pid}")


@contextmanager
def single_writer(spark: SparkSession, root: str, timeout_s: float = 300.0) -> Iterator[None]:
    """The lock file of a lakehouse: one driver writes at a time, on whatever machine and file system.

    A lock of a process of this machine that is gone is taken over; one of another machine is waited for. The driver that
    holds the lock may take it again.
    """
    path, until, mine = f"{root.rstrip('/')}/_lock", time.monotonic() + timeout_s, False
    while not (mine := write_text(spark, path, _me(), once=True)):
        owner = read_text(spark, path)
        if owner == _me():
            break
        if owner is None:
            continue
        if _gone(owner):
            remove(spark, path)
            continue
        if time.monotonic() > until:
            raise TimeoutError(f"{path} is held by {owner}")
        time.sleep(0.05)
    try:
        yield
    finally:
        if mine:
            remove(spark, path)
