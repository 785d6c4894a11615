"""Folders of the store that a path names: listing, and output that appears as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def address(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """Scheme, authority and plain path that the session's configuration gives a path."""
    store, place = _place(spark, path)
    where = store.makeQualified(place).toUri()
    return where.getScheme() or "", where.getAuthority() or "", where.getPath()


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    store, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    store, place = _place(spark, path)
    store.delete(place, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    store, place = _place(spark, old)
    if not store.rename(place, _place(spark, new)[1]):
        raise OSError(f"cannot move {old} to {new}")


def write_whole(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` fills a folder beside ``path``, which takes its place once it is complete.

    If it fails, what ``path`` held stays as it was. The old folder goes last, so a crash
    between the two moves leaves both, under names that begin with ``path``.
    """
    path = path.rstrip("/")
    fresh, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("writing", "old"))
    try:
        write(fresh)
    except BaseException:
        remove(spark, fresh)
        raise
    had = exists(spark, path)
    if had:
        move(spark, path, old)
    move(spark, fresh, path)
    if had:
        remove(spark, old)
