"""Digests of named files, read in chunks by the tasks.

A file is never a value of a row: a task opens it, feeds one chunk after the other to the digest and
keeps three short fields. Files that no row names are not listed and not opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from triagelake.session import spread
from triagelake.sources.folders import address

CHUNK_BYTES = 4 << 20
#: Schemes that the store's Java and Arrow clients call differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _store(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified folder, and what its paths begin with there."""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), ""
    store, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")
    return store, base.rstrip("/")


def digest_of(store: pafs.FileSystem, path: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, str] | None:
    """Bytes and SHA-256 of a file as it is stored, or None if there is no such file."""
    if store.get_file_info(path).type != pafs.FileType.File:
        return None
    digest, size = hashlib.sha256(), 0
    try:
        # Without the argument a name such as x.gz would be unpacked.
        with store.open_input_stream(path, compression=None) as stream:
            while chunk := stream.read(chunk_bytes):
                digest.update(chunk)
                size += len(chunk)
    except FileNotFoundError:
        return None
    return size, digest.hexdigest()


def file_digests(paths: DataFrame, root: str, path_col: str = "path", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, file_size_bytes and sha256 of each distinct path below ``root`` that is a file.

    Paths are relative; null and empty ones, folders and absent files give no row. A file that may not be
    read is an error. Files are dealt out to tasks one by one, whatever their size; one file is one task's
    work, in memory of one chunk.
    """
    scheme, authority, base = address(paths.sparkSession, root)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, before = _store(scheme, authority)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = digest_of(store, f"{before}{base.rstrip('/')}/{path}", chunk_bytes)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found[0]], pa.int64()), pa.array([found[1]])],
                                                     ["path", "file_size_bytes", "sha256"])

    named = paths.select(F.col(path_col).alias("path")).where("path <> ''").distinct()
    return spread(named, "path").mapInArrow(read, "path string, file_size_bytes long, sha256 string")
