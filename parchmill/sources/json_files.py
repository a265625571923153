"""JSON tables that a reader sees whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_json_atomically(rows: DataFrame, path: str) -> None:
    """Write beside the path, then put the new folder in the place of the old one by renaming. A failed write leaves the old
    table as it was; renaming is one step on file systems that have it (object stores do not)."""
    spark = rows.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    rows.write.json(fresh)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    files = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = files.exists(as_path(path))
    if moved and not files.rename(as_path(path), as_path(old)):
        raise OSError(f"{path} cannot be moved")
    if not files.rename(as_path(fresh), as_path(path)):
        raise OSError(f"{fresh} cannot be renamed to {path}")
    if moved:
        files.delete(as_path(old), True)
