"""The folder that driver and executors share, and files there that workers write and other workers map."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path: spark.checkpoint.dir. Where that is unset, one of our own if
    all runs on this machine; on a cluster that is an error, as no folder would be the same on all its machines."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "/tmp/checkpoints/" + spark.sparkContext.applicationId
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, where: str) -> DataFrame:
    """The rows as a table at `where`, read back. For what is joined with itself round by round: a checkpoint keeps the size that was
    estimated for its rows, which each join multiplies, so that its digits double; the size of a table is that of its files."""
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


_folders: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for files that workers write and other workers read. It is removed by `drop_folder`
    or, as results are computed late, when the driver's Python ends."""
    where = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = local_path(where)
    if path:
        os.makedirs(path, exist_ok=True)
    if not _folders:
        atexit.register(_drop_all)
    _folders.add(where)
    return where


def keep_folder(where: str) -> None:
    """Leave a folder of `new_folder` where it is: its files are a result."""
    _folders.discard(where)


def _drop_all() -> None:
    for where in list(_folders):
        try:
            drop_folder(where)
        except OSError:  # the store may be gone by then
            pass


def drop_folder(where: str) -> None:
    """Remove a folder of `new_folder` whose files are no longer read."""
    _folders.discard(where)
    path = local_path(where)
    if path:
        shutil.rmtree(path, ignore_errors=True)
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        store.delete_dir(base)


def local_path(where: str) -> str | None:
    """The mounted path of a shared URI, or None where it is in a store without one."""
    if where.startswith("file:"):
        return "/" + where[5:].lstrip("/")
    return None if "://" in where else where


def write_bytes(where: str, name: str, chunks: list[bytes | memoryview]) -> str:
    """Write a file whole or not at all: a lost or repeated task leaves no half-written file under the final name."""
    path = local_path(where)
    if path:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(part, f"{path}/{name}")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        store.create_dir(base, recursive=True)
        part = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            for c in chunks:
                f.write(c)
        store.move(part, f"{base}/{name}")
    return name


def map_array(where: str, name: str, dtype: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array. From a store without a mount it is first copied to a nameless
    temporary file of this process, whose space is free again as soon as the array is dropped."""
    path = local_path(where)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        with tempfile.TemporaryFile() as own:
            with store.open_input_stream(f"{base}/{name}") as src:
                shutil.copyfileobj(src, own)
            own.flush()
            return np.memmap(own, dtype=dtype, mode="r") if os.fstat(own.fileno()).st_size else np.zeros(0, dtype)
    path = f"{path}/{name}"
    if os.path.getsize(path) == 0:
        return np.zeros(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r")
