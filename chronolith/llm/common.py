"""Shared plumbing of the text operators: shipping code, cutting lineage, reading Arrow text."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_owned: dict[str, str] = {}
_written: dict[int, str] = {}

#: ASCII letters lowered, every ASCII byte that is neither letter nor digit turned into a blank.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    # Spark's file server sends it from the driver
    folder = tempfile.mkdtemp(prefix="chronolith-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "chronolith_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "chronolith").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a folder of this machine is used if it runs all executors, as in tests; else that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _owned:
        _owned[app] = tempfile.mkdtemp(prefix="chronolith-shared-")
        atexit.register(shutil.rmtree, _owned[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_owned[app])
    return _owned[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/chronolith-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Take a folder away, local or by Spark's file systems while the session lasts."""
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" not in local:
        shutil.rmtree(local, ignore_errors=True)
        return
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    return out


def dropped(table: DataFrame) -> None:
    """Remove a table that :func:`written` gave, once nothing is left to be computed from it."""
    path = _written.pop(id(table), None)
    if path:
        _remove(path)


#: Narrow rows that one task writes where their number is known.
CUT_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint; ``rows``: about how many it has, so that few rows are few files."""
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // CUT_ROWS)))
    return df.checkpoint(eager=True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores behind it until no column has it (Spark does not tell case apart)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null as None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Smaller slices of Arrow batches, so that a worker's lists stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows and bytes of a column of texts at most, of a row at least."""
    for batch in pieces(batches, rows):
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same scan; after each task its worker, which waits for others, gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        give_back()

    return run


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
