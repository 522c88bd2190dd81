"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders made by each Spark application and not yet deleted.
_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a local
    folder is made and set once if Spark runs in one machine (tests, notebooks);
    on a cluster, whose executors couldn't read it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/tidewatch/{kind}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made = _MADE.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all work folders of this application; call it once the results are consumed."""
    for path in list(_MADE.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new_name=old_name`` columns by exact name.

    Columns are found by position, so extra columns whose names clash (also in
    case only) never make a reference ambiguous.
    """
    names = list(df.columns)
    plain = [f"c{i}" for i in range(len(names))]
    return df.toDF(*plain).select(*[F.col(plain[names.index(old)]).alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it if ``df`` has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def row_hash(rows: DataFrame) -> Column:
    """xxhash64 of all columns that can be hashed; nulls count by their place."""
    plain = [f.name for f in rows.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*plain, *[F.isnull(c) for c in plain])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b if b is not None else b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]
