"""What the operators share: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of narrow keys that are broadcast (16 MB of longs); beyond it, joins shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of a batch that Spark hands to a Python task, unless the application sets its own.
MAX_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a folder of the warehouse, which driver and executors share as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_kept")
    return context.getCheckpointDir()


def file_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as compressed Parquet: for wide rows."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A kept (``cut``) narrow table, marked for broadcast only if its counted rows are few."""
    return broadcast_if(df, df.count(), max_rows)


def broadcast_if(df: DataFrame, rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, which is known to have so many rows, marked for broadcast if they are few."""
    return F.broadcast(df) if rows <= max_rows else df


def in_batches(df: DataFrame, task: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas(task, schema)`` with batches of bounded bytes, whose worker gives its free memory back when a task ends."""
    bytes_at_once = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(bytes_at_once):
        df.sparkSession.conf.set(bytes_at_once, MAX_BATCH_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from task(batches)
        release()

    return df.mapInPandas(run, schema)


def release() -> None:
    """Hands memory that is free to the system: workers live on, and their next task may need none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df``, which is a kept or a read table, with each row's place from 0 in its group, in ascending order; kept.

    Rows are dealt by ranges of (group, order, own number), so that neither a large group nor
    rows that are all alike meet in one task; of a group, only one count for each range does.
    Groups are not null. Rows alike in ``order`` come in any order.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, "__row"]
    dealt = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)).drop("__row"))
    counts = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select(*group, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base")))
    return dealt.join(sized(bases), [*group, "__range"]).withColumn(name, F.col("__at") + F.col("__base")).drop("__at", "__range", "__base")


def without(docs: DataFrame, row: Column, gone: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows whose 64-bit hash ``row`` is in the kept table ``gone`` (one column, distinct); the rows themselves are never shuffled.

    Few hashes are broadcast. Of many, hashes meet the rows' places in their files instead, places are
    written by file, and each task leaves out the places of the file that it reads. For that,
    docs that are no scan of files are stored first.
    """
    (name,) = gone.columns
    columns = docs.columns
    hashed, file, place = (fresh(c, columns) for c in ("__hash", "__file", "__place"))
    if gone.count() <= max_rows:
        marked = docs.withColumn(hashed, row)
        return marked.join(F.broadcast(gone), marked[hashed] == gone[name], "left_anti").drop(hashed)
    at = [F.md5("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)]
    try:
        placed = docs.select("*", *at)
    except AnalysisException:
        docs = stored(docs)
        placed = docs.select("*", *at)
    marks = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    named = placed.select(F.col(file).alias("folder"), F.col(place).alias("place"), row.alias("row_hash"))
    chosen = named.join(gone, named["row_hash"] == gone[name]).select("folder", "place")
    chosen.repartition("folder").write.partitionBy("folder").parquet(marks)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            files, places = batch.column(file).to_numpy(zero_copy_only=False), batch.column(place).to_numpy()
            for one in np.unique(files):
                if one not in known:
                    known = {one: _places(marks, one)}  # a task reads one file after another
                keep &= (files != one) | ~np.isin(places, known[one])
            yield batch.select(columns).filter(pa.array(keep))

    return placed.mapInArrow(task, docs.schema)


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores more as it takes to be none of the columns."""
    while name in columns:
        name += "_"
    return name


def _places(marks: str, folder: str) -> np.ndarray:
    where, path = file_at(f"{marks}/folder={folder}")
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return np.array([], dtype=np.int64)
    return pq.read_table(path, filesystem=where, columns=["place"], partitioning=None)["place"].to_numpy()


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` over costly columns: the filter stays above the projection, which pushing it down would evaluate again inside it."""
    return df.withColumn("__row", F.monotonically_increasing_id()).where(condition & (F.col("__row") >= 0)).drop("__row")


def worker_state(name: str, make: Callable[[], object]) -> object:
    """Something costly that a Python worker keeps from task to task: made once per process."""
    store = sys.modules.setdefault("_seqforge_worker", types.ModuleType("_seqforge_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
