"""What the operators of this package share: reading tables, words, and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as one character each, for translate().
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text that Python works on at a time.
PORTION_BYTES = 1 << 20

_own_dirs: dict[str, str] = {}
_kept: dict[Hashable, object] = {}


def known_to_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, unless it was shipped with the job."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one of our own only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path  # noqa: SLF001
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in cuts:
        path = getattr(df, "_corvane_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, not substituted."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def portions(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of at most PORTION_BYTES of text each, a longer text alone: a worker's memory does not grow with the texts of a batch.

    In the end free memory goes back to the system.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            before = int(ends[k - 1]) if k else 0
            n = max(int(np.searchsorted(ends, before + PORTION_BYTES, "right")) - k, 1)
            yield batch.slice(k, n)
            k += n
        del batch
    give_back()


def kept(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from task to task, made by make(): one thing at a time, since workers outlive the stages of a pipeline
    and what an earlier stage's tasks left would take room beside every later stage."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what the tasks of other operators kept in this worker. For tasks that keep nothing."""
    if _kept:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
