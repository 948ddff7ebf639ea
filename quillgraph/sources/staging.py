"""Tables that cut lineage: written below ``spark.checkpoint.dir``, where every executor can read them.

A lost executor costs only the tasks it ran, since later stages read files. Tables are deleted by ``discard`` as soon
as no later plan reads them, and whatever is left of a session by ``release`` or at the end of the process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, object] = {}
#: Bytes of a row group where rows are long: a task writes and reads so many rows at once, however many there are.
LONG_ROWS = 8 << 20


def workspace(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset and the master is this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillgraph-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared one, deleted by ``release`` or at the end of the process."""
    path = f"{workspace(spark)}/{name}"
    _left[path] = spark
    return path


def stage(df: DataFrame, name: str = "table", group: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with row groups of ``group`` bytes if given, and read it back."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    df.write.options(**{"compression": "zstd"} | ({"parquet.block.size": group} if group else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks take about ``rows`` rows of ``df`` each, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` over so many tasks: for few bytes with much work for each."""
    return df.repartition(tasks(df, rows))


def _delete(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in staged:
        _delete(df._stage_path)


def release() -> None:
    """Delete all staged tables that are left; results that read them must have been used."""
    for path in list(_left):
        _delete(path)


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the engine may be gone already
        release()
