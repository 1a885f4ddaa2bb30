"""Tables written in the folder that driver and executors share.

They cut lineage (a lost executor costs no recomputation of what is written) and let one
result be read more than once. Nothing here uses a machine-local folder on a cluster. Results are lazy and
read these tables, so they are deleted by `drop` where nothing reads them any more, by `release`
when a caller is done with all results, and else when the driver's JVM exits.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_bases: dict[str, str] = {}  # of each shared folder, this process's folder in it
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where that is unset, a local master gets a folder of our own; on a
    cluster, whose executors would write where nobody reads, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"Set spark.checkpoint.dir to a folder that the driver and all executors share (master {master}).")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has; what is written there is deleted like a written table."""
    where = shared_dir(spark)
    if where not in _bases:
        _bases[where] = f"{where}/plumbline-{uuid.uuid4().hex}"
        base, fs = _at(spark, _bases[where])
        fs.mkdirs(base)
        fs.deleteOnExit(base)  # only what is there already can be registered
    path = f"{_bases[where]}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all that this process has written in the shared folder: for callers whose results are computed and stored."""
    for path in list(_written):
        _delete(spark, path)


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)
    if path in _written:
        _written.remove(path)


#: Inputs up to this size, one split of a file by default, are dealt over all cores before much work is done on them.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if the planner takes it for small enough to come in one part.
    A large input comes in many parts and stays as it is, without a shuffle."""
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
