"""Tables that cut lineage, kept in the folder all executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a
temporary folder is made. Every table is plain Parquet, so a lost executor costs nothing that was written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; sets one of this machine where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder:
        if current.isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, each row is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arbora-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what is written here no longer needs the shuffle files it came from
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files this process writes itself; deleted with its staged tables."""
    path = f"{shared_folder(spark)}/arbora-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_stage(df: DataFrame) -> None:
    """Delete the table behind ``df``, which :func:`stage` returned and nothing lazy needs any more."""
    path = df._staged
    _written[:] = [w for w in _written if w[1] != path]
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is then the cluster's to clean
        pass


def sweep() -> None:
    """Delete every staged table of this process."""
    while _written:
        _delete(*_written.pop())


atexit.register(sweep)
