"""Reading tables and cutting lineage.

``cut`` writes a DataFrame to the shared folder that the session names in
``spark.checkpoint.dir`` and reads it back.  A later loss of an executor then
costs a re-read and never a recomputation of what came before.  Where the setting is absent
a folder of this machine is used if the session runs on this machine alone (tests, a laptop); on a cluster
that is an error.  Tables cut are removed by ``sweep``, at the latest when the process ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def sweep() -> None:
    """Removes the tables cut so far; results still to be read from them are lost."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone: nothing can be removed through it any more
            pass
    for d in _own:
        shutil.rmtree(d, ignore_errors=True)
    _own.clear()


atexit.register(sweep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and the session is local."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
    return f"file://{_own[0]}"


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Materialise ``df`` as a written table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Input of Python work spread over all cores: a small file is one partition, however many cores there are.

    Inputs with at least as many partitions as cores pass unchanged, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
