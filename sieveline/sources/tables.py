"""Written tables: what many operators share is computed once and read back, so plans stay short and lost executors cost nothing."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What deletes each written table that is left; and, by thread, the tables it wrote, in order: queries may run side by side.
_left: dict[str, Callable[[], None]] = {}
_own = threading.local()


def _mine() -> list[str]:
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where there is one machine and the session names none, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package; a cluster gets it with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: lost executors cost no recomputation, plans stay short.

    files: at most so many, where the rows are known to be few; small tables in hundreds
    of files cost more to write and list than to compute.
    """
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = _deleter(spark, path)
    _mine().append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables this thread has written and not deleted; see only_last."""
    return len(_mine())


def only_last(since: int) -> None:
    """Delete the tables this thread wrote after mark() gave ``since``, but for the last, which was made from them."""
    for path in _mine()[since:-1]:
        _left.pop(path)()
    del _mine()[since:-1]


def drop(since: int) -> None:
    """Delete the tables this thread wrote after mark() gave ``since``: nothing reads them any more."""
    for path in _mine()[since:]:
        _left.pop(path)()
    del _mine()[since:]


def _deleter(spark: SparkSession, path: str) -> Callable[[], None]:
    """Deletes the path, also when the session has been stopped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete() -> None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    return delete


@atexit.register
def _clean() -> None:
    for delete in _left.values():
        try:
            delete()
        except Exception as failed:  # noqa: BLE001  one table that cannot be deleted must not keep the others
            logging.getLogger(__name__).warning("a written table stays: %s", failed)
