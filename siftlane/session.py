"""Session helpers: table access, the shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a temporary folder is set on one machine (tests) and
    removed again at exit; on a cluster that is an error, for its executors could not
    reach a folder of the driver's.
    """
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there
    if there := spark.sparkContext.getCheckpointDir():
        return there
    if not (master := spark.sparkContext.master).split("[")[0] == "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
    own = tempfile.mkdtemp(prefix="siftlane-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application.

    They then import it wherever they run, whatever their working folder and path.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siftlane-ship-")  # the driver's own; Spark's file server hands it out
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/siftlane.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/siftlane.zip")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by then
        pass


_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at its end: results must be written or collected before."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _remove(spark, path)
        del _written[before:]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder, and read back.

    Cuts the lineage: what follows survives the loss of executors without running
    ``df`` again, reads only the columns it needs, and a costly Python stage that
    two branches use runs once.  The table stays until the session ends, or the
    ``scratch`` around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
