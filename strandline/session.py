"""Session factory and durable lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, app: str = "strandline") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of ``spark.checkpoint.dir``, or one of our own only where it is unset and all runs in this process (tests)."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="strandline-shared-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, so that lost executors cost no recomputation of earlier steps.

    A written table has the size of its files as statistics. (The estimates of a checkpoint() are those of its
    plan; over rounds of self-joins these numbers double their digits each round.)
    """
    return cut_counting(df, "true")[0]


def cut_counting(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """:func:`cut` and the number of rows that meet ``condition``, counted by the same job."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count_if(F.expr(condition)).alias("n")).write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out, int(seen.get.get("n") or 0)


def free(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` wrote and nothing reads any more."""
    for df in tables:
        _delete(getattr(df, "_strandline_path", ""))


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended; the shared folder is cleared with it
        pass


@atexit.register
def _delete_all() -> None:
    for path in [*_written]:
        _delete(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly Python work on few large files. Inputs of that many partitions stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that cannot import it from their own path; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    bundle = os.path.join(tempfile.mkdtemp(prefix="strandline-py-"), "strandline.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("strandline", os.path.relpath(full, home)))
    sc.addPyFile(bundle)
    sc._strandline_shipped = True
