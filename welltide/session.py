"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "welltide", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the engine defaults. On a cluster leave ``master`` and ``partitions`` unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Runtime settings results depend on (time zone), for sessions made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship(spark)


_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private temporary one only for a local master that has none configured."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _local_scratch[app], ignore_errors=True)
    return _local_scratch[app]


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "welltide.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(os.path.join(root, "welltide")):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def release(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_mark(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number of files and bytes below a folder; differs once new data has landed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
    return s.getFileCount(), s.getLength()


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_dir(spark), "welltide", f"{label}-{uuid.uuid4().hex}")


def stage_path(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Like ``stage``, with the table's path, for ``release``."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts lineage at a point several later branches read from; the table outlives executors.
    """
    return stage_path(df, label)[0]
