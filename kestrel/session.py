"""Spark session and job-environment helpers.

Library operators never create sessions; they take DataFrames and return
DataFrames. These helpers exist for tests, the bench and the driver entry.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours needs for correct results (UTC dates and
# timestamps, ANSI arithmetic) and for a runtime-adaptive physical plan.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "kestrel") -> SparkSession:
    """A local session for tests and the bench (cluster jobs bring their own)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as-is. A local session without one gets a scratch folder that goes when the
    process ends; a cluster without one is an error, since a folder on one
    machine would not survive it.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def ensure_partitions(spark: SparkSession, n: int) -> None:
    """Shuffles begin with at least ``n`` partitions (adaptive execution joins the
    small ones), so that a task's share does not grow with the input."""
    held = int(spark.conf.get(_FIRST_PARTITIONS, spark.conf.get("spark.sql.shuffle.partitions")))
    if n > held:
        spark.conf.set(_FIRST_PARTITIONS, str(n))


# The JVM compiles methods of up to 8,000 bytes only.
_COMPILED_BYTES = 8000
_HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def ensure_compiled(spark: SparkSession) -> None:
    """A stage whose generated method the JVM would only interpret (long reasons and
    prompts) runs operator by operator, whose code Spark splits into small methods."""
    if int(spark.conf.get(_HUGE_METHOD)) > _COMPILED_BYTES:
        spark.conf.set(_HUGE_METHOD, str(_COMPILED_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in Python workers (pandas functions refer
    to its modules). The package is zipped once per application and
    distributed with ``addPyFile``, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="kestrel-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    _SHIPPED.add(sc.applicationId)
