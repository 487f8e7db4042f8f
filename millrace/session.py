"""Session settings, the shared scratch folder and the size limits every operator obeys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold in a window or a sort-in-memory aggregate.
TASK_ROWS_KEY = "spark.millrace.task.rows"
TASK_ROWS_DEFAULT = 2_000_000
# Rows the driver may receive as intermediate state (never data rows).
DRIVER_ROWS_KEY = "spark.millrace.driver.rows"
DRIVER_ROWS_DEFAULT = 100_000


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so functions in Python find it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        handle, archive = tempfile.mkstemp(prefix="millrace-", suffix=".zip")
        with os.fdopen(handle, "wb") as target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        packed.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
        atexit.register(lambda: os.path.exists(archive) and os.remove(archive))
    return spark


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def task_rows(spark: SparkSession) -> int:
    return _int_conf(spark, TASK_ROWS_KEY, TASK_ROWS_DEFAULT)


def driver_rows(spark: SparkSession) -> int:
    return _int_conf(spark, DRIVER_ROWS_KEY, DRIVER_ROWS_DEFAULT)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where a single machine runs all.

    On a cluster every executor must see the folder, so an unset one is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured and not current:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return configured or current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that several tasks must see."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    shared_root(session_of(df))
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> tuple[DataFrame, dict[str, list]]:
    """Compute a frame once into a reliable checkpoint; also the values of each metric it observes by name.

    The metrics are read from the execution itself. An ``Observation`` object would do the same, but it leaves a
    part in the session that cannot be serialised, which MLlib's evaluators then fail on.
    """
    held = materialize(df)
    found, metrics = {}, df._jdf.queryExecution().observedMetrics().iterator()
    while metrics.hasNext():
        pair = metrics.next()
        row = pair._2()
        found[pair._1()] = [row.get(i) for i in range(row.size())]
    return held, found
