"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()
_TABLES: dict[str, set[str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, as ``--py-files`` would:
    its modules go to the executors as one small zip through Spark, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="seqtok-py-")), "seqtok.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def local_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "seqtok", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster, build your own session;
    the library only reads the settings below, it never needs them."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # tables bucketed by a chunk are joined on chunk and row without an exchange
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _configured_checkpoint_root(spark: SparkSession) -> str | None:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            root = None
    return root or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is taken as is; without it a
    cluster session fails here, because executors would write to their own disks. Only
    in local mode an unset folder is made here and registered with the context.
    """
    root = _configured_checkpoint_root(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = spark.sparkContext.getCheckpointDir()
        if current:
            # the context appends a unique child folder; use its parent as root
            root = current.rsplit("/", 1)[0]
        else:
            root = tempfile.mkdtemp(prefix="seqtok-ckpt-")
            spark.sparkContext.setCheckpointDir(root)
        return root
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def _scratch_root(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    root = os.path.join(ensure_checkpoint_dir(spark), "seqtok", app)
    if app not in _SCRATCH:
        _SCRATCH.add(app)
        atexit.register(_drop_at_exit, spark, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for an intermediate table. All of an
    application's tables go with ``drop_scratch``, at the latest when the driver ends."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Remove one intermediate table, or all those of this application."""
    sc = spark.sparkContext
    target = path or os.path.join(ensure_checkpoint_dir(spark), "seqtok", sc.applicationId)
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(target)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def _drop_at_exit(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError, OSError):
            for table in _TABLES.pop(spark.sparkContext.applicationId, ()):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            drop_scratch(spark, root)
    elif "://" not in root:            # session stopped; a folder of this machine
        shutil.rmtree(root.removeprefix("file:"), ignore_errors=True)


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` once as Parquet under the shared checkpoint root and
    read it back (columnar, so later stages prune columns). Used instead of
    ``DataFrame.checkpoint()``, which derives constraints from the unoptimised plan
    and can stall the driver on wide projections."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """``(table name, path)`` for an intermediate table with a layout. The files lie in the scratch folder;
    the name is dropped with the application."""
    path = scratch_path(spark, name)
    table = "seqtok_" + os.path.basename(path).replace("-", "_")
    _TABLES.setdefault(spark.sparkContext.applicationId, set()).add(table)
    return table, path


def materialize_bucketed(df, name: str, buckets: int, key: str, sort: str):
    """``materialize`` as a table bucketed by ``key`` and sorted by ``sort`` in each bucket. Spark knows
    that all rows of a key lie in one bucket, so a window or aggregate per key over what is
    read back, also after projections and broadcast joins, needs no exchange."""
    spark = df.sparkSession
    table, path = scratch_table(spark, name)
    df.write.format("parquet").bucketBy(buckets, key).sortBy(sort).option("path", path).saveAsTable(table)
    return spark.table(table)
