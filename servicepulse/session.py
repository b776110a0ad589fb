"""Session helpers: a configured local session for tests/bench and the
checkpoint directory used to cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library is designed around; on a cluster they come from the
# cluster's own configuration and are only defaulted here.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Optional JVM options for the local JVM (empty by default).  For very wide
# fused projections on long-running executors, "-XX:-DontCompileHugeMethods"
# lets HotSpot JIT-compile generated methods above 8000 bytes; on short local
# queries it costs more compile time than it saves.
JVM_OPTIONS = os.environ.get("SERVICEPULSE_JVM_OPTIONS", "")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "servicepulse", extra: dict | None = None) -> SparkSession:
    """A local session (tests, bench).  Never used by the library itself."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SERVICEPULSE_DRIVER_MEMORY", "16g")
    if JVM_OPTIONS:
        conf["spark.driver.extraJavaOptions"] = JVM_OPTIONS
        conf["spark.executor.extraJavaOptions"] = JVM_OPTIONS
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint directory (shared folder) for lineage cuts.

    Uses the directory the session already has, else ``spark.checkpoint.dir``
    from the configuration.  Only a local-mode session (tests, laptop) gets a
    fresh temporary directory; on a cluster an unset directory is an error,
    because a machine-local folder would not survive executor loss.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc is None:
            return configured
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (needed to cut lineage reliably)")
    path = tempfile.mkdtemp(prefix="servicepulse-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


SCRATCH_SUBDIR = "tables"


_scopes: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    within = "/".join([SCRATCH_SUBDIR, *_scopes])
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{within}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> bool:
    """Delete a folder of any store by the session's Hadoop FileSystem."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Within it, intermediate tables go to a folder of their own, which is
    deleted at the end: results must have been written or collected by then."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{'/'.join([SCRATCH_SUBDIR, *_scopes])}"
    try:
        yield
    finally:
        _scopes.pop()
        _delete(spark, folder)


def clear_scratch_tables(spark: SparkSession) -> bool:
    """Delete the intermediate tables this library wrote under the session's
    checkpoint directory.  Call it once the results that depend on them have
    been written or collected (DataFrames built earlier read those tables).
    Uses the Hadoop FileSystem of the folder, so it works on any shared
    store; returns whether anything was deleted."""
    return _delete(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{SCRATCH_SUBDIR}")


def map_arrow(df, fn, schema):
    """``mapInArrow`` for functions of this package: workers find it where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(fn, schema)


def materialize(df, name: str = "state", **options: str):
    """Write ``df`` once to the shared checkpoint folder and read it back; ``options`` are those of Spark's Parquet writer.

    Cuts the lineage like ``checkpoint()`` but computes the input only once
    (a reliable RDD checkpoint re-runs the job that produced it).  Meant for
    small intermediate tables (per-group state); the written table survives
    executor loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
