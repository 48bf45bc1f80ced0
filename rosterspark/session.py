"""Spark session helpers.

The library never creates a session on its own inside an operator; callers pass
one in.  ``local_session`` is what tests, ``bench.py`` and the examples use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "rosterspark",
                  extra_conf: dict | None = None) -> SparkSession:
    """A local session configured the way the cluster jobs expect.

    AQE is on (coalescing and skew-join splitting), the UI is off, time is UTC,
    and a checkpoint directory is set only when none is configured.
    """
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ROSTER_DRIVER_MEMORY", "8g"))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset on a local master a scratch folder is created;
    elsewhere that is an error, for executors would write to their own disks.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="rosterspark-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df, name: str):
    """Write ``df`` as parquet below the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the file instead of recomputing
    the plan) and turns a computed frame into a plain scan with column pruning
    and filter pushdown.  Each call writes a new folder.
    """
    return df.sparkSession.read.parquet(write_scratch(df, name))


def write_scratch(df, name: str) -> str:
    """Write ``df`` as parquet to a new folder below the shared checkpoint folder; return the path."""
    import uuid

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rosterspark`` importable in Python workers (once per SparkContext).

    Operators that run Python on executors (pandas UDF rules, delivery,
    stateful streaming) call this; it zips the package and ``addPyFile``s it,
    the usual way code reaches executors on a cluster.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rosterspark-pkg-"), "rosterspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("rosterspark", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the (possibly remote) file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
