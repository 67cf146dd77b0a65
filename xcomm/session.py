"""Session helpers.

Library code never creates a session of its own; it takes the caller's.  ``local_session`` is for
tests, the bench and examples only.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package assumes.  Times are epoch numbers and calendar fields are
# read in GMT, so the session zone is pinned to UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def apply_conf(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``xcomm`` importable on the executors' Python workers (pandas UDFs pickle functions
    by module reference): zip the package once and ``addPyFile`` it to the session."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="xcomm-pkg-")
    archive = os.path.join(out_dir, "xcomm.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("xcomm", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "xcomm") -> SparkSession:
    """A local session for tests and the bench (UI off, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("XCOMM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a ``local[...]`` master (tests, one machine) gets a private temporary folder when the
    setting is missing; on a cluster a missing setting is an error, because a folder of one
    machine would be invisible to the others.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if sc.getCheckpointDir():
        return os.path.dirname(sc.getCheckpointDir())
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = id(sc._jsc)
    if key not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[key] = tempfile.mkdtemp(prefix="xcomm-shared-")
    return _LOCAL_FOLDER[key]


_LOCAL_FOLDER: dict[int, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``checkpoint()`` at the shared folder unless the session already has a place."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for a table or model that a query writes and reads; removed when
    the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/xcomm/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_folder, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: lineage and plan end here, a lost executor costs a
    re-read of files, and later scans read only the columns they need."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_folder(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is already gone; the cluster cleans its folder
        pass
