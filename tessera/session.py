"""Session helpers: building a local session for tests/bench, and resolving the
shared folders (checkpoints, scratch output) from the session itself.

On a cluster the session is created by the platform; the library never builds
one.  ``spark.checkpoint.dir`` must then name a shared, fault-tolerant folder
(HDFS, object store); where it is unset, as in tests, a folder in the session's
warehouse serves.
"""

from __future__ import annotations

import logging
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_LOG = logging.getLogger(__name__)
_LOCAL_CKPT: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench (local mode only)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session; where none is named,
    one in the session's warehouse folder."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server owns the checkpoint folder
        if conf_dir:
            return conf_dir
        raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    key = sc.applicationId
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-checkpoints"
        _LOG.info("spark.checkpoint.dir is not set; using %s", _LOCAL_CKPT[key])
    sc.setCheckpointDir(_LOCAL_CKPT[key])
    return sc.getCheckpointDir() or _LOCAL_CKPT[key]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver
    found it: once per application, as a zip served by Spark."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: --py-files or artifacts are the user's
        return
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(sc._temp_dir, f"{root.name}.zip")  # the driver's own Spark folder
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under the shared checkpoint
    folder (never a machine-local temp folder on a cluster)."""
    base = spark.conf.get("tessera.scratch.dir", None) or ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    return f"{base}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for pure-Python helpers used in tests."""
    return path[5:] if path.startswith("file:") else path


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
