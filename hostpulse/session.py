"""Session settings and the durable folder for state that outlives a task."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings every operator relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark 4.1 may treat a union of equally partitioned inputs as partitioned and skip the shuffle a
    # window needs; results were wrong with it (see tests/test_ordered.py), so it stays off.
    "spark.sql.unionOutputPartitioning": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "hostpulse", master: str | None = None, **conf) -> SparkSession:
    """Create a session; cluster sizing stays with the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions whose workers don't find it on their path.

    An installed package (``pyproject.toml``) needs no shipping.  Processors of stateful streams also start in a worker
    that gets no files, so their module travels by value.
    """
    from pyspark import cloudpickle

    from hostpulse.streaming import stateful
    cloudpickle.register_pickle_by_value(stateful)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def durable_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only on a ``local`` master, which has one machine, a temporary folder serves where the setting is absent;
    on a cluster that is an error, as executors and driver would each see their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
