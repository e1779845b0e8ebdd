"""Session helpers: a configured SparkSession and a shared scratch folder.

Scratch data (lineage cuts, round-trip files) always lives under the folder the
cluster names in ``spark.checkpoint.dir``.  Only when that setting is absent
(local tests) do we create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str = "local[*]", app: str = "proxlab", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """A session; the cluster's shuffle partition count stays unless one is given."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session, creating a local one only if unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="proxlab-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "proxlab-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``proxlab`` importable in the Python workers (mapInArrow / pandas kernels).

    The package is zipped once per SparkContext and added with ``addPyFile``, Spark's own
    mechanism for distributing Python code to executors.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="proxlab-pyfiles-")
    zpath = os.path.join(out_dir, "proxlab.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


PARTITION_BYTES = 64 << 20
# below this a further task costs more than it saves
LEAST_PARTITION_BYTES = 2 << 20


def estimated_bytes(df) -> int:
    """Catalyst's size estimate of a DataFrame's optimized plan (compressed file size at a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(spark: SparkSession, nbytes: int) -> int:
    """Partitions for ``nbytes`` of data that is scanned many times: as many as cores while each has
    ``LEAST_PARTITION_BYTES``, and as many as it takes to hold ``PARTITION_BYTES`` each."""
    par = spark.sparkContext.defaultParallelism
    return int(max(1, min(par, -(-nbytes // LEAST_PARTITION_BYTES)), -(-nbytes // PARTITION_BYTES)))


def spread(df):
    """Repartition a DataFrame that is about to be persisted and scanned many times if it has fewer
    partitions than its estimated size warrants (one large row group, say).  Inputs that have
    enough partitions are returned unchanged, so no shuffle is added."""
    want = min(partitions_for(df.sparkSession, estimated_bytes(df)), df.sparkSession.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
