"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every parlance job wants; a cluster launcher may override any of them.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # UDF-2 batch size of the reference's batched map.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def get_spark(master: str | None = None, app: str = "parlance",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with parlance defaults.

    On a cluster pass ``master=None`` so the launcher's master is used.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when that setting is unset (tests, local runs) is ``fallback`` used; on a
    cluster a machine-local folder would not survive executor loss, so without the
    setting and without a fallback this raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if fallback is None:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set for this cluster session")
            fallback = os.environ.get("PARLANCE_LOCAL_CHECKPOINT_DIR") or "/tmp/parlance-checkpoints"
        d = fallback
    if (spark.sparkContext.applicationId, d) not in _CHECKPOINT_SET:
        spark.sparkContext.setCheckpointDir(d)  # makes a folder each time it is called
        _CHECKPOINT_SET.add((spark.sparkContext.applicationId, d))
    return d


_CHECKPOINT_SET: set[tuple[str, str]] = set()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``parlance`` importable in the Python workers (pandas-map steps pickle functions of
    this package by reference).

    A job launched with the package installed on every node, or with ``--py-files``, needs
    nothing; otherwise the package is zipped once and added with ``addPyFile``, which Spark
    distributes to every executor. Done once per Spark application.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="parlance-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
