"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE re-plans joins from runtime sizes
# (broadcast only below the threshold Spark measures), coalesces small
# shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "stockspark", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the session comes from the launcher."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Read from ``spark.checkpoint.dir`` (set by the cluster to a shared file
    system). Only when it is unset - local runs and tests - a scratch folder
    is created here.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="stockspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_folder(spark: SparkSession) -> str:
    """A new name under the shared checkpoint folder."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/materialized/{uuid.uuid4().hex}"


def materialize(df, path: str | None = None):
    """Cut lineage by writing the frame once as Parquet under the shared
    checkpoint folder (or to ``path``) and reading it back.

    One columnar write computes the input once (an eager ``checkpoint()``
    computes it twice unless cached, and caching wide struct rows costs more
    than it saves); the re-read gets column pruning and filter pushdown, and
    the files survive executor loss.
    """
    spark = df.sparkSession
    path = path or scratch_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``stockspark`` importable in Python workers (pandas UDFs, grouped
    state functions): zip the package once per application and hand it to
    ``SparkContext.addPyFile``, which distributes it with the job."""
    import shutil
    sc = spark.sparkContext
    if getattr(sc, "_stockspark_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="stockspark-pyfiles-")
    archive = shutil.make_archive(os.path.join(staging, "stockspark"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="stockspark")
    sc.addPyFile(archive)
    sc._stockspark_shipped = True
