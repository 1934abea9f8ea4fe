"""Session construction and the shared scratch location.

Cluster jobs get their session from the platform; the settings below only
fill gaps, so a cluster's own values win.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: plan nodes that deal their rows anew
SHUFFLED = re.compile(r"^[ :+-]*(?:Join|Aggregate|Window|Repartition|RepartitionByExpression|RebalancePartitions|Sort|GlobalLimit|Deduplicate|Distinct|Intersect|Except)\b", re.M)

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Return the active session as it is, or build one.

    In a new session, settings come from (strongest first) ``extra``, the
    environment's own configuration (spark-submit, spark-defaults), and the
    defaults above.  An active session keeps every setting it has.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = dict(extra or {})
    if shuffle_partitions:
        given.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if SparkContext._active_spark_context is not None:  # a context without a session: its settings stand
        own = dict(SparkContext._active_spark_context.getConf().getAll())
    else:
        own = _submitted()
    for k, v in {**{k: v for k, v in DEFAULTS.items() if k not in own}, **given}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _submitted() -> set[str]:
    """Names of the settings that spark-submit arguments or a defaults file give to a new context."""
    names = set(re.findall(r"--conf[ =]['\"]?([\w.]+)=", os.environ.get("PYSPARK_SUBMIT_ARGS", "")))
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    path = os.path.join(folder, "spark-defaults.conf")
    if os.path.isfile(path):
        with open(path) as f:
            names |= {line.split()[0].partition("=")[0] for line in f if line.strip() and not line.lstrip().startswith("#")}
    return names


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  Only when neither is set and the master is local, as in
    tests, a folder is created and registered as the checkpoint dir; on a
    cluster its executors would not share it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    if not base:
        try:
            sc = spark.sparkContext
            base = sc.getCheckpointDir()
        except Exception:  # e.g. a Spark Connect session has no context to ask
            sc = None
    if not base:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(base)
            base = sc.getCheckpointDir() or base
    leaf = f"{name or 'out'}-{uuid.uuid4().hex[:12]}"
    return base.rstrip("/") + "/" + leaf if "://" in base else os.path.join(base, leaf)


def spread(df, min_partitions: int | None = None):
    """Round-robin ``df`` over the cluster's task slots when it has fewer partitions.

    Parquet splits by row group, so a small file with one row group is one
    task; CPU-heavy row-local work (regex over long texts) would then run on
    one core.  A real input of many files/row groups already has at least as
    many partitions as slots, and then this is a no-op (no shuffle).
    """
    if df.isStreaming:
        return df
    try:
        # after a join or grouping the rows are dealt already, and asking for the partitions would run it
        if SHUFFLED.search(df._jdf.queryExecution().optimizedPlan().toString()):
            return df
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. Spark Connect): leave the plan as it is
        return df
    return df.repartition(target) if current < target else df
