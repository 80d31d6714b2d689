"""Spark session settings and the shared checkpoint folder.

On a cluster the session already carries ``spark.checkpoint.dir`` (a shared
folder such as HDFS/S3); we only read it.  A folder of our own is set only
when the setting is missing, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partitions are sized per deployment:
# local tests use the core count, a 100 TB cluster run sets its own value and
# lets AQE coalesce small partitions and split skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a run over ``input_bytes`` on ``cores`` cores.

    Shuffle partitions start at ~one per ``target_partition_bytes`` of input
    (at least the core count, rounded up to a multiple of it so waves are
    full); AQE then coalesces small ones to the same advisory size and splits
    skewed ones.  For 100 TB on 1000 executors x 8 cores that is ~400,000
    initial partitions of ~256 MB, each comfortably inside an executor's
    execution memory, spilling rather than failing when a key is hot.
    """
    cores = max(int(cores), 1)
    parts = max(cores, -(-int(input_bytes) // target_partition_bytes))
    parts = -(-parts // cores) * cores
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 4),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


SHUFFLE_INPUT_BYTES = 8 << 20  # raw parquet, packed about tenfold, a shuffle partition
TASK_SHUFFLE_BYTES = 16 << 20


def size_session(spark: SparkSession, input_bytes: int) -> None:
    """Raise the shuffle partitions with the input, so that a task's sort fits its memory at any size.

    A count that is already higher stays; adaptive execution joins small
    partitions, up to ``TASK_SHUFFLE_BYTES`` of compressed rows.
    """
    parts = -(-int(input_bytes) // SHUFFLE_INPUT_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    if parts > 1:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_SHUFFLE_BYTES))


def build_session(master: str | None = None, app: str = "marketgrid",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a scratch one is set only if unset
    on a local master, elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.mkdtemp(prefix="marketgrid-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def state_root(spark: SparkSession) -> str:
    """Folder for written next-state tables and stream checkpoints (shared storage).

    ``spark.marketgrid.state.dir`` names one that outlives the application;
    else it lies under the checkpoint folder, which Spark makes per application.
    """
    own = spark.conf.get("spark.marketgrid.state.dir", None)
    if own:
        return own.rstrip("/")
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/marketgrid-state"


def ship_library(spark: SparkSession) -> None:
    """Make ``marketgrid`` importable in executor Python workers.

    Only operators that run Python on executors (pandas-backed state in H2)
    need it.  The package is zipped in memory, written through the Hadoop
    FileSystem API into the shared state root and added with ``addPyFile``
    (what ``--py-files`` does at submit time); done once per SparkContext.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_marketgrid_shipped", False):
        return
    # Shipping a copy of an already installed package is harmless.
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in sorted(os.walk(pkg)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    data = buf.getvalue()
    target = f"{state_root(spark)}/lib/marketgrid-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    sc.addPyFile(target)
    sc._marketgrid_shipped = True


class shuffle_partitions:
    """Context manager: run a block (e.g. a streaming query's start) with
    ``spark.sql.shuffle.partitions`` = n, then restore the old value.

    A stateful stream fixes its state partition count at its first start and
    keeps it in the checkpoint, so this sizes the state store once.
    """

    def __init__(self, spark: SparkSession, n: int | None):
        self.spark, self.n, self.old = spark, n, None

    def __enter__(self):
        if self.n:
            self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        if self.n and self.old is not None:
            self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False
