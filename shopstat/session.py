"""Spark session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on.  UTC keeps timestamp_ntz arithmetic and the
# DuckDB oracle in agreement; AQE coalesces small shuffles and splits skewed
# sort-merge join partitions at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of numbered rows are removed once no plan refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "shopstat",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the project defaults.

    On a cluster leave ``master`` unset so spark-submit decides.  Locally the
    shuffle partition count should match the cores, not the default 200.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Pandas UDFs and ``mapInArrow`` functions are pickled with references to
    this package's modules, so executors must be able to import it.  The
    package is zipped once per SparkContext and added with ``addPyFile``
    (what ``spark-submit --py-files`` does).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext on this client
        return
    if getattr(sc, "_shopstat_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="shopstat-pkg-"), "shopstat.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._shopstat_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    ``spark.checkpoint.dir`` decides; else a folder that the caller has set
    on the context.  Where neither is set a scratch folder is made, but only
    for a local master (tests, local runs): on a cluster a machine-local
    folder would be wrong, so that is an error there, raised by the first
    query that needs the folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not current:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            current = tempfile.mkdtemp(prefix="shopstat-ckpt-")
        sc.setCheckpointDir(current)
    return current or sc.getCheckpointDir()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark."""
    return get_session(
        master=f"local[{cpus}]",
        shuffle_partitions=shuffle_partitions,
        extra={"spark.driver.memory": os.environ.get("SHOPSTAT_DRIVER_MEMORY", "16g")},
    )


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                 broadcast_bytes: int = 64 << 20, most_partitions: int = 100_000) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Scan splits and shuffle partitions aim at ``target_partition_bytes``
    each (so a task's share fits executor memory and spills rarely), with at
    least a few waves of tasks per core; AQE then coalesces small shuffle
    partitions and splits skewed ones around the same size.  Joins switch to
    broadcast only below ``broadcast_bytes`` of measured (runtime) size.
    """
    # the tables of map and reduce blocks grow with the square of the partition
    # count, so beyond ``most_partitions`` each partition takes more bytes instead
    target_partition_bytes = max(target_partition_bytes, -(-input_bytes // most_partitions))
    partitions = max(total_cores * 3, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 4),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
    }
