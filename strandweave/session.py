"""Session settings, table access and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings that the operators rely on. They change results (map duplicates, time zone), not resources.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime settings that results depend on; resources stay as the cluster set them."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local master, which has one machine, gets a temporary folder where the setting is missing; any other
    cluster without it is an error, as data in a machine's own folder is lost with the machine.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    current = context.getCheckpointDir()
    if current:
        return current
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandweave-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(made)
    return context.getCheckpointDir() or made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the path deleted when the application ends."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(hadoop).deleteOnExit(place)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, at least two."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(df: DataFrame, size: int) -> int:
    """Partitions of about ``size`` bytes by the optimiser's estimate; at least one a core, at most the session's number."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    estimate = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    most = partitions(df.sparkSession)
    return min(most, max(2, df.sparkSession.sparkContext.defaultParallelism, -(-estimate // size)))
