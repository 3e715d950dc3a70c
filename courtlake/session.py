"""Session defaults, and cutting a long lineage safely on a cluster."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("courtlake")
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", **conf}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _private_dir(spark: SparkSession, prefix: str) -> str:
    """A folder of this machine, which only a local session may use."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix=prefix)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach: below the cluster's shared checkpoint folder, or a
    private one where a local session names none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return _private_dir(spark, f"courtlake-{name}-")
    return f"{shared.rstrip('/')}/courtlake-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder, so lost executors never recompute the
    whole chain. The cluster names the folder in ``spark.checkpoint.dir``; only a session without
    one (a test) gets a private folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or _private_dir(spark, "courtlake-ckpt-"))
    return df.checkpoint(eager=True)


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed columns below the shared folder and read again. A checkpoint keeps serialized rows, which take several
    times the disk; it also keeps how they lie, which this does not."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
