"""Session helpers: settings for local runs and a checkpoint folder from the session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tableprep") -> SparkSession:
    """A local session for tests and the bench (a cluster passes its own session)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", "16g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when unset on a local master (tests) make a scratch one.

    A machine-local folder is useless on a cluster (executors cannot read the driver's disk), so a
    cluster session without the setting is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (for example on HDFS or S3)")
        d = tempfile.mkdtemp(prefix="tableprep-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:   # setting it again would make a new sub-folder every time
        sc.setCheckpointDir(d)
    return d


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_and_read(df: DataFrame) -> tuple[DataFrame, str | None]:
    """``cut_lineage`` with the folder it wrote (None where it fell back to a checkpoint)."""
    out = cut_lineage(df)
    files = out.inputFiles()
    return out, files[0].rsplit("/", 1)[0] if files else None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in a fresh folder under the shared checkpoint folder and read it
    back: lineage is cut (survives executor loss), and later jobs get column pruning and vectorized reads,
    which an RDD checkpoint does not give. Falls back to ``checkpoint()`` if Parquet rejects the schema."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = base.rstrip("/") + f"/tableprep-{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:  # e.g. names Parquet cannot store
        if "AnalysisException" not in type(e).__name__ and "INVALID_COLUMN_NAME" not in str(e):
            raise
        return df.checkpoint(eager=True)
    return spark.read.parquet(path)
