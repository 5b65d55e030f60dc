"""Session settings and staged intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def build_session(app: str = "unitcal", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A ``local`` master is one process on one machine, so there a temporary folder serves when
    none is named; it goes when the process ends.  Any other master must name the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="spark-stage-"))
        atexit.register(shutil.rmtree, _local_folder[0], True)
    return f"file://{_local_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that deletes the shuffle files of an execution when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read on from there.

    Used where later steps must see exactly the same rows again (partition tags, model
    inputs) or would compute them twice.  A lost executor costs a re-read, not a different
    answer, and later steps read only the columns they name.  What the write shuffled is
    deleted with its end, so the disk holds one step's exchanges and not those of all.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged path that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(staged: DataFrame) -> None:
    """Delete the folders of a staged table that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        unstage(staged.sparkSession, folder)
