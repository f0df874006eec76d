"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (tests), a temporary folder is made and set;
    on a cluster an unset folder is an error, since a machine-local one would not survive
    the loss of its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sparkwell-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whatever the scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Texts of 2 KB by the 10,000 are large Arrow batches, which the JVM and a worker each hold several times over.

    Where the session has the default, batches are of ``BATCH_ROWS`` rows from here on; the plans that operators return need it too.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


class Workspace:
    """Intermediate tables of one run, written below the shared folder.

    ``cut`` writes a plan as Parquet and reads it again, so that later stages neither
    recompute it nor depend on any executor's local disk. ``drop`` removes a table once
    nothing reads it; whatever is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sparkwell/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_drop_all)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            remove(self.spark, self.path(name) if name else self.root)

    def _quietly_drop_all(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the session has ended before the process
                pass
