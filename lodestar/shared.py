"""The folder all executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it has ended; what is kept needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: So many files at once let a task write a table by a column's values without sorting it.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Where it is unset, a local folder, on a local master only (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lodestar.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("lodestar.shared.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, and no executor's loss takes it
    away.  `by`: a column of few values, each of which gets a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, WRITERS)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(WRITERS, "8")
    try:
        writer = df.write.options(**options)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame | None, part: str = "") -> None:
    """Remove kept tables, or one folder of each; nothing may read them any more."""
    for df in tables:
        path = getattr(df, "kept_at", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
