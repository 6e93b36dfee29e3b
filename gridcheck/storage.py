"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go when the execution that made them is over,
#: and batches for Python are small, as executors and workers hold several of them.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    A session on one machine (a test) without it gets a temporary one; a
    cluster without it is an error, as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        import tempfile

        _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='gridcheck-')}"
    return _local[context.applicationId]


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a table, to ``path`` or in the shared folder, and read again.

    Cuts the lineage: what follows does not depend on executors that may go,
    so the shuffle files behind the table are removed at once.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
