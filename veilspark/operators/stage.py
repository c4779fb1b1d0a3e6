"""Tables that an operator computes once and reads more than once, and free column names.

Staged tables are Parquet in the folder that the cluster shares: spark.checkpoint.dir, else the context's checkpoint
folder. Only a local master gets a folder of its own where neither is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veilspark-core-")
    return _OWN[context.applicationId]


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """df written and read back: lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/core-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of the columns has, in either case."""
    taken, prefix = {c.lower() for c in columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def quoted_name(column: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"
