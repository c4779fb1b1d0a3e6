"""Helpers of the training-data operators: staged tables, columns, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or the context's checkpoint folder. Only a local master
    gets a folder of our own where neither is set; on a cluster each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    return _OWN[app]


#: Staged tables of each open scratch(), innermost last.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, is computed once.

    Within scratch() the table is deleted at the end of the block, or with keep at the end of the block around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veilspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    open_ = _OPEN.get()[:-1] if keep else _OPEN.get()
    if open_:
        open_[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables staged within the block when it ends: nothing that is read later may depend on them."""
    mine: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for table in mine:
            forget(table)


def forget(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more: what was made from it must be staged itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of whole texts that a worker holds at a time.
SLICE_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to SLICE_ROWS rows; a lower setting stays. Spark's own 10,000 rows of whole texts
    take a worker's memory several times over. A session's settings are the application's: the registered queries and
    the pipeline's stages call this, the operators never do, and they give the same results under any setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= SLICE_ROWS:
        spark.conf.set(key, str(SLICE_ROWS))


def short_plans(spark: SparkSession) -> None:
    """Holds the descriptions of plans short. The driver keeps one of each run and of each change to a running plan; with
    megabytes of literals in them they fill its memory. Only texts are cut: plans and their metrics stay. Called as small_batches is."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1")
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, without a copy; batches without rows give nothing. What a part took goes back
    to the system, so that a worker that is used again does not keep its largest batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
            pa.default_memory_pool().release_unused()


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of the columns has, in either case."""
    taken, prefix = {c.lower() for c in columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def quoted_name(column: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only, so the result does not depend on a locale or a Unicode version."""
    return F.translate(col, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(quoted_name(name)), F.lit(""))


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows, at most that many, those of low hash: thinned in the scan, so no task gathers candidates."""
    share = min(1.0, 1.5 * rows / max(df.count(), 1))
    return df.filter(F.pmod(F.xxhash64(F.lit(41), key), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows)


ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
