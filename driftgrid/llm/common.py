"""Shared helpers: tables, the shared scratch folder, words, and Arrow batch sizes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the ASCII white-space characters that separate words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a session that runs on this machine alone gets a new folder; any other is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="driftgrid-")
        context.setCheckpointDir(found)
    return found


#: Folders of the tables that each open scratch() block has written.
_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str, codec: str = "zstd", lasting: bool = False, **options: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back.

    This cuts the lineage: a lost executor costs the rows in flight, not what came before. The table goes at the end of the innermost
    scratch() block, unless it is lasting: then at the end of the one around that, if any. Further options are those of the writer.
    """
    path = f"{shared_dir(df.sparkSession)}/driftgrid-{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    owners = _SCRATCH[:-1] if lasting else _SCRATCH
    if owners:
        owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are deleted at its end; what leaves the block must not read them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _SCRATCH.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while an action inside the block runs; long texts make large rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_rows(spark: SparkSession, rows: int):
    """Parquet read by so many rows at once while an action inside the block runs: Spark's 4,096 are gigabytes where a row is most of a megabyte."""
    return _setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(rows))


def words(text: Column) -> Column:
    """The words of a text as an array: runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def sieve(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) for conditions on costly columns.

    A plain filter is pushed below the projections that make its columns, which evaluates them twice, and again inside each
    lambda. A column that isn't deterministic keeps it in its place.
    """
    row = "row_of_the_sieve"
    while row in df.columns:
        row += "_"
    return df.withColumn(row, F.monotonically_increasing_id()).where(condition & (F.col(row) >= 0)).drop(row)


def settled(df: DataFrame) -> DataFrame:
    """df, into whose costly columns no filter of a later step is pushed."""
    return sieve(df, F.lit(True))
