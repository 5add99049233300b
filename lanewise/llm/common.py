"""What the operators share: input tables, intermediates in the shared folder, Arrow loops."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest id standing for a null doc_id: such rows sort after all others.
NULL_ID = 2**63 - 1


#: A table of at most so many bytes is dealt over the cores, where it is asked for.
SPREAD_BYTES = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the input tables; only Spark touches the path, so any file system will do.

    ``spread``: where a table of up to SPREAD_BYTES comes in fewer splits than there are cores, its
    rows are dealt over them; counting the splits reads no column. Results do not depend on it.
    """
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and _bytes(spark, path) <= SPREAD_BYTES and found.select(F.spark_partition_id().alias("p")).distinct().count() < cores:
        return found.repartition(cores)
    return found


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lanewise-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lanewise-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that
    survives lost executors, and one computation for several readers."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps whose results are staged.

    Spark drops them when the driver's JVM collects the plans that refer to them, by itself every
    half hour (spark.cleaner.periodicGC.interval); this asks for it at the end of a step, since the
    next one may need the disk. Python's references go first, then those of the JVM that they held,
    so it takes two rounds. Results do not depend on it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(df: DataFrame) -> None:
    """Delete a staged table whose readers are all staged themselves."""
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


#: Rows of an Arrow batch, so that long texts do not pile up in a worker. Plans are lazy, so one value serves all operators.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` where ``rows`` turns a batch into columns of ``schema``."""
    target = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield as_batch(rows(batch), target)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)
