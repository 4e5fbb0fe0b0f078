"""What the operators share: the shared folder, written tables and bounded Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import adapters

#: A word is a run of anything but these six characters, in every operator.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session, which has no other machine, gets one of its own where it is unset."""
    context = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = _OWN.get(context.applicationId) or _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(conf)
    return conf


#: Folders of local sessions, by application.
_OWN: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches, a checkpoint folder, and this library on the workers' path."""
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def hand_back(spark: SparkSession) -> None:
    """Asks the executors' JVMs to collect and shrink: what one stage's sorts have grown a heap to counts against the same limit as the next one's Python workers."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def freed(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go now, not whenever the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here, executors may be lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` has made, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(columns as lists) -> columns as lists`` over every Arrow batch of ``df``."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a table of fewer scan tasks than cores is dealt to all of them."""
    return adapters.table(spark, sf_dir, "documents")
