"""Small helpers that the operators of this package share."""

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventscope.session import use_checkpoint_folder

# Texts may be long, so few of them travel in one Arrow batch.
ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def saved(df: DataFrame) -> DataFrame:
    """The rows as files in the shared checkpoint folder: read again, never made again."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def give_back_memory() -> None:
    """A worker that waits for its next task keeps no memory that it has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def add_columns(
    df: DataFrame, make: Callable[[pa.RecordBatch], list], fields: list[T.StructField]
) -> DataFrame:
    """``df`` with columns that ``make`` works out from each Arrow batch.

    A column of ``df`` that has the name of a new one is replaced.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            new = [
                a if isinstance(a, pa.Array) else pa.array(a, kind)
                for a, kind in zip(make(batch), kinds)
            ]
            old = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                old + new, names=[f.name for f in kept] + [f.name for f in fields]
            )
        give_back_memory()

    return df.mapInArrow(run, T.StructType(kept + fields))

