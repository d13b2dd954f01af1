"""A domain as files: events by day, and the other tables beside them.

A load that brings events of some days writes those days anew and no others, so a daily
load into years of events costs a day. Lookup tables are small and written whole; rejects
are kept by load.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope.operators.contracts import REJECTS_SCHEMA
from eventscope.plans.domain import DIMENSIONS, Domain

DAY = "event_date"


def _write_days(rows: DataFrame, path: str) -> None:
    # Large days are split, small ones are a file each.
    (
        rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY).parquet(path)
    )


def write_domain(domain: Domain, path: str, load: str) -> None:
    """Write all tables. Days that ``domain`` has events of are replaced as a whole, other days
    keep their files; lookup tables are replaced; rejects replace those of the same ``load``
    (a name of the caller's, such as the date), so a load that is run again changes nothing.
    """
    _write_days(domain.events.withColumn(DAY, F.to_date("datetime")), f"{path}/events")
    for name in (*DIMENSIONS, "event_schema"):
        table = getattr(domain, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    (
        domain.rejects.withColumn("load", F.lit(load)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{path}/rejects")
    )


def merge_events(domain: Domain, path: str, key: str = "event_key") -> None:
    """Events of ``domain`` beside those that are there already: on the days that it has
    events of, a row replaces the old one with its key, and all others stay. Other days are
    neither read nor written, so an event that moved here from one of them is there twice."""
    spark = domain.events.sparkSession
    new = domain.events.withColumn(DAY, F.to_date("datetime"))
    try:
        old = spark.read.parquet(f"{path}/events")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        _write_days(new, f"{path}/events")
        return
    # A row per day; the join on it prunes the old days at run time.
    days = F.broadcast(new.select(DAY).distinct())
    kept = old.join(days, DAY, "left_semi").join(new.select(key), key, "left_anti")
    _write_days(new.unionByName(kept.select(*[c for c in old.columns]), allowMissingColumns=True), f"{path}/events")


def read_domain(spark: SparkSession, path: str) -> Domain:
    """The tables as written; give ``day="event_date"`` to the range predicate to read only
    the days it needs. A lookup table that was never written is None, as ``event_schema`` may be."""

    def table(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    rejects = table("rejects")
    if rejects is None:
        rejects = spark.createDataFrame([], REJECTS_SCHEMA)
    return Domain(
        events=table("events"), rejects=rejects.drop("load"),
        **{name: table(name) for name in (*DIMENSIONS, "event_schema")},
    )
