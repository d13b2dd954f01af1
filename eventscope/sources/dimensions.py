"""Lookup tables: associations, sites, regions, shapes, sources, event schema."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope.operators.contracts import DIMENSIONS, Contract, fields_of, type_errors
from eventscope.operators.once import computed
from eventscope.sources.payloads import Read, read_documents


def _typed(objects: DataFrame, contract: Contract) -> DataFrame:
    return computed(objects, {
        **fields_of(contract, F.col("item")), "type_errors": type_errors(contract, F.col("item"))
    }).drop("item")


def rows_of(docs: DataFrame, kind: str) -> DataFrame:
    """Rows of a lookup table from its documents: an array of objects, for sources an
    object keyed by source id."""
    contract = DIMENSIONS[kind]
    if kind == "sources":
        keyed = F.try_variant_get("doc", "$", "map<string,variant>")
        return _typed(docs.select(F.explode(keyed).alias("source_id", "item")), contract)
    items = F.try_variant_get("doc", "$", "array<variant>")
    return _typed(docs.select(F.posexplode(items).alias("pos", "item")), contract)


def schema_rows(docs: DataFrame) -> DataFrame:
    """Event schema as (eventid, pos, field)."""
    lists = docs.select(
        F.explode(F.try_variant_get("doc", "$", "map<string,array<string>>")).alias("eventid", "declared")
    )
    return lists.select("eventid", F.posexplode("declared").alias("pos", "field"))


def read_dimension(spark: SparkSession, kind: str, paths: Sequence[str]) -> Read:
    docs = read_documents(spark, paths, kind)
    rows = schema_rows(docs.rows) if kind == "event_schema" else rows_of(docs.rows, kind)
    return Read(rows, docs.rejects)
