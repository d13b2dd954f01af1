"""Fields of raw log events, which differ by event type."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventscope import fixed_values as fixed
from eventscope.operators.once import computed

_HEADER = [*fixed.ENVELOPE, "datetime"]
_PLACED = ["timestamp", "message"]


def declared_fields(schema: DataFrame) -> DataFrame:
    """(eventid, pos, field) rows as one ordered list per event type."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "field")))
    return schema.groupBy("eventid").agg(F.transform(listed, lambda f: f["field"]).alias("declared"))


def field_coverage(log: DataFrame, schema: DataFrame, raw: str = "raw") -> DataFrame:
    """Per log event: ``fields`` it carries in display order, and declared ones ``absent``.

    Display order: timestamp, the declared fields, undeclared ones as logged, message.
    The header's fields are left out.
    """
    log = computed(log, {"_logged": F.json_object_keys(raw)})
    log = log.join(declared_fields(schema), "eventid", "left")
    logged = F.col("_logged")
    header = F.array(*[F.lit(f) for f in [*_HEADER, *_PLACED]])
    declared = F.coalesce("declared", F.array().cast("array<string>"))

    def only(name: str) -> Column:
        return F.array_intersect(logged, F.array(F.lit(name)))

    # Names are unique in a log event and in a declaration.
    specific = F.array_except(declared, header)
    carried = F.array_intersect(specific, logged)
    undeclared = F.array_except(logged, F.concat(header, declared))
    return log.withColumns({
        "fields": F.concat(only("timestamp"), carried, undeclared, only("message")),
        "absent": F.array_except(specific, logged),
    }).drop("declared", "_logged")


def _text(value: Column, json: Column) -> Column:
    """A value as the log shows it: text without its quotes, anything else as JSON."""
    return F.when(json.startswith('"'), F.try_variant_get(value, "$", "string")).otherwise(
        F.coalesce(json, F.lit("null"))
    )


def explode_fields(log: DataFrame, raw: str = "raw", keys: Sequence[str] = ("session", "pos")) -> DataFrame:
    """(field, item, value) rows: a list gives a row per item, an empty list shows ``[]``."""
    fields = log.select(
        *keys,
        F.explode(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")).alias("field", "_v"),
    )
    fields = fields.withColumn("_json", F.to_json("_v"))
    json = F.col("_json")
    listed = F.transform(
        F.try_variant_get("_v", "$", "array<variant>"),
        lambda i: F.struct(i.alias("v"), F.to_json(i).alias("json")),
    )
    items = F.transform(listed, lambda i: _text(i["v"], i["json"]))
    values = F.when(json.startswith("["), items).otherwise(F.array(_text(F.col("_v"), json)))
    # Only an empty list has no value.
    return fields.select(*keys, "field", F.posexplode_outer(values).alias("item", "value")).withColumns(
        {"item": F.coalesce("item", F.lit(0)), "value": F.coalesce("value", F.lit("[]"))}
    )
