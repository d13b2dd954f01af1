"""Contracts: check rows, keep the failing ones with the reason."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from eventscope import fixed_values as fixed
from eventscope.functions.values import blank_to_null, decimal_point, event_time
from eventscope.operators.once import computed

REJECTS_SCHEMA = "table string, id string, message string, row_json string"

@dataclass(frozen=True)
class Contract:
    """Text and list fields of a table; ``required`` ones must be there, ``filled`` ones
    must not be empty either."""

    table: str
    text: Sequence[str]
    lists: Sequence[str] = ()
    required: Sequence[str] = ()
    filled: Sequence[str] = ()
    rules: Sequence[tuple[str, str]] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [*self.text, *self.lists]


EVENT = Contract(
    "events",
    fixed.EVENT_TEXT,
    fixed.EVENT_LISTS,
    required=["description"],
    rules=[
        (
            "latitude and longitude must come together",
            "(latitude is null) <> (longitude is null)",
        ),
        ("date or latitude must be given", "date is null and latitude is null"),
    ],
)


def _dimension(table: str, **rules) -> Contract:
    return Contract(table, fixed.DIMENSION_TEXT[table], fixed.DIMENSION_LISTS[table], **rules)


DIMENSIONS = {
    "associations": _dimension("associations", required=["id", "title", "mode"]),
    "sites": _dimension(
        "sites",
        required=["id", "description", "site", "latitude", "longitude"],
        filled=["id", "site", "latitude", "longitude"],
    ),
    "sources": _dimension("sources", required=["id", "paths"], filled=["id"]),
    "regions": _dimension("regions", required=["name", "items"], filled=["name"]),
    "shapes": _dimension("shapes", rules=[("a shape must be given", "coalesce(shape, '') = ''")]),
}


def with_custom_fields(contract: Contract, custom_fields: Sequence[tuple[str, str]]) -> Contract:
    """Event contract with the caller's (name, kind) fields; kind is text, link or list."""
    return Contract(
        contract.table,
        [*contract.text, *[k for k, kind in custom_fields if kind in ("text", "link")]],
        [*contract.lists, *[k for k, kind in custom_fields if kind == "list"]],
        contract.required,
        contract.filled,
        contract.rules,
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def messages(tests: Sequence[tuple[Column, str]]) -> Column:
    """The messages of those tests that hold."""
    found = [F.when(test, F.lit(message)) for test, message in tests]
    return F.array_compact(F.array(*found)).cast("array<string>")


def type_errors(contract: Contract, variant: Column) -> Column:
    """Messages for fields of a JSON object that hold the wrong kind of value."""
    tests = []
    for name in contract.columns:
        kind = F.schema_of_variant(F.try_variant_get(variant, _json_path(name), "variant"))
        if name in contract.lists:
            # A list that may be left empty is sometimes given as empty text.
            empty = F.try_variant_get(variant, _json_path(name), "string") == ""
            allowed = kind.startswith("ARRAY")
            if name == "affil_s":
                allowed |= F.coalesce(empty, F.lit(False))
            tests.append((kind.isNotNull() & ~allowed, f"{name} must be a list"))
        else:
            tests.append((kind.isNotNull() & (kind != "STRING"), f"{name} must be text"))
    return messages(tests)


def _json_path(name: str) -> str:
    return f"$['{name}']"


def fields_of(contract: Contract, variant: Column) -> dict[str, Column]:
    """The contract's fields of a JSON object as typed columns."""
    kinds = {**{n: "string" for n in contract.text}, **{n: "array<string>" for n in contract.lists}}
    return {n: F.try_variant_get(variant, _json_path(n), kinds[n]) for n in contract.columns}


def contract_errors(df: DataFrame, contract: Contract) -> Column:
    """Messages of the rules that a typed row breaks, after those found when reading."""
    tests = [(F.col(n).isNull(), f"{n} is required") for n in contract.required if n in df.columns]
    tests += [(F.lit(True), f"{n} is required") for n in contract.required if n not in df.columns]
    tests += [(F.col(n) == "", f"{n} must not be empty") for n in contract.filled if n in df.columns]
    tests += [(F.expr(rule), message) for message, rule in contract.rules]
    errors = messages(tests)
    if "type_errors" not in df.columns:
        return errors
    # A required field of the wrong type is there, though it reads as null.
    found = F.coalesce("type_errors", _none())
    of_wrong_type = F.transform(found, lambda m: F.concat(_subject(m), F.lit(" is required")))
    return F.concat(found, F.filter(errors, lambda m: ~F.array_contains(of_wrong_type, m)))


def _subject(message: Column) -> Column:
    return F.element_at(F.split(message, " "), 1)


def split_by_errors(df: DataFrame, table: str, errors: Column, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the others as (table, id, message, row_json)."""
    checked = df.withColumn("_errors", errors)
    ok = checked.where(F.size("_errors") == 0).drop("_errors", "type_errors")
    row_id = F.coalesce(blank_to_null(F.col(id_column).cast("string")), F.lit("-")) if id_column in df.columns else F.lit("-")
    shown = [c for c in df.columns if c != "type_errors"]
    rejects = checked.where(F.size("_errors") > 0).select(
        F.lit(table).alias("table"),
        row_id.alias("id"),
        F.array_join("_errors", "; ").alias("message"),
        F.to_json(F.struct(*shown)).alias("row_json"),
    )
    return ok, rejects


def undated_text(date="date", time="time") -> Column:
    """Rows with an empty date and an empty time are left out without a word."""
    return F.coalesce((F.col(date) == "") & (F.col(time) == ""), F.lit(False))


def validate_events(df: DataFrame, custom_fields: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    contract = with_custom_fields(EVENT, custom_fields)
    missing = [c for c in contract.columns if c not in df.columns]
    lists = set(contract.lists)
    df = df.withColumns({
        c: F.lit(None).cast("array<string>" if c in lists else "string") for c in missing
    }) if missing else df
    df = df.where(~undated_text())
    return split_by_errors(df, "events", contract_errors(df, contract))


def validate_dimension(kind: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    contract = DIMENSIONS[kind]
    if kind == "sources" and "source_id" in df.columns:
        df = df.where(F.col("source_id") != "")
    return split_by_errors(df, kind, contract_errors(df, contract), "name" if kind == "regions" else "id")


def normalise_coordinates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: decimal_point(c) for c in ("latitude", "longitude")})


def parse_event_time(
    df: DataFrame, date_format: str = fixed.DATE_FORMAT, time_format: str = fixed.TIME_FORMAT
) -> tuple[DataFrame, DataFrame]:
    """Adds ``datetime``; rows whose time cannot be read are set aside."""
    timed = computed(df, {"datetime": event_time("date", "time", date_format, time_format)})
    errors = messages([(F.col("datetime").isNull(), "date or time cannot be read")])
    ok, rejects = split_by_errors(timed, "events", errors)
    return ok, rejects


def duplicate_keys(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Second and later rows of each key: those after the key's first place."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    first = (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    return df.join(first, keys).where(F.struct(*order) > F.col("_first")).drop("_first")


def repeated_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of extra rows."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return counts.where(F.col("extra") > 0)


def first_definitions(df: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row per key: the first."""
    others = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_row"), F.min(order).alias(order))
    return first.select(key, order, "_row.*")


def rejects_summary(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("table").agg(F.count(F.lit(1)).alias("rejected"))


def parse_regions(regions: DataFrame) -> DataFrame:
    """Corner texts ``"lat, lon"`` as (lat, lon) points, blanks removed."""
    def point(item):
        parts = F.split(F.regexp_replace(item, r"\s", ""), ",")
        return F.struct(
            F.get(parts, F.lit(0)).try_cast("double").alias("lat"),
            F.get(parts, F.lit(1)).try_cast("double").alias("lon"),
        )

    return regions.withColumn("points", F.transform("items", point)).drop("items")


def by_mode(associations: DataFrame, mode: str) -> DataFrame:
    return associations.where(F.col("mode") == mode)


def default_categories(associations: DataFrame) -> DataFrame:
    """Titles that are active at the start: those of every category."""
    return by_mode(associations, fixed.CATEGORY).select("title").distinct()


def default_shapes(shapes: DataFrame) -> DataFrame:
    """Shape ids that are active at the start: all."""
    return shapes.select("id").distinct()


def enabled_sites(sites: DataFrame) -> DataFrame:
    number = F.trim("enabled").try_cast("double")
    return sites.where(F.coalesce(number, F.lit(0.0)) != 0)


def in_time_order(events: DataFrame) -> DataFrame:
    """For a sink only: nothing in the library needs sorted rows."""
    return events.orderBy("datetime", "pos")
