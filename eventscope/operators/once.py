"""Columns that are worked out once."""

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are costly and will be filtered on.

    A filter on a plain column moves below the projection that makes it, and then both
    work it out. Filters stay above a generator, so a one-element ``inline`` keeps the
    values in one place.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
