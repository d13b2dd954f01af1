"""Filter paths such as ``threat-intel/greynoise/result``."""

from pyspark.sql import Column, functions as F

from eventscope.functions.values import column


def path_text(parts) -> Column:
    return F.array_join(column(parts), "/")


def path_leaf(path) -> Column:
    return F.element_at(F.split(column(path), "/"), -1)


def path_prefixes(path) -> Column:
    """The path itself and all that lead to it, shortest first."""
    parts = F.split(column(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def ancestors(path) -> Column:
    prefixes = path_prefixes(path)
    return F.slice(prefixes, F.lit(1), F.size(prefixes) - 1)


def parent(path) -> Column:
    """Path without its last part; null at the top."""
    path = column(path)
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    )
