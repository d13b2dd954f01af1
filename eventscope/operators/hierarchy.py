"""The tree of filter paths."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eventscope.functions.paths import ancestors, parent, path_leaf, path_prefixes, path_text


def path_tree(filters: DataFrame) -> DataFrame:
    """Every path and every path that leads to one, once; a node may be both."""
    nodes = filters.select(F.explode(path_prefixes(path_text("filter_paths"))).alias("path"))
    return nodes.where(F.col("path").isNotNull()).distinct().select(
        "path",
        F.size(F.split("path", "/")).alias("depth"),
        parent("path").alias("parent"),
        path_leaf("path").alias("leaf"),
    )


def sibling_counts(tree: DataFrame) -> DataFrame:
    """Per node, how many others have its parent; the top level has none."""
    below = tree.where(F.col("parent").isNotNull())
    counts = below.groupBy("parent").agg(F.count(F.lit(1)).alias("_n"))
    return tree.join(counts, "parent", "left").select(
        "path", "parent", F.coalesce(F.col("_n") - 1, F.lit(0)).alias("siblings")
    )


def siblings(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes that have the same parent as one of ``keys`` and are not that key."""
    keys = sorted(set(keys))
    parents = {}
    for key in keys:
        if "/" in key:
            parents.setdefault(key.rsplit("/", 1)[0], []).append(key)
    # A key is its own sibling's sibling when two keys share a parent.
    shared = [key for group in parents.values() if len(group) > 1 for key in group]
    lone = [key for key in keys if key not in shared]
    return tree.where(F.col("parent").isin(list(parents)) & ~F.col("path").isin(lone))


def toggle_closure(tree: DataFrame, active: Sequence[str], node: str | None = None) -> DataFrame:
    """What toggling a node toggles: itself, and each node below it if all on the way down
    have the node's own state. All nodes, or just ``node``, as (node, member) rows.

    Whether a node belongs to an ancestor can be read off its own path, so this is one
    pass: from the node upwards, ancestors count until one has the other state.
    """
    active = list(active)
    own = F.col("path").isin(active) if active else F.lit(False)
    up = F.reverse(ancestors("path"))
    others = F.filter(up, lambda a: (a.isin(active) if active else F.lit(False)) != own)
    stop = F.array_position(up, F.get(others, F.lit(0)))
    reached = F.when(F.size(others) == 0, up).otherwise(
        F.slice(up, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))
    )
    rows = tree.select(
        F.explode(F.concat(F.array("path"), reached)).alias("node"), F.col("path").alias("member")
    )
    return rows.where(F.col("node") == node) if node is not None else rows
