"""Connected components of links between integers, by contraction."""

from pyspark.sql import DataFrame, functions as F

from eventscope.llm.frames import saved


def component_names(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``name`` for every node with a link; nodes have one name if links join them.

    Each round gives every group of nodes the name of the neighbour, or itself, that comes
    first in a random but fixed order, and keeps the links between different names. A star
    takes two rounds, a path shrinks by a constant factor. Rounds are saved, so a lost
    executor never sets them back. The name means nothing beyond that.
    """
    links = saved(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    named = saved(
        links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("name", F.col("node"))
    )

    def ranked(column):
        return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("to"))

    while not links.isEmpty():
        both = links.union(links.select("b", "a").toDF("a", "b"))
        first = saved(
            both.groupBy("a")
            .agg(F.min(ranked("b")).alias("near"))
            .select(F.col("a").alias("old"), F.least("near", ranked("a"))["to"].alias("new"))
        )
        links = saved(
            links.join(first, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
            .join(first, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
            .where("a != b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        named = saved(
            named.join(first, F.col("name") == F.col("old"), "left")
            .select("node", F.coalesce("new", "name").alias("name"))
        )
    return named
