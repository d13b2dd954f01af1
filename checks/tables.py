"""The driver's tables in the shapes that the operators read."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventscope import fixed_values as fixed

# Event types of the events table, furthest step first.
LADDER = [
    ("purchase", ("purchase",), ()),
    ("signup", ("signup",), ()),
    ("click", ("click",), ()),
    ("view", ("view",), ()),
    ("error", (), ("",)),
]
EVENT_ORDER = ["view", "click", "signup", "purchase"]
CONNECT, CLOSED = "view", "error"
COLOURS = {"purchase": "#d64550", "signup": "#a970c9", "click": "#e8973a"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a raw log: a session is a user's day."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    k = F.col("k")
    value = F.col("value")
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("eventid"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(value >= 5, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).otherwise("").alias("src_ip"),
        F.when(k == "0", "").otherwise(k).alias("src_port"),
        F.when(value >= 10, F.concat(F.lit("10.1.0."), k)).otherwise("").alias("dst_ip"),
        F.when(value >= 3, k).alias("dst_port"),
        F.concat(F.lit("sensor-"), F.col("event_type")).alias("sensor"),
        F.when(value < 50, "").otherwise(F.col("user_id").cast("string")).alias("uuid"),
        F.when(value < 2, None).otherwise("ssh").alias("protocol"),
        k.alias("duration"),
        value,
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as JSON text per event; fields that are null are not logged."""
    log = raw_log(spark, sf_dir)
    value = F.col("value")
    tags = F.when(value < 4, F.array().cast("array<string>")).when(
        value < 20, F.array("eventid", "duration")
    )
    event = F.struct(
        "eventid",
        "session",
        F.when(value < 30, F.concat(F.lit("m "), "duration")).alias("message"),
        F.col("src_ip"),
        F.lit("z").alias("zeta"),
        F.when(value >= 10, F.lit("root")).alias("username"),
        F.col("duration").cast("int").alias("k"),
        tags.alias("tags"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    return log.select("session", "pos", "eventid", F.to_json(event).alias("raw"))


def field_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields of each event type that occurs."""
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("eventid")).distinct()
    fields = ["eventid", "message", "timestamp", "session", "src_ip", "k", "username"]
    declared = F.array(*[F.lit(f) for f in fields], F.concat(F.lit("of_"), "eventid"))
    return types.select("eventid", F.posexplode(declared).alias("pos", "field"))


def _association(id: Column, title: Column, mode: str, *path: Column) -> Column:
    return F.struct(
        id.alias("id"), title.alias("title"), F.lit("").alias("desc"),
        F.lit(mode).alias("mode"), F.array(*path).alias("filter_paths"),
    )


def association_ids() -> Column:
    """Ids that an order refers to: priority, status, segment, story, and one unknown."""
    return F.array(
        F.concat(F.lit("priority:"), "o_orderpriority"),
        F.concat(F.lit("status:"), "o_orderstatus"),
        F.lit("unknown"),
        F.concat(F.lit("segment:"), "c_mktsegment"),
    )


def associations_of_order() -> Column:
    priority, status, segment, place = (
        F.col(c) for c in ("o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name")
    )
    return F.array(
        _association(F.concat(F.lit("priority:"), priority), priority, fixed.CATEGORY, F.lit("default")),
        _association(F.concat(F.lit("status:"), status), status, fixed.FILTER, F.lit("status"), status),
        _association(F.concat(F.lit("segment:"), segment), segment, fixed.FILTER, F.lit("segment"), segment),
        _association(F.concat(F.lit("story:"), place), place, fixed.NARRATIVE),
    )


def orders_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def _coordinate(per_nation: int, start: int, shift: Column) -> Column:
    """One-decimal text, a little past the valid range at both ends; empty for some."""
    tenths = F.col("c_nationkey") * per_nation + start + shift
    return F.when(F.col("c_custkey") % 11 == 0, "").otherwise((tenths / 10).cast("string"))


def _latitude() -> Column:
    return _coordinate(80, -950, (F.col("c_custkey") % 7) * 5)


def _longitude() -> Column:
    return _coordinate(150, -1800, (F.col("c_custkey") % 13) * 10)


def space_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as linked events: where the customer is, when the order was made."""
    return orders_by_place(spark, sf_dir).select(
        F.col("o_orderkey").alias("event_key"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.col("o_orderdate").alias("datetime"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"),
        F.col("n_name").alias("location"),
        _latitude().alias("latitude"),
        _longitude().alias("longitude"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "P", fixed.SHAPE).otherwise("order").alias("type"),
        F.when(F.col("o_totalprice") < 200000, F.struct(F.col("c_mktsegment").alias("id"))).alias("shape"),
        associations_of_order().alias("associations"),
        F.col("o_custkey").alias("customer"),
        F.concat(F.lit("segment/"), "c_mktsegment").alias("project"),
        F.col("o_totalprice").alias("price"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they might come in, with the faults that the contract looks for."""
    price = F.col("o_totalprice")
    comma = F.when(F.col("c_nationkey") % 5 == 0, F.regexp_replace(_latitude(), r"\.", ",")).otherwise(_latitude())
    return orders_by_place(spark, sf_dir).select(
        F.col("o_orderkey").alias("event_key"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(price >= 5000, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("description"),
        F.when(price < 20000, "")
        .when(price < 40000, "13/45/2020")
        .when(price < 50000, None)
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("date"),
        F.when(price < 10000, "").when(price < 100000, "9:30").when(price < 200000, "").otherwise("17:05:59").alias("time"),
        F.when(price < 45000, comma).when(price > 480000, None).otherwise(comma).alias("latitude"),
        F.when(price > 490000, None).otherwise(_longitude()).alias("longitude"),
        F.when(price < 250000, F.col("c_mktsegment")).otherwise("").alias("shape"),
        association_ids().alias("associations"),
    )


def association_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priority, status and segment that occurs, each once."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    def rows(df, column, prefix, mode):
        value = F.col(column)
        path = [F.lit("default")] if mode == fixed.CATEGORY else [F.lit(prefix), value]
        row = _association(F.concat(F.lit(f"{prefix}:"), value), value, mode, *path)
        return df.select(column).distinct().select(F.inline(F.array(row)))

    both = rows(orders, "o_orderpriority", "priority", fixed.CATEGORY).unionByName(
        rows(orders, "o_orderstatus", "status", fixed.FILTER)
    )
    return both.unionByName(rows(customer, "c_mktsegment", "segment", fixed.FILTER))


def part_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as filters: type, then brand; small ones are filters of the type itself."""
    part = table(spark, sf_dir, "part")
    path = F.when(F.col("p_size") < 3, F.array("p_type")).otherwise(F.array("p_type", "p_brand", "p_name"))
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_partkey").alias("pos"),
        F.lit(fixed.FILTER).alias("mode"),
        path.alias("filter_paths"),
    )


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as regions, with corner texts around a point."""
    supplier = table(spark, sf_dir, "supplier")
    south = F.col("s_nationkey") * 6 - 80
    west = (F.col("s_suppkey") % 300).cast("int") - 150
    def corner(dy: int, dx: int) -> Column:
        return F.concat((south + dy).cast("string"), F.lit(" , "), (west + dx).cast("string"))

    corners = [corner(0, 0), corner(0, 5), corner(5, 5), corner(5, 0), corner(0, 0)]
    return supplier.select(F.col("s_name").alias("name"), F.array(*corners).alias("items"))


def media_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources, with a path of some kind for the length of their text."""
    pages = table(spark, sf_dir, "pages")
    endings = [".png", ".jpg", ".jpeg ", ".mp4", ".md", ".pdf", ".PNG", ""]
    ending = F.element_at(
        F.array(*[F.lit(e) for e in endings]), (F.length("html") % len(endings) + 1).cast("int")
    )
    tweet = F.concat(
        F.lit("https://twitter.com/user_1/status/"), F.length("html").cast("string")
    )
    return pages.select(
        F.col("page_id").cast("string").alias("source_id"),
        F.col("url"),
        F.array(
            "url", F.concat("url", ending), tweet, F.concat(F.lit("https://t.me/c/"), F.col("page_id").cast("string"))
        ).alias("paths"),
    )
