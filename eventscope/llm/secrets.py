"""Secrets in texts, and who owns them.

Patterns find candidates on each row. Then the corpus speaks: a candidate's hash is counted
by distinct texts, and by those of them that each owner has. If no owner has all of them,
others wrote the value into texts of their own, and it is an example that people copy. If
one has, in however many texts and whoever has copies of them, and the value looks made by
chance, it is taken for a live credential and marked by a span of its own.
"""

from pyspark.sql import Column, DataFrame, functions as F

from eventscope.llm.frames import saved

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# The longest run from a place where one can start is the match in both; a shorter run
# holds no match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live")

# A live value has one owner, letters and digits, so many different characters, and none of
# the words of made-up examples.
DIFFERENT = 8
EXAMPLE = r"(?i)example|sample|dummy|change_?me|placeholder|your[_-]|xxxx|0123456789|123456789|abcdefgh"

# Places are summed in stretches of this many matches.
STRETCH = 256


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Sums up to and with each element, in stretches, so that it takes n * STRETCH steps."""
    def summed(numbers, start):
        state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            numbers, state,
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")),
            lambda s: s["out"],
        )

    zero = F.lit(0)
    stretches = F.transform(
        F.sequence(zero, F.greatest(F.floor((F.size(sizes) - 1) / STRETCH).cast("int"), zero)),
        lambda i: F.slice(sizes, i * STRETCH + 1, STRETCH),
    )
    return _let(stretches, lambda parts: _let(
        summed(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero),
        lambda ends: F.flatten(F.transform(
            parts, lambda p, i: summed(p, F.when(i == 0, zero).otherwise(F.coalesce(F.get(ends, i - 1), zero)))
        )),
    ))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``start``, ``past`` (code points), and ``value`` for each match, left to right and not
    overlapping; ``group`` must end where the match ends."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)

    def placed(all_, gaps):
        sizes = F.flatten(F.transform(all_, lambda m, i: F.array(F.length(F.get(gaps, i)), F.length(m))))
        return _let(values, lambda v: _let(_running(sizes), lambda ends: F.transform(all_, lambda m, i: F.struct(
            F.get(ends, i * 2).alias("start"), F.get(ends, i * 2 + 1).alias("past"), F.get(v, i).alias("value"),
        ))))

    none = F.array().cast("array<struct<start:int,past:int,value:string>>")
    # Most texts have no match and are looked through once.
    return F.when(
        text.rlike(pattern), _let(found, lambda all_: _let(between, lambda gaps: placed(all_, gaps)))
    ).otherwise(none)


def _spans(column: str, kind: int) -> Column:
    return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["past"].alias("past")))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["past"].cast("string")
    )), ",")


def scan(df: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``base`` (spans of the three patterns), ``spans`` (with
    those of live values), ``n_live`` and ``n_example`` (values that are not live).

    A span has ``start``, ``kind`` (index in ``KINDS``) and ``past``; spans are sorted. A
    null text counts as empty; null owners are one owner. Saves what the patterns found, not
    the texts; columns of ``df`` with the new names are replaced.
    """
    new = ("base", "spans", "n_live", "n_example")
    given = [c for c in df.columns if c not in (text, *new)]
    body = F.coalesce(F.col(text), F.lit(""))
    found = df.select(
        *[F.col(f"`{c}`") for c in given],
        F.col(owner).alias("_owner"), body.alias("_body"),
        F.filter(matches(body, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST).alias("_assign"),
        matches(body, ACCESS).alias("_access"),
        matches(body, HEX).alias("_hex"),
    )

    def live_looking(value):
        return (
            value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(EXAMPLE)
            & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)
        )

    values = F.array_distinct(F.transform(
        F.concat("_assign", "_access", "_hex"),
        lambda m: F.struct(
            (m["past"] - F.length(m["value"])).alias("start"), m["past"].alias("past"),
            F.sha2(m["value"].cast("binary"), 256).alias("hash"), live_looking(m["value"]).alias("looks"),
        ),
    ))
    rows = saved(found.select(
        *[F.col(f"`{c}`") for c in given], "_owner",
        F.when(F.size(values) > 0, F.sha2(F.col("_body").cast("binary"), 256)).alias("_digest_of_text"),
        F.monotonically_increasing_id().alias("_row"),
        F.array_sort(F.concat(_spans("_assign", 0), _spans("_access", 1), _spans("_hex", 2))).alias("base"),
        values.alias("_values"),
    ))
    candidates = rows.select("_row", "_digest_of_text", "_owner", F.inline("_values"))
    classes = saved(ownership(candidates, "hash", "_digest_of_text", "_owner").withColumnRenamed("hash", "_hash"))
    # Both sides come from files, so Spark splits the candidates of a hash that is everywhere.
    known = candidates.join(classes, F.col("hash") == F.col("_hash"))
    live = F.col("looks") & (F.col("of_one_owner") == F.col("texts"))
    judged = (
        known.select("_row", "start", "past", live.alias("live"))
        .groupBy(F.col("_row").alias("_of"))
        .agg(
            F.collect_list(F.when(F.col("live"), F.struct("start", F.lit(3).alias("kind"), "past"))).alias("_live"),
            F.sum(F.when(F.col("live"), 0).otherwise(1)).alias("n_example"),
        )
    )
    none = F.array().cast("array<struct<start:int,kind:int,past:int>>")
    return rows.join(judged, F.col("_row") == F.col("_of"), "left").select(
        *[F.col(f"`{c}`") for c in given], "base",
        F.array_sort(F.concat("base", F.coalesce("_live", none))).alias("spans"),
        F.coalesce(F.size("_live").cast("long"), F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def ownership(candidates: DataFrame, hash_: str, text: str, owner: str) -> DataFrame:
    """``texts``, the distinct texts that have each hash, and ``of_one_owner``, the most of them
    that one owner has. Partial sums go before each shuffle."""
    nobody = F.lit(None).cast(candidates.schema[owner].dataType)
    sides = F.array(
        F.struct(F.lit(False).alias("all"), F.col(owner).alias("holder")),
        F.struct(F.lit(True).alias("all"), nobody.alias("holder")),
    )
    return (
        candidates.select(hash_, text, F.inline(sides)).distinct()
        .groupBy(hash_, "all", "holder").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(hash_).agg(
            F.max(F.when(F.col("all"), F.col("n"))).alias("texts"),
            F.max(F.when(~F.col("all"), F.col("n"))).alias("of_one_owner"),
        )
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each live span replaced by ``mask``. Live spans are values and at most
    nested; an inner one goes with the outer."""
    live = F.filter(spans, lambda s: s["kind"] == 3)

    def outer(all_):
        return F.filter(all_, lambda s: ~F.exists(all_, lambda o: (
            (o["start"] <= s["start"]) & (o["past"] >= s["past"])
            & ((o["past"] - o["start"]) > (s["past"] - s["start"]))
        )))

    def joined(all_):
        parts = F.transform(all_, lambda s, i: F.concat(
            F.substring(
                text,
                F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(all_, i - 1)["past"], F.lit(0))) + 1,
                s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(all_, i - 1)["past"], F.lit(0))),
            ),
            F.lit(mask),
        ))
        rest = F.substring(text, F.element_at(all_, -1)["past"] + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(live) == 0, text).otherwise(_let(_let(live, outer), joined))
