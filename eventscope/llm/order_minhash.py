"""Order MinHash fingerprints: likeness of texts that edits lower and reordering too.

The k-mers of a text are ``K`` words in a row (words of more than 16 letters count as
several), numbered by occurrence, so that a repeated k-mer is several. A hash of k-mer and number
puts each into one of ``BINS`` bins; in every bin the ``PICKED`` with the least hashes are
taken, put in the order of the text and hashed together. Two texts are as alike as the
share of bins that agree, among those that are not empty in both.

Everything is array functions on one row: the numbering sorts (hash, place) pairs packed
into one long and cuts the runs of equal hashes; the picking does the same with bins.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventscope.llm.frames import saved
from eventscope.operators.ordering import range_sorted

K, PICKED, BINS = 3, 2, 32
WORDS = r"\S{1,16}"
# A text of 2 GB, the most there can be, has fewer words than this.
PLACE_BITS = 30
EMPTY_BIN = "--------"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _runs(values: Column, key, body) -> Column:
    """``body(first, length)`` for each run of equal ``key`` in a sorted array."""
    numbers = F.sequence(F.lit(0), F.size(values) - 1)
    starts = F.filter(
        numbers, lambda i: (i == 0) | (key(F.get(values, i)) != key(F.get(values, i - 1)))
    )
    return _let(starts, lambda s: F.transform(
        s, lambda first, j: body(first, F.coalesce(F.get(s, j + 1), F.size(values)) - first)
    ))


def _hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _bin_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - (BINS - 1).bit_length())


def _place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _pack(hash_: Column, place: Column) -> Column:
    return F.shiftleft(hash_, PLACE_BITS).bitwiseOR(place)


def _numbered(words: Column) -> Column:
    """A hash of k-mer and occurrence with the place, for each k-mer; sorted."""
    last = F.greatest(F.size(words) - K, F.lit(0))
    kmers = F.transform(
        F.sequence(F.lit(0), last),
        # A text shorter than K words is one k-mer; words it does not have are null.
        lambda i: _pack(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i.cast("long")),
    )
    return F.sort_array(_let(F.sort_array(kmers), lambda s: F.flatten(_runs(
        s, _hash_of,
        lambda first, n: F.transform(
            F.slice(s, first + 1, n), lambda x, occurrence: _pack(F.xxhash64(_hash_of(x), occurrence), _place_of(x))
        ),
    ))))


def _picked(numbered: Column) -> Column:
    """``bin`` and ``tuple`` for each bin with k-mers."""
    hash_bits = 64 - PLACE_BITS

    def of_bin(first, n):
        least = F.slice(numbered, first + 1, F.least(n, F.lit(PICKED)))
        # Place first, to sort by it; the hash is kept beside it.
        in_text = F.sort_array(F.transform(
            least, lambda x: F.shiftleft(_place_of(x), hash_bits).bitwiseOR(_hash_of(x))
        ))
        hashes = F.transform(in_text, lambda x: x.bitwiseAND(F.lit((1 << hash_bits) - 1)))
        return F.struct(
            _bin_of(F.get(numbered, first)).cast("int").alias("bin"), F.xxhash64(hashes).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tuple")
        )

    return _runs(numbered, _bin_of, of_bin)


def signature(text: Column) -> Column:
    """``BINS`` numbers of 32 bits, null for an empty bin; all are null for a text without words."""
    def of_words(words):
        picked = _let(_numbered(words), _picked)
        by_bin = _let(F.map_from_entries(picked), lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(m, b)
        ))
        none = F.array_repeat(F.lit(None).cast("long"), BINS)
        return F.when(F.size(words) > 0, by_bin).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Share of bins that agree, from 0 to 1; two texts without words are alike."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    filled = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def as_text(signature_: Column) -> Column:
    return F.array_join(
        F.transform(signature_, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit(EMPTY_BIN))), ""
    )


def followers(df: DataFrame, id: str, digest: str, size: str) -> DataFrame:
    """For each id and digest the next ones in their order, the first after the last, with
    the sizes of both: ``id``, ``digest``, ``size``, ``next_id``, ``next_digest``.

    Rows alike in id and digest are one. Sorted by range and numbered with one count per
    task; neighbours are joined by number.
    """
    kinds = df.groupBy(F.col(id).alias("id"), F.col(digest).alias("digest")).agg(F.first(size).alias("size"))
    rows = range_sorted(kinds, ["id", "digest"])
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per task.
    starts = F.broadcast(counts.select("_part", "first", F.coalesce(before, F.lit(0)).alias("before")))
    total = rows.count()
    numbered = saved(rows.join(starts, "_part").select(
        "id", "digest", "size", (F.col("before") + F.col("_place") - F.col("first")).alias("number")
    ))
    after = numbered.select(
        F.col("id").alias("next_id"), F.col("digest").alias("next_digest"),
        F.pmod(F.col("number") - 1, F.lit(max(total, 1))).alias("number"),
    )
    return numbered.join(after, "number").drop("number")


def edited_texts(df: DataFrame, id: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """``id``, ``digest``, ``text``, ``edited`` and the next row's ``next_id``, ``next_digest``.

    The last ``1 / part`` of the code points give way to as many from the start of the next
    text, or to all of it if it is shorter. The next text is that of the next larger id,
    the first after the last; rows with one id go by a digest of their texts, a null id
    comes first, and rows with the same id and text are one text with one successor. A null
    text counts as empty.
    """
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "digest", F.xxhash64("text")
    )
    # A join key that is never null; ids are compared as text there, and digests beside them.
    def key(column):
        return F.coalesce(F.col(column).cast("string"), F.lit("null")).alias(column + "_key")

    id_back = F.when(F.col("id_key") != "null", F.col("id_key").cast(df.schema[id].dataType))

    order = saved(followers(rows.select("id", "digest", F.length("text").alias("size")), "id", "digest", "size"))
    # Both joins below take just these columns, so that the texts are shuffled once.
    keyed = rows.select(key("id"), "digest", "text")
    wanted = order.select(
        key("next_id"), F.col("next_digest"), key("id"), F.col("digest").alias("to_digest"),
        F.floor(F.col("size") / part).cast("int").alias("wanted"),
    )
    starts = (
        keyed.join(
            wanted.withColumnRenamed("id_key", "to_key"),
            (F.col("id_key") == F.col("next_id_key")) & (F.col("digest") == F.col("next_digest")),
        )
        .select("to_key", "to_digest", F.substring("text", F.lit(1), F.col("wanted")).alias("start"))
        # Rows that are one text bring the same start.
        .groupBy("to_key", "to_digest").agg(F.max("start").alias("start"))
    )
    nexts = order.select(key("id").alias("of_key"), F.col("digest").alias("of_digest"), "next_id", "next_digest")
    size = F.length("text")
    kept = F.substring("text", F.lit(1), size - F.floor(size / part).cast("int"))
    return (
        keyed.join(starts, (F.col("id_key") == F.col("to_key")) & (F.col("digest") == F.col("to_digest")))
        .join(nexts, (F.col("id_key") == F.col("of_key")) & (F.col("digest") == F.col("of_digest")))
        .select(
            id_back.alias("id"), "digest", "text", F.concat(kept, "start").alias("edited"), "next_id", "next_digest"
        )
    )
