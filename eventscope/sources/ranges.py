"""One large JSON document over many tasks.

Files are read as pieces between commas, which Spark cuts into byte ranges like lines, so a
document without line ends spreads as well. A comma divides elements of the document if it
is outside of strings and one level deep, which only what came before can tell. So each
range is summed up first, for both cases: as if it began outside of a string, and inside.
The summaries, a row per range, are composed in the order of the file; then every range
knows how it begins and cuts out its own elements in a second scan. Only the elements that
cross a range's end are shuffled.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from eventscope.sources.payloads import Read, events_of, export_log, missing_rejects, read_text

_ESCAPED = r"(?s)\\."
_STRING = r'"[^"]*("|$)'


def _count(text, signs: str):
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _pieces(files: DataFrame) -> DataFrame:
    """Text between commas, by (file, range) and in order within: quotes that begin or end a
    string, and by how much the nesting deepens if the piece begins outside (inside) of one.

    An escape never reaches over a piece's end, as the comma there is what it would escape.
    """
    plain = F.regexp_replace("value", _ESCAPED, "")
    pieces = files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        "value", plain.alias("plain"),
    )

    def deeper(text):
        rest = F.regexp_replace(text, _STRING, "")
        return (_count(rest, "[{") - _count(rest, "]}")).cast("int")

    return pieces.select(
        "file", "block", "value", _count("plain", '"').cast("int").alias("quotes"),
        deeper(F.col("plain")).alias("outside"), deeper(F.concat(F.lit('"'), "plain")).alias("inside"),
    )


def _runs(batch: pa.RecordBatch):
    """The batch's rows by range: (file, block, first row, row after the last)."""
    files, blocks = batch.column("file"), batch.column("block").to_numpy()
    names = files.dictionary_encode().indices.to_numpy()
    new = np.flatnonzero((blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])) + 1
    bounds = [0, *new.tolist(), len(blocks)]
    for start, end in zip(bounds, bounds[1:]):
        if end > start:
            yield files[start].as_py(), int(blocks[start]), start, end


def _followed(batch, start, end, in_string, depth):
    """Whether each piece ends inside of a string, and how deep, after a given beginning."""
    quotes = np.cumsum(batch.column("quotes").to_numpy()[start:end]) + in_string
    begins = np.concatenate([[in_string], quotes[:-1]]) % 2
    deeper = np.where(
        begins == 1, batch.column("inside").to_numpy()[start:end], batch.column("outside").to_numpy()[start:end]
    )
    return quotes % 2, depth + np.cumsum(deeper)


def _summaries(batches):
    """A row per range: its quotes and, for a beginning outside and inside of a string, the
    change of depth and how many pieces end outside of strings at each relative depth."""
    now, first, states, depths = None, None, None, None

    def row():
        columns = [[now[0]], [now[1]], [first], [states[0]]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        for case in (0, 1):
            columns += [[states[1 + case]], [list(depths[case].items())]]
            kinds += [pa.int64(), pa.map_(pa.int64(), pa.int64())]
        names = ["file", "block", "first", "quotes", "deeper_0", "ends_0", "deeper_1", "ends_1"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for file, block, start, end in _runs(batch):
            if (file, block) != now:
                if now:
                    yield row()
                now, first, states, depths = (file, block), batch.column("value")[start].as_py().strip()[:1], [0, 0, 0], ({}, {})
            for case in (0, 1):
                inside, deep = _followed(batch, start, end, (states[0] + case) % 2, states[1 + case])
                for depth, n in zip(*np.unique(deep[inside == 0], return_counts=True)):
                    depths[case][int(depth)] = depths[case].get(int(depth), 0) + int(n)
                states[1 + case] = int(deep[-1])
            states[0] += int(batch.column("quotes").to_numpy()[start:end].sum())
    if now:
        yield row()


_SUMMARY = (
    "file string, block long, first string, quotes long, deeper_0 long, ends_0 map<long, long>, "
    "deeper_1 long, ends_1 map<long, long>"
)


def _beginnings(pieces: DataFrame) -> DataFrame:
    """How each range begins (in a string, how deep, in which element), and for its file the
    sign it starts with, the last element's number and whether strings and nesting end."""
    ranges = pieces.mapInArrow(_summaries, _SUMMARY)
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    in_string = ranges.withColumn("in_string", so_far("quotes") % 2)
    chosen = in_string.select(
        "file", "block", "first", "quotes", "in_string",
        *[F.when(F.col("in_string") == 1, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")).alias(c) for c in ("deeper", "ends")],
    ).withColumn("depth", so_far("deeper"))
    commas = chosen.withColumn("commas", F.coalesce(F.try_element_at("ends", 1 - F.col("depth")), F.lit(0)))
    return commas.select(
        "file", "block", "in_string", "depth", so_far("commas").alias("number"),
        F.first("first").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("root"),
        # The last piece has no comma after it, and ends at depth 0.
        F.sum("commas").over(whole).alias("last"),
        ((F.sum("quotes").over(whole) % 2 == 0) & (F.sum("deeper").over(whole) == 0)).alias("sound"),
    )


def _cut(batches):
    """Elements of each range; ``whole`` is false for those that cross its end."""
    now, open_, at, begun, states = None, [], 0, False, (0, 0)
    out: list[tuple] = []

    def fragment():
        if open_:
            out.append((now[0], at, now[1], ",".join(open_), False))

    def rows():
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "number", "block", "text", "whole"]
        )
        out.clear()
        return made

    for batch in batches:
        values = batch.column("value")
        for file, block, start, end in _runs(batch):
            if (file, block) != now:
                fragment()
                now, open_, begun = (file, block), [], False
                at = batch.column("number")[start].as_py()
                states = (batch.column("in_string")[start].as_py(), batch.column("depth")[start].as_py())
            inside, deep = _followed(batch, start, end, *states)
            states = (int(inside[-1]), int(deep[-1]))
            from_ = start
            for i in np.flatnonzero((inside == 0) & (deep == 1)) + start + 1:
                open_ += values.slice(from_, i - from_).to_pylist()
                out.append((file, at, block, ",".join(open_), begun))
                at, open_, begun, from_ = at + 1, [], True, int(i)
            open_ += values.slice(from_, end - from_).to_pylist()
        yield rows()
    fragment()
    yield rows()


def elements(spark: SparkSession, paths: Sequence[str], table: str = "events") -> tuple[DataFrame, DataFrame]:
    """Elements of the array or object that each file holds, as rows (file, number, root, text),
    and the rejects: paths that name nothing, and files whose strings or nesting do not end.

    ``root`` is the sign that the document starts with; of an object, an element is a key and
    its value. How large ranges are is ``spark.sql.files.maxPartitionBytes``. An element is
    one row.
    """
    files, missing = read_text(spark, paths, lineSep=",")
    rejects = missing_rejects(spark, table, missing)
    if files is None:
        return spark.createDataFrame([], "file string, number long, root string, text string"), rejects
    pieces = _pieces(files)
    begins = _beginnings(pieces)
    # A row per range. The join must leave the pieces in the order of the file.
    known = pieces.join(F.broadcast(begins.where("sound").drop("root", "last", "sound")), ["file", "block"])
    cut = known.mapInArrow(_cut, "file string, number long, block long, text string, whole boolean")
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    crossing = cut.where("NOT whole").groupBy("file", "number").agg(F.array_join(parts["text"], ",").alias("text"))
    found = cut.where("whole").select("file", "number", "text").unionByName(crossing)
    ends = begins.groupBy("file").agg(
        F.max("root").alias("root"), F.max("last").alias("last"), F.min("sound").alias("sound")
    )
    text = F.when(F.col("number") == 0, F.regexp_replace("text", r"^[\s﻿]*[\[{]", "")).otherwise(F.col("text"))
    text = F.when(F.col("number") == F.col("last"), F.regexp_replace(text, r"[\]}]\s*$", "")).otherwise(text)
    rows = found.join(F.broadcast(ends.drop("sound")), "file").withColumn("text", text)
    # A document without elements has one blank text.
    rows = rows.where(~((F.col("last") == 0) & (F.trim(F.regexp_replace("text", r"\s", "")) == "")))
    broken = ends.where("NOT sound").select(
        F.lit(table).alias("table"), F.col("file").alias("id"), F.lit(f"{table} could not be read").alias("message"),
        F.lit(None).cast("string").alias("row_json"),
    )
    return rows.select("file", "number", "root", "text"), rejects.unionByName(broken)


def _rejected(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table"), F.col("file").alias("id"), F.lit("element is not JSON").alias("message"),
        F.col("text").alias("row_json"),
    )


def read_large_events(spark: SparkSession, paths: Sequence[str], custom_fields: Sequence[tuple[str, str]] = ()) -> Read:
    """Events of large payloads, as ``read_events`` reads them. Of a document whose nesting is
    sound, only the elements that are not JSON are rejects."""
    rows, rejects = elements(spark, paths)
    parsed = rows.where(F.col("root") == "[").withColumn("event", F.try_parse_json("text"))
    pos = F.struct("file", F.lit(0).cast("long").alias("block"), F.col("number").alias("place")).alias("pos")
    good = parsed.where(F.col("event").isNotNull()).select(pos, "event")
    return Read(events_of(good, custom_fields), rejects.unionByName(_rejected(parsed.where(F.col("event").isNull()), "events")))


def read_large_export(spark: SparkSession, paths: Sequence[str]) -> Read:
    """Raw log of large session exports, as ``read_session_export`` reads them; a session is
    one row until its events are exploded."""
    rows, rejects = elements(spark, paths)
    records = rows.where(F.col("root") == "{").withColumn("text", F.concat(F.lit("{"), "text", F.lit("}")))
    sound = F.try_parse_json("text").isNotNull()
    return Read(export_log(records.where(sound)), rejects.unionByName(_rejected(records.where(~sound), "events")))
