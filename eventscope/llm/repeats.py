"""Removes strings that an earlier document has: ``bwt`` on pages and buckets."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventscope.llm import bwt

# Bytes of text in a page, about, and for each bucket; buckets for each shuffle partition at
# least.
PAGE_BYTES, BUCKET_BYTES, BUCKETS = 2 << 20, 64 << 20, 2

_KEYS = pa.schema([("_bucket", pa.int32()), ("_page", pa.int64()), ("keys", pa.binary())])
_SENT = pa.schema([
    ("_bucket", pa.int32()), ("_page", pa.int64()), ("local", pa.bool_()),
    ("places", pa.binary()), ("contexts", pa.binary()), ("numbers", pa.binary()), ("bounds", pa.binary()),
])
_ANSWERS = pa.schema([
    ("_page", pa.int64()), ("local", pa.bool_()), ("places", pa.binary()), ("masks", pa.binary()), ("firsts", pa.binary()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _page(table: pa.Table) -> tuple[bwt.Page, list[int]]:
    """The documents of a page by number and text, and which rows they are. The order of
    rows in a group is not given, so it is made here."""
    numbers = table.column("_number").to_pylist()
    texts = table.column("_text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(numbers)), key=lambda i: (numbers[i], texts[i]))
    return bwt.Page.of([numbers[i] for i in order], [texts[i] for i in order]), order


def _keys(found: bwt.Anchors, buckets: int) -> np.ndarray:
    """Bucket above 32 bits of the hash."""
    high = (found.hash >> np.uint64(32)) % np.uint64(buckets)
    return (high << np.uint64(32)) | (found.hash & np.uint64(0xFFFFFFFF))


def _by_bucket(sorted_keys: np.ndarray):
    """``bucket``, slice for each bucket in sorted keys."""
    owner = (sorted_keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    for a, b in zip(starts, [*starts[1:], len(owner)]):
        yield int(owner[a]), slice(int(a), int(b))


def _offer(buckets: int):
    """Step 1, page: its anchors, for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        page, _ = _page(table)
        number = table.column("_page")[0].as_py()
        keys = np.unique(_keys(bwt.anchors(page), buckets))
        return _table(_KEYS, [
            (bucket, number, keys[at].astype("<u4").tobytes()) for bucket, at in _by_bucket(keys)
        ])

    return run


def _met(table: pa.Table) -> pa.Table:
    """Step 1, bucket: for each page the anchors that another page has too."""
    parts = [np.frombuffer(k, "<u4") for k in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.empty(len(keys), dtype=bool)
    shared[order] = np.r_[same, False] | np.r_[False, same]
    bucket = table.column("_bucket")[0].as_py()
    rows, at = [], 0
    for number, part in zip(table.column("_page").to_pylist(), parts):
        here = part[shared[at : at + len(part)]]
        at += len(part)
        if len(here):
            rows.append((bucket, number, here.tobytes()))
    return _table(_KEYS, rows)


def _send(buckets: int):
    """Step 2, page: contexts of the anchors that several documents have."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_SENT, [])
        page, _ = _page(docs)
        number = docs.column("_page")[0].as_py()
        found = bwt.anchors(page)
        keys = _keys(found, buckets)
        elsewhere = [np.zeros(0, dtype=np.uint64)]
        for bucket, part in zip(answers.column("_bucket").to_pylist(), answers.column("keys").to_pylist()):
            elsewhere.append(np.frombuffer(part, "<u4").astype(np.uint64) | np.uint64(bucket << 32))
        wanted = np.isin(keys, np.concatenate(elsewhere)) | bwt.several_documents(keys, found.doc)
        found, keys = found[wanted], keys[wanted]
        contexts = bwt.contexts(page, found)
        # Contexts are most of what is shuffled.
        pack = zstandard.ZstdCompressor(level=1).compress
        first, same_document, own = bwt.fold(page, found, contexts)

        follows = np.flatnonzero(~own & same_document)
        again = np.flatnonzero(~same_document)
        rows = []
        if len(follows) or len(again):
            rows.append((
                number % buckets, number, True, found.place[again].tobytes(),
                found.place[follows].tobytes(), found.place[first[follows]].tobytes(), None,
            ))
        sent = np.flatnonzero(own)
        sent = sent[np.argsort(keys[sent], kind="stable")]
        for bucket, at in _by_bucket(keys[sent]):
            part = sent[at]
            bounds = np.stack([found.low[part], found.high[part]]).astype(np.uint8)
            rows.append((
                bucket, number, False, found.place[part].tobytes(), pack(contexts[part].tobytes()),
                page.numbers[found.doc[part]].tobytes(), bounds.tobytes(),
            ))
        return _table(_SENT, rows)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Step 3, bucket: the windows that a smaller document has too. What a page told itself
    goes back to it."""
    rows, parts, owners = [], [], []
    for row in table.to_pylist():
        if row["local"]:
            rows.append((row["_page"], True, row["places"], row["contexts"], row["numbers"]))
            continue
        numbers = np.frombuffer(row["numbers"], np.int64)
        low, high = np.frombuffer(row["bounds"], np.uint8).reshape(2, -1)
        contexts = zstandard.decompress(row["contexts"])
        parts.append((np.frombuffer(contexts, np.uint8).reshape(-1, bwt.WIDTH), numbers, low, high))
        owners.append((row["_page"], np.frombuffer(row["places"], np.int64)))
    if parts:
        for (number, places), masks in zip(owners, bwt.repeats(parts)):
            hit = masks != 0
            if hit.any():
                rows.append((number, False, places[hit].tobytes(), masks[hit].tobytes(), None))
    return _table(_ANSWERS, rows)


def _cut(id_type: pa.DataType, with_kept: bool):
    """Step 4, page: what is removed of each document."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        page, order = _page(docs)
        places, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        follows, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row in answers.to_pylist():
            here = np.frombuffer(row["places"], np.int64)
            places.append(here)
            if row["local"]:
                masks.append(bwt.all_windows(page, here))
                follows.append(np.frombuffer(row["masks"], np.int64))
                firsts.append(np.frombuffer(row["firsts"], np.int64))
            else:
                masks.append(np.frombuffer(row["masks"], np.uint32))
        places, masks, follows, firsts = map(np.concatenate, (places, masks, follows, firsts))
        if len(places) and len(firsts):
            by_place = np.argsort(places, kind="stable")
            at = by_place[np.searchsorted(places[by_place], firsts).clip(max=len(places) - 1)]
            known = places[at] == firsts
            places = np.concatenate([places, follows[known]])
            masks = np.concatenate([masks, masks[at[known]]])
        removed = bwt.removed_bytes(page, places, masks)

        rows = []
        for i, (a, b) in zip(order, zip(page.starts, page.ends)):
            out = removed[a:b]
            kept = page.data[a:b][~out].tobytes()
            spans = int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1))
            row = (docs.column("_id")[i].as_py(), int(b - a), int(out.sum()), spans, hashlib.sha256(kept).hexdigest())
            rows.append(row + ((kept,) if with_kept else ()))
        schema = [("_id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return _table(pa.schema(schema + [("kept", pa.binary())] * with_kept), rows)

    return run


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """For each row its ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, if asked for, the ``kept`` bytes.

    A byte goes if it lies in a string of 50 bytes that also starts in a row with a smaller
    id (an integer). Texts are their UTF-8 bytes, null is empty; rows with equal ids
    take nothing from each other, a null id is smaller than all others. Measures the texts
    while the plan is built; the rest is one plan, which shuffles the texts once and reads
    that shuffle three times.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        F.col(f"`{id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    )
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    pages, buckets = size // PAGE_BYTES + 1, max(BUCKETS * partitions, size // BUCKET_BYTES + 1)
    # The input's partition is in the hash, so that rows alike in all columns are spread.
    paged = rows.select(
        "_id", F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63))).alias("_number"), "_text",
        F.pmod(F.xxhash64("_id", "_text", F.spark_partition_id()), F.lit(pages)).alias("_page"),
    )
    by_page = paged.groupBy("_page")
    offered = by_page.applyInArrow(_offer(buckets), _ddl(_KEYS))
    met = offered.groupBy("_bucket").applyInArrow(_met, _ddl(_KEYS))
    sent = by_page.cogroup(met.groupBy("_page")).applyInArrow(_send(buckets), _ddl(_SENT))
    answers = sent.groupBy("_bucket").applyInArrow(_answer, _ddl(_ANSWERS))
    kind = df.schema[id].dataType
    schema = f"_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = by_page.cogroup(answers.groupBy("_page")).applyInArrow(
        _cut(to_arrow_type(kind), kept), schema + ", kept binary" * kept
    )
    return cut.withColumnRenamed("_id", id)
