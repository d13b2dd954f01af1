"""Near duplicates by SimHash fingerprints that differ in few bits.

Two fingerprints of 64 bits that differ in at most d bits agree on some ``shared`` of
``blocks`` blocks if d <= blocks - shared. So every fingerprint goes to the bucket of each
choice of ``shared`` blocks, linked ones meet in at least one bucket, and there their
distance is taken. A bucket hands on a spanning set of links, not all pairs: a walk takes
a fingerprint, finds those near it among the ones not reached yet, and goes on from them,
so a dense cluster of copies is reached in few steps. With more fingerprints, ask for
more shared blocks: a bucket holds about n / 2^(64 * shared / blocks) unlike ones.
"""

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from eventscope.llm.components import component_names
from eventscope.llm.frames import add_columns, saved

SEED = 42
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
# Hashes whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the text's word shingles, repeats included; zero without words.

    A-Z is lower-cased. A bit is set if it is in over half of the shingles' XXH64.
    """
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: len(words) - shingle]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a (signed) long; null counts as empty."""

    def make(batch):
        values = [fingerprint(t, shingle) for t in batch.column(text).to_pylist()]
        return [pa.array(np.array(values, dtype=np.uint64).view(np.int64))]

    return add_columns(df, make, [T.StructField(out, T.LongType())])


def bucket_keys(column: str, blocks: int, shared: int):
    """The bucket of each choice of ``shared`` blocks, as one number that tells both."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(itertools.combinations(range(blocks), shared)):
        key = F.lit(number).cast("long")
        for i in choice:
            width = edges[i + 1] - edges[i]
            part = F.shiftrightunsigned(column, edges[i]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def spanning(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints (distinct, unsigned) as all links would."""
    found, rest = [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= distance
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                queue.extend(reached)
                found.extend((here, r) for r in reached)
    return found


def _links_in(distance: int):
    """Links within the buckets of a partition sorted by bucket and fingerprint."""

    def of(keys: np.ndarray, values: np.ndarray):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        pairs = starts[sizes == 2]
        a, b = values[pairs], values[pairs + 1]
        near = np.bitwise_count(a ^ b) <= distance
        left, right = [a[near]], [b[near]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            found = spanning(values[start : start + size], distance)
            if found:
                x, y = np.array(found, dtype=np.uint64).T
                left.append(x)
                right.append(y)
        columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (left, right)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    def run(batches):
        keys, values = [], []
        for batch in batches:
            k = batch.column("_key").to_numpy()
            v = batch.column("fingerprint").to_numpy().view(np.uint64)
            if not len(k):
                continue
            # What may go on in the next batch waits.
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield of(np.concatenate([*keys, k[:cut]]), np.concatenate([*values, v[:cut]]))
                keys, values = [], []
            elif keys and keys[-1][-1] != k[0]:
                yield of(np.concatenate(keys), np.concatenate(values))
                keys, values = [], []
            keys.append(k[cut:])
            values.append(v[cut:])
        if keys:
            yield of(np.concatenate(keys), np.concatenate(values))

    return run


def links(df: DataFrame, distance: int, blocks: int = 6, shared: int = 2) -> DataFrame:
    """``a``, ``b``: links that join what all links of up to ``distance`` bits would join.

    ``df`` has each ``fingerprint`` once. No bucket is left out or cut.
    """
    if distance > blocks - shared:
        raise ValueError("blocks - shared must be at least the distance")
    keyed = df.select("fingerprint", F.explode(bucket_keys("fingerprint", blocks, shared)).alias("_key"))
    met = keyed.repartition("_key").sortWithinPartitions("_key", "fingerprint")
    return met.mapInArrow(_links_in(distance), "a long, b long")


def near_groups(
    df: DataFrame, distance: int, blocks: int = 6, shared: int = 2, id: str = "doc_id"
) -> DataFrame:
    """``fingerprint``, ``component_id``, ``component`` for each fingerprint of ``df``, once.

    ``component_id`` is the smallest id that links lead to, null if all ids are; ``component``
    the smallest fingerprint, which tells components apart even if ids repeat.
    """
    each = saved(df.groupBy("fingerprint").agg(F.min(id).alias("first_id")))
    named = component_names(links(each, distance, blocks, shared))
    linked = saved(
        each.join(named, F.col("fingerprint") == F.col("node")).select("fingerprint", "first_id", "name")
    )
    least = saved(linked.groupBy("name").agg(
        F.min("first_id").alias("component_id"), F.min("fingerprint").alias("component")
    ))
    found = linked.join(least, "name").select("fingerprint", "component_id", "component")
    return saved(
        each.join(found, "fingerprint", "left").select(
            "fingerprint",
            F.coalesce("component_id", "first_id").alias("component_id"),
            F.coalesce("component", "fingerprint").alias("component"),
        )
    )


def hexadecimal(column: str):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
