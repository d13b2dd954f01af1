"""Byte-level BPE: texts to token ids and back.

A pre-token's byte positions form a linked list. Every adjacent pair that has a merge
rank waits in the bucket of that rank; a three-level bitmap over the ranks tells by
find-first-set which bucket is next. A merge only changes the ranks of the two pairs
beside it, so their old entries stay where they are and are skipped as stale when their
bucket comes up. A pre-token of n bytes costs O(n) bucket operations besides sorting the
positions of a bucket, so one of a million bytes is no different from a thousand short ones.
"""

import base64
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from eventscope.llm.frames import add_columns

# Short pre-tokens come again and again; a worker remembers the ids of about this many.
REMEMBERED = 1 << 20
REMEMBERED_BYTES = 48
# Bytes of pre-tokens that share a queue; a longer one has it for itself.
QUEUED_BYTES = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks by token, from a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankQueue:
    """Buckets of positions by rank; the lowest rank that has a bucket comes first."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def fill(self, rank: int, positions: list[int]) -> None:
        """A bucket that is not there yet, with positions in order."""
        self.push(rank, positions[0])
        self.buckets[rank] = positions

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right."""
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        j = (i << 6) + (word & -word).bit_length() - 1
        word = self.low[j]
        bit = word & -word
        rank = (j << 6) + bit.bit_length() - 1
        self.low[j] = word ^ bit
        if word == bit:
            self.mid[i] ^= 1 << (j & 63)
            if not self.mid[i]:
                self.top ^= 1 << i
        positions = self.buckets.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


class Encoder:
    """Ids of pre-tokens. Ranks must hold every single byte.

    Pre-tokens that were not met before wait in one queue: they lie behind one another in
    one list of positions, with no pair across their borders. Each has its own order of
    merges, so what the others do in between changes nothing.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.known: dict[str, bytes] = {}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.double = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank

    def merge(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.merge_all([piece])[0], dtype="<i4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        get = self.ranks.get
        out = [b"" if whole is None else whole.to_bytes(4, "little") for whole in map(get, pieces)]
        rest = [i for i, ids in enumerate(out) if not ids and pieces[i]]
        start = 0
        while start < len(rest):
            # As many as fill the queue, and at least one.
            end, size = start + 1, len(pieces[rest[start]])
            while end < len(rest) and size + len(pieces[rest[end]]) <= QUEUED_BYTES:
                size += len(pieces[rest[end]])
                end += 1
            some = [pieces[i] for i in rest[start:end]]
            for i, ids in zip(rest[start:end], self._merged(some)):
                out[i] = ids
            start = end
        return out

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        data, get, queue = b"".join(pieces), self.ranks.get, self.queue
        push, n = queue.push, len(data)
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(p) for p in pieces])
        border = np.zeros(n + 1, dtype=bool)
        border[0] = True
        border[ends] = True
        # pair[p]: rank of the token at p joined with the one after it; -1 if none.
        first = np.full(n, -1, dtype=np.int64)
        first[:-1] = np.where(border[1:n], -1, self.double[raw[:-1] << 8 | raw[1:]])
        waiting = np.flatnonzero(first >= 0)
        waiting = waiting[np.argsort(first[waiting], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[waiting], prepend=-1))
        for positions in np.split(waiting, cuts[1:]) if len(waiting) else ():
            queue.fill(int(first[positions[0]]), positions.tolist())
        pair, token = first.tolist(), self.single[raw].tolist()
        after = list(range(1, n + 1))
        before = np.where(border[:n], -1, np.arange(-1, n - 1)).tolist()
        is_border = border.tolist()
        while queue.top:
            rank, positions = queue.pop()
            held = 0
            for p in positions:
                if pair[p] != rank:
                    continue
                if p < held:
                    push(rank, p)
                    continue
                gone = after[p]
                pair[gone] = token[gone] = -1
                token[p] = rank
                end = after[p] = after[gone]
                lowest = rank
                if is_border[end]:
                    pair[p] = -1
                else:
                    before[end] = p
                    new = pair[p] = get(data[p : after[end]], -1)
                    if new >= 0:
                        push(new, p)
                        lowest = new
                left = before[p]
                if left >= 0:
                    new = pair[left] = get(data[left:end], -1)
                    if new >= 0:
                        push(new, left)
                        lowest = min(lowest, new)
                if lowest < rank:
                    # The rest of this pre-token waits for the lower rank.
                    held = int(ends[np.searchsorted(ends, p, side="right")])
        tokens = np.array(token, dtype="<i4")
        kept = tokens >= 0
        counts = np.concatenate([[0], np.cumsum(kept)[ends - 1]]) * 4
        ids = tokens[kept].tobytes()
        return [ids[a:b] for a, b in zip(counts.tolist(), counts[1:].tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        known, split = self.known, [self.split(t) for t in texts]
        if len(known) >= REMEMBERED:
            known.clear()
        new = list({p for pieces in split for p in pieces if p not in known})
        raw = [p.encode() for p in new]
        made = dict(zip(new, self.merge_all(raw)))
        known |= {p: made[p] for p, b in zip(new, raw) if len(b) <= REMEMBERED_BYTES}
        if all(len(b) <= REMEMBERED_BYTES for b in raw):
            return [b"".join([known[p] for p in pieces]) for pieces in split]
        return [b"".join([known.get(p) or made[p] for p in pieces]) for pieces in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


# What a worker built from a broadcast table, by the name the driver gave it.
_BUILT: dict[str, object] = {}


def _built(name: str, build):
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build()
    return _BUILT[name]


def _token_table(ranks: dict[bytes, int]) -> pa.Array:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``df`` with the token ids of ``text`` (array of int); a null text has none.

    The rank table has a fixed size and is sent to every executor.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex

    def make(batch):
        encoder = _built(name, lambda: Encoder(shared.value, pattern))
        rows = encoder.encode_all([x or "" for x in batch.column(text).to_pylist()])
        offsets = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) >> 2 for r in rows], out=offsets[1:])
        values = np.frombuffer(b"".join(rows), dtype="<i4")
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]

    return add_columns(df, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(
    df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; null ids give no bytes.

    An id that the table does not have is an error.
    """
    shared, made = df.sparkSession.sparkContext.broadcast(ranks), {}

    def make(batch):
        if "tokens" not in made:
            made["tokens"] = _token_table(shared.value)
        column = batch.column(ids).fill_null([])
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        ends = np.zeros(len(column) + 1, dtype=np.int64)
        np.cumsum(sizes, out=ends[1:])
        parts = made["tokens"].take(column.flatten())
        places = np.frombuffer(parts.buffers()[1], dtype=np.int32)[
            parts.offset : parts.offset + len(parts) + 1
        ] if len(parts) else np.zeros(1, dtype=np.int32)
        data = parts.buffers()[2]
        offsets = pa.py_buffer(places[ends].astype(np.int32).tobytes())
        return [pa.Array.from_buffers(pa.binary(), len(column), [None, offsets, data or pa.py_buffer(b"")])]

    return add_columns(df, make, [T.StructField(decoded, T.BinaryType())])

