"""Token sequences of a fixed capacity, filled with whole pieces of documents.

How many pieces there are of each length is all that decides a packing, and there are no
more lengths than the capacity. So the driver solves the configuration linear program
over that histogram: a configuration is a multiset of lengths that fit into one sequence,
and the program asks for the fewest sequences whose configurations cover every length
as often as it occurs. Multiplicative weights solve it: a length's price falls with what
is already covered of it, and a knapsack by dynamic programming finds the dearest
configurations. The fractions are rounded to whole sequences as far as pieces last, the
program is solved once more for the rest, and what is left is packed best-fit in decreasing length, lengths at a time rather
than pieces. Pieces then take the slots of their length by rank.
"""

import bisect
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from eventscope.llm.frames import give_back_memory, saved

# Rounds of multiplicative weights, the step, and how far a round may overfill a length;
# the program is solved again for what rounding leaves, so many times in all.
ROUNDS, STEP, OVERFILL, PASSES = 24, 0.7, 2.0, 2
# Knapsacks of a round: each leaves out the lengths that the ones before filled.
KNAPSACKS = 4
# Pieces of one length are ranked in this many parts, so a length that holds a third of
# all rows is not one task.
CELLS = 32
# Units of words that a worker remembers, and bytes of text coded at once.
REMEMBERED = 1 << 18
CODED_BYTES = 6 << 20

# The units of a tokenizer for which plain words have the short way.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ž]+)([!-&(-/:-@\[-`{-~]*)")

Configuration = tuple[int, ...]


# --- token ids ---------------------------------------------------------------


class WordIds:
    """Ids of texts by a tokenizer that drops white space and joins no tokens across it.

    Blank, tab and line end always divide its tokens, so a stretch of text is cut there
    and each unlike word is coded once. Plain words, Latin letters with ASCII punctuation
    behind them, are one or two units of its merges; units are remembered, and need no
    other step of the tokenizer. All other words take every step.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.units: dict[str, bytes] = {}
        self.plain = _splits_like_this(json.loads(definition))

    def _unit(self, unit: str) -> bytes:
        if len(self.units) >= REMEMBERED:
            self.units.clear()
        tokens = self.tokenizer.model.tokenize("".join([BYTE_LETTERS[b] for b in unit.encode()]))
        ids = self.units[unit] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def _code(self, words: list[str]) -> list[bytes]:
        coded, rest, units, unit = [], [], self.units, self._unit
        plain = PLAIN_WORD.fullmatch if self.plain else lambda word: None
        for word in words:
            ids = units.get(word)
            if ids is None:
                found = plain(word)
                if found is None:
                    rest.append(len(coded))
                else:
                    letters, marks = found.groups()
                    letters = letters.lower()
                    ids = units.get(letters) or unit(letters)
                    if marks:
                        ids += units.get(marks) or unit(marks)
            coded.append(ids)
        for i, code in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            coded[i] = np.array(code.ids, dtype="<u4").tobytes()
        return coded

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Words of each text. ASCII capitals are made small here where that changes nothing:
        without combining marks, that might join either case differently, and without
        what may be a special token."""
        texts = pa.concat_arrays([texts.fill_null("")])
        offsets, data = texts.buffers()[1:]
        raw = np.frombuffer(data or b"", dtype=np.uint8)
        lower = self.plain and not (
            (raw == 0xCC).any() or (raw == 0xCD).any() or pc.any(pc.match_substring(texts, "<|")).as_py()
        )
        raw = (BLANKS_AND_SMALL if lower else BLANKS)[raw]
        clean = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(raw)])
        return pc.split_pattern(clean, " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (unsigned, 32 bits), and where each text's ids end."""
        split = self._cut(texts)
        words = split.flatten().dictionary_encode()
        parts = pa.array(self._code(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy() >> 2)])
        in_text = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        data = parts.buffers()[2] if len(parts) else None
        return np.frombuffer(data or b"", dtype="<u4", count=int(ends[-1])), ends[in_text[1:]]


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: the byte's own where it
    prints, else the next one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[[9, 10]] = 32
BLANKS_AND_SMALL = BLANKS.copy()
BLANKS_AND_SMALL[65:91] += 32


def _splits_like_this(definition: dict) -> bool:
    """Whether the tokenizer lower-cases, and takes runs of letters and of other marks as
    units; apostrophes, digits and what is not ASCII are left to it in any case."""
    steps = definition["normalizer"]["normalizers"] if definition.get("normalizer") else []
    before = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": UNITS}
    )


def _gathered(batches, text: str):
    """Batches of about CODED_BYTES of text: words that occur again are looked up once."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column(text).nbytes
        if size >= CODED_BYTES:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    if size or any(len(b) for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


_BUILT: dict[int, WordIds] = {}


def pieces(
    df: DataFrame, definition: str, capacity: int, end_id: int = 0, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """The token ids of each text and ``end_id`` after them, in pieces of up to ``capacity``.

    ``definition`` is a tokenizer's JSON. Adds ``piece`` (from 0), ``start`` (ids before
    it), ``length``, ``ids_crc32`` and, if asked for, ``ids``; ``text`` goes, columns with
    these names are replaced. A null text counts as empty: one piece of one id.
    """
    shared = df.sparkSession.sparkContext.broadcast(definition)
    new = [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    kept = [f for f in df.schema.fields if f.name not in {text, *(f.name for f in new)}]
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches):
        key = hash(shared.value)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = WordIds(shared.value)
        for batch in _gathered(batches, text):
            coded, ends = _BUILT[key].encode(batch.column(text))
            origin, found, before = [], [], 0
            for i, past in enumerate(ends):
                ids, before = coded[before:past].tobytes() + end, past
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    origin.append(i)
                    found.append((k, at >> 2, len(part) >> 2, zlib.crc32(part)) + (
                        (np.frombuffer(part, "<i4"),) if with_ids else ()))
            back = pa.array(origin, pa.int64())
            columns = [batch.column(f.name).take(back) for f in kept]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            values = list(zip(*found)) or [[] for _ in new]
            columns += [pa.array(list(v), kind) for v, kind in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + new])
        give_back_memory()

    return df.mapInArrow(run, T.StructType(kept + new))


# --- the linear program ------------------------------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``: the most that lengths fitting in it are worth,
    and the index of one of them (-1: leave a token empty)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        m = fitting[room]
        best[room] = best[room - 1]
        if m:
            worth = prices[:m] + best[room - lengths[:m]]
            j = int(worth.argmax())
            if worth[j] > best[room]:
                best[room], pick[room] = worth[j], j
    return best, pick


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Configuration, float]:
    """Configurations (indexes of ``lengths``) and how many sequences of each, in fractions."""
    share: Counter[Configuration] = Counter()
    covered = np.zeros(len(lengths))
    per_round = float((lengths * counts).sum()) / capacity
    # The first prices are far off; what they bought is not kept.
    settle = rounds // 2
    for t in range(rounds):
        if t == settle and t:
            # The volume is the least there can be; more are needed if lengths stay behind.
            per_round /= float(np.clip((covered / counts).min() / t, 0.5, 1.0))
        prices = lengths / capacity * np.exp(-STEP * (covered / counts - t))
        room, left = OVERFILL * counts, per_round
        # Lengths that are full for this round leave the knapsack.
        for _ in range(KNAPSACKS):
            usable = np.flatnonzero(room > 1e-9)
            if left <= 1e-9 or not len(usable):
                break
            sizes = lengths[usable]
            best, pick = knapsack(sizes, prices[usable], capacity)
            worth = prices[usable] + best[capacity - sizes]
            for first in np.argsort(-worth, kind="stable"):
                config, rest = [int(usable[first])], capacity - int(sizes[first])
                while rest:
                    j = int(pick[rest])
                    rest -= int(sizes[j]) if j >= 0 else 1
                    if j >= 0:
                        config.append(int(usable[j]))
                times = Counter(config)
                amount = min(left, min(room[j] / a for j, a in times.items()))
                if amount <= 1e-9:
                    continue
                if t >= settle:
                    share[tuple(sorted(config))] += amount / (rounds - settle)
                for j, a in times.items():
                    room[j] -= a * amount
                    covered[j] += a * amount
                left -= amount
                if left <= 1e-9:
                    break
    return share


def rounded(share: dict[Configuration, float], counts: np.ndarray) -> tuple[list[tuple[Configuration, int]], np.ndarray]:
    """Whole numbers of sequences, rounded up as long as all their pieces are still there, the
    largest shares first; and what is left."""
    left = counts.astype(np.int64).copy()
    whole = []
    for config, amount in sorted(share.items(), key=lambda item: (-item[1], item[0])):
        times = Counter(config)
        k = min(min(int(left[j]) // a for j, a in times.items()), math.ceil(amount))
        if k:
            whole.append((config, k))
            for j, a in times.items():
                left[j] -= a * k
    return whole, left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """The rest in decreasing length, each into the fullest open sequence that has room.

    Sequences filled alike are one entry with a count, so the work hangs on the number
    of lengths, not of pieces.
    """
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []  # sorted

    def put(config: Configuration, count: int, room: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append([config, count])

    for j in range(len(lengths) - 1, -1, -1):
        size, count = int(lengths[j]), int(left[j])
        while count:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                # One new sequence at a time would be filled with this length at once.
                each = min(count, capacity // size)
                k = count // each
                put((j,) * each, k, capacity - each * size)
                count -= each * k
                continue
            room = rooms[i]
            entry = open_by_room[room][-1]
            k = min(count, entry[1])
            entry[1] -= k
            if not entry[1]:
                open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(i)
            put(entry[0] + (j,), k, room - size)
            count -= k
    return [(config, count) for entries in open_by_room.values() for config, count in entries]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations as lengths, longest first, and how many sequences there are of each."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(n)] for n in lengths])
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    whole, left = [], counts
    for _ in range(PASSES):
        there = np.flatnonzero(left)
        if len(there):
            found, rest = rounded(solve(lengths[there], left[there], capacity), left[there])
            whole += [(tuple(int(there[j]) for j in config), k) for config, k in found]
            left = left.copy()
            left[there] = rest
    whole += best_fit(lengths, left, capacity)
    # With few lengths rounding may cost more than the program gains.
    plain = best_fit(lengths, counts, capacity)
    whole = min(whole, plain, key=lambda found: sum(k for _, k in found))
    return [(tuple(int(lengths[j]) for j in reversed(sorted(c))), k) for c, k in whole]


# --- pieces into slots -------------------------------------------------------


def _slots(planned: list[tuple[Configuration, int]], cells: pd.DataFrame) -> pd.DataFrame:
    """Slots by length and cell: places ``first`` to ``past`` of the cell go to the sequences
    from ``sequence`` on, at ``offset``."""
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: count, sequence, offset
    sequence = 0
    for config, count in planned:
        offset = 0
        for size in config:
            slots.setdefault(size, []).append((count, sequence, offset))
            offset += size
        sequence += count
    rows = []
    for size, group in cells.groupby("length"):
        waiting = iter(slots[size])
        count, sequence, offset = next(waiting)
        for cell, there in sorted(zip(group["cell"], group["n"])):
            first = 0
            while first < there:
                if not count:
                    count, sequence, offset = next(waiting)
                k = min(count, there - first)
                rows.append((size, cell, first, first + k, sequence, offset))
                first, count, sequence = first + k, count - k, sequence + k
    return pd.DataFrame(rows, columns=["length", "cell", "first", "past", "sequence", "offset"])


def pack(df: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``capacity``.

    Saves ``df`` once, so that its rows have places that stay. The driver gets a count per
    length and cell (at most ``capacity`` times ``CELLS``) and gives back a table of slots
    that is as small. Rows with equal lengths are interchangeable. Columns of ``df`` with
    the new names are replaced.
    """
    spark = df.sparkSession
    rows = saved(
        df.drop("sequence_id", "offset")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(CELLS)).cast("int"))
    )
    cells = (
        rows.groupBy(F.col(length).cast("long").alias("length"), F.col("_cell").alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .toPandas()
    )
    histogram = {int(k): int(n) for k, n in cells.groupby("length")["n"].sum().items()}
    slots = spark.createDataFrame(
        _slots(plan(histogram, capacity), cells),
        "length long, cell int, first long, past long, sequence long, offset long",
    )
    place = F.row_number().over(Window.partitionBy(length, "_cell").orderBy("_row")) - 1
    return (
        rows.withColumn("_place", place)
        .alias("r")
        .join(
            slots.alias("s"),
            (F.col(f"r.{length}") == F.col("s.length")) & (F.col("r._cell") == F.col("s.cell"))
            & (F.col("r._place") >= F.col("s.first")) & (F.col("r._place") < F.col("s.past")),
        )
        .select(
            *[F.col(f"r.`{c}`") for c in rows.columns if c not in ("_row", "_cell")],
            (F.col("s.sequence") + F.col("r._place") - F.col("s.first")).alias("sequence_id"),
            F.col("s.offset").alias("offset"),
        )
    )
