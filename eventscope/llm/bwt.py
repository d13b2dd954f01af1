"""Repeated strings across documents, from merged Burrows-Wheeler transforms.

A string of ``LENGTH`` bytes that occurs twice has the same least k-mer both times, in the
same place. So positions are sampled: a k-mer that is least in one of its windows is an
anchor (about one position in fourteen), and the bytes around an anchor, its context,
hold every window that it can stand for. Equal strings meet as contexts with the same
anchor, in the same columns, and nothing else has to meet.

The work goes in four steps, all keyed by pages (documents by hash, a bounded number of
bytes each) or by buckets (anchors by hash):

1. Each page tells each bucket its anchors; the bucket answers which occur in another
   page as well. Anchors of one document only are settled: nothing repeats there.
2. A page sends the contexts of the others to their buckets. Contexts that a page has
   several times, cut by the ends of documents in the same columns or not at all, are sent
   once, for the smallest document; in the later documents all their windows are repeats.
   So a context in a third of all documents costs a row a page, at their edges too. Where
   a passage meets other bytes in each document, contexts differ and each is a row.
3. A bucket gets shards, the contexts of some pages each, and builds the transform of
   every shard: from the last column to the first, contexts sorted by what follows, and
   the bytes before. The merge refines an interleave of the shards: at first it puts one
   shard after the other; each round distributes it stably by the bytes that the transforms
   have next, and so sorts it by one more column, without looking at contexts again. The
   common prefix of neighbours follows from that of the round before, as one more than
   the least between them, if their bytes agree. Neighbours with ``LENGTH`` bytes in
   common form the repeated intervals, and the smallest document of an interval is the
   one that keeps its bytes.
4. A page turns the windows that repeat into removed bytes.
"""

from dataclasses import dataclass

import numpy as np

LENGTH, KMER = 50, 24
WINDOWS = LENGTH - KMER + 1
BEFORE = WINDOWS - 1
WIDTH = BEFORE + LENGTH

# Positions hashed at once, and contexts of a shard.
STRETCH, SHARD = 1 << 18, 1 << 14
NOBODY = np.iinfo(np.int64).max

_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KMER (24) bytes from each position on."""
    one = _BYTES[data]
    two = one[:-1] * _power(1) + one[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    sixteen = eight[:-8] * _power(8) + eight[8:]
    return sixteen[:-8] * _power(8) + eight[16:]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (a minimum or maximum) over each ``width`` values in a row."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = of(out[:-step], out[step:])
        done += step
    return out


@dataclass
class Page:
    """Documents in ascending order of their numbers, their bytes in a row."""

    numbers: np.ndarray
    data: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, numbers: list[int], texts: list[bytes]) -> "Page":
        """``numbers`` are sorted."""
        return cls(
            np.array(numbers, dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8),
            np.cumsum([len(t) for t in texts], dtype=np.int64),
        )

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


@dataclass
class Anchors:
    """``place`` in the page, ``doc`` (index), ``hash`` of the k-mer, ``around`` of the context,
    and the columns ``low`` to ``high`` whose windows lie in the document."""

    place: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    around: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __getitem__(self, at) -> "Anchors":
        return Anchors(*(getattr(self, f)[at] for f in ("place", "doc", "hash", "around", "low", "high")))


def bounds(page: Page, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (index) of each place, and the first and last column of its windows."""
    doc = np.searchsorted(page.ends, place, side="right")
    begin = place - BEFORE
    return doc, np.maximum(0, page.starts[doc] - begin), np.minimum(BEFORE, page.ends[doc] - LENGTH - begin)


def all_windows(page: Page, place: np.ndarray) -> np.ndarray:
    """A bit for each column whose window lies in the document."""
    _, low, high = bounds(page, place)
    return ((np.int64(2) << high) - (np.int64(1) << low)).astype(np.uint32)


def anchors(page: Page) -> Anchors:
    """K-mers that are least in a window of their document; all of them, if several are."""
    n = len(page.data)
    margin = LENGTH + BEFORE
    places, hashes, arounds = [], [], []
    # Windows from these positions on leave their document; they count as zero below.
    out = (page.ends[:, None] - np.arange(1, LENGTH)).ravel()
    out = np.sort(out[out >= 0])
    for at in range(0, n, STRETCH):
        first, past = max(0, at - margin), min(n, at + STRETCH + margin)
        if past - first < LENGTH:
            continue
        kmers = _kmer_hashes(page.data[first:past])
        order = ((kmers * _MIX) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        least = _sliding(order, WINDOWS, np.minimum)
        least[out[slice(*np.searchsorted(out, [first, first + len(least)]))] - first] = 0
        padded = np.concatenate([np.zeros(BEFORE, np.uint32), least, np.zeros(BEFORE, np.uint32)])
        most = _sliding(padded, WINDOWS, np.maximum)[: len(order)]
        found = np.flatnonzero(most == order)
        found = found[(found + first >= at) & (found + first < at + STRETCH)]
        parts = [kmers[np.clip(found + d, 0, len(kmers) - 1)] for d in (-BEFORE, -2, LENGTH - 28, LENGTH - KMER)]
        around = parts[0]
        for part in parts[1:]:
            around = _mixed(around) + part
        places.append(found + first)
        hashes.append(_mixed(kmers[found]))
        arounds.append(_mixed(around))
    if not places:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none, none.astype(np.uint64), none.astype(np.uint64), none, none)
    place = np.concatenate(places)
    doc, low, high = bounds(page, place)
    return Anchors(place, doc, np.concatenate(hashes), np.concatenate(arounds), low, high)


def contexts(page: Page, found: Anchors) -> np.ndarray:
    """A row of WIDTH bytes for each anchor; zero where it leaves the document."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), page.data, np.zeros(LENGTH, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[found.place]
    cut = np.flatnonzero((found.low > 0) | (found.high < BEFORE))
    if len(cut):
        columns = found.place[cut, None] - BEFORE + np.arange(WIDTH)
        doc = found.doc[cut, None]
        rows[cut] *= ((columns >= page.starts[doc]) & (columns < page.ends[doc])).astype(np.uint8)
    return rows


def several_documents(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row: its key occurs in more than one document."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    sorted_keys, docs = keys[order], doc[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    out = np.empty(len(keys), dtype=bool)
    out[order] = np.repeat(several, np.diff(np.r_[starts, len(keys)]))
    return out


def fold(page: Page, found: Anchors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that occur several times in the page: for each row the first that is equal
    (itself, if none is), which rows have its document's number, and which stand for
    themselves. Equal means equal bytes and equal bounds, so the same windows; a hash only
    proposes."""
    n = len(rows)
    first = np.arange(n)
    if n:
        around = found.around.copy()
        cut = np.flatnonzero((found.low > 0) | (found.high < BEFORE))
        # What lies around a cut context is not its document's.
        masked = np.zeros((len(cut), -(-(WIDTH + 2) // 8) * 8), dtype=np.uint8)
        masked[:, :WIDTH], masked[:, WIDTH], masked[:, WIDTH + 1] = rows[cut], found.low[cut], found.high[cut]
        mixed = np.zeros(len(cut), dtype=np.uint64)
        for part in masked.view(np.uint64).T:
            mixed = _mixed(mixed + part)
        around[cut] = mixed
        _, at, group = np.unique(around, return_index=True, return_inverse=True)
        candidate = at[group]
        equal = (rows == rows[candidate]).all(axis=1)
        equal &= (found.low == found.low[candidate]) & (found.high == found.high[candidate])
        first[equal] = candidate[equal]
    number = page.numbers[found.doc]
    return first, number == number[first], first == np.arange(n)


# --- transforms --------------------------------------------------------------


@dataclass
class Shard:
    """``bytes_before[c]``: byte of column c of the contexts sorted by the columns after it;
    ``order[c]``: the contexts sorted from column c on, for the columns of windows."""

    bytes_before: np.ndarray
    order: list[np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> "Shard":
        columns = np.ascontiguousarray(rows.T)
        before = np.empty_like(columns)
        order, kept = np.arange(len(rows), dtype=np.int32), [None] * WINDOWS
        for c in range(WIDTH - 1, -1, -1):
            before[c] = columns[c][order]
            order = order[np.argsort(before[c], kind="stable")]
            if c < WINDOWS:
                kept[c] = order
        return cls(before, kept)


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low[i]:high[i]]) for ranges that are not empty."""
    span = (high - low).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    tables = [values]
    for k in range(int(level.max(initial=0))):
        half = tables[-1]
        step = 1 << k
        longer = half.copy()
        np.minimum(half[:-step], half[step:], out=longer[:-step])
        tables.append(longer)
    flat, n = np.concatenate(tables), len(values)
    return np.minimum(flat[level * n + low], flat[level * n + high - (1 << level)])


def merged(shards: list[Shard]):
    """Goes through the window columns from last to first: the column, the shard of each
    context in the merged order, and how many bytes it shares with the one before (LENGTH
    at most)."""
    sizes = [s.bytes_before.shape[1] for s in shards]
    n = sum(sizes)
    # The interleave: the shard whose next context comes at each place.
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    shared = np.zeros(n, dtype=np.uint8)
    next_bytes = np.empty(n, dtype=np.uint8)
    for c in range(WIDTH - 1, -1, -1):
        next_bytes[np.argsort(interleave, kind="stable")] = np.concatenate([s.bytes_before[c] for s in shards])
        order = np.argsort(next_bytes, kind="stable")
        same = np.flatnonzero(next_bytes[order[1:]] == next_bytes[order[:-1]]) + 1
        new = np.zeros(n, dtype=np.uint8)
        if c == WIDTH - 1:
            new[same] = 1
        elif len(same):
            between = _least_between(shared, order[same - 1] + 1, order[same] + 1)
            new[same] = np.minimum(between + 1, LENGTH)
        interleave, shared = interleave[order], new
        if c < WINDOWS:
            yield c, interleave, shared


def repeats(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each part (contexts, document numbers, low, high) a bit mask for each context: bit
    c says that the window in column c also starts in a smaller document."""
    groups, size = [[]], 0
    for part in parts:
        if size >= SHARD:
            groups.append([])
            size = 0
        groups[-1].append(part)
        size += len(part[0])
    shards = [Shard.of(np.concatenate([p[0] for p in g])) for g in groups]
    numbers, low, high = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    bases = np.cumsum([0] + [s.bytes_before.shape[1] for s in shards])
    masks = np.zeros(len(numbers), dtype=np.uint32)
    rows = np.empty(len(numbers), dtype=np.int64)
    for c, interleave, shared in merged(shards):
        rows[np.argsort(interleave, kind="stable")] = np.concatenate([s.order[c] + b for s, b in zip(shards, bases)])
        inside = (low[rows] <= c) & (c <= high[rows])
        number = np.where(inside, numbers[rows], NOBODY)
        starts = np.flatnonzero(shared < LENGTH)
        smallest = np.repeat(np.minimum.reduceat(number, starts), np.diff(np.r_[starts, len(rows)]))
        again = inside & (smallest < number)
        masks[rows[again]] |= np.uint32(1 << c)
    return np.split(masks, np.cumsum([len(p[0]) for p in parts])[:-1])


def removed_bytes(page: Page, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each byte of the page: it lies in a repeated window."""
    windows = [places[(masks >> np.uint32(c)) & np.uint32(1) == 1] - BEFORE + c for c in range(WINDOWS)]
    windows = np.concatenate(windows)
    n = len(page.data) + 1
    edges = np.bincount(windows, minlength=n) - np.bincount(windows + LENGTH, minlength=n)
    return np.cumsum(edges)[:-1] > 0
