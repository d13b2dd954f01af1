"""Tokens of two tokenizers over the same bytes, lined up.

Texts travel as Arrow batches, gathered into stretches. In a stretch the token ids of each
tokenizer are one flattened list with the document of each token; sums of token lengths
that start anew at each document say where every token ends. A full join of both
tokenizers' (document, end) keys has a row per place where either ends: where both do, a
group ends; and the tokens that cover the bytes before the place are linked. So each link
is a row, and its tokens are the next that end on either side.

Links are counted per pair of ids within a stretch; Spark adds these partial counts up,
and sends each stretch the counts of its own pairs back. Neither the links of a corpus nor
its pairs are ever in one place.
"""

import hashlib
import json
import os
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from eventscope.llm.frames import give_back_memory, saved

# Bytes of text in a stretch; a longer text is one of its own.
STRETCH_BYTES = 2 << 20
# The words that a byte-level tokenizer looks for, as published with its vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Room for the place in a text beside the document's number in its stretch.
END_BITS = 40
# Parts that are coded as one text.
TOGETHER = 512
# A blank after a character that is neither white space nor the sign for it ends a token of
# either kind, so texts are cut there, but for one at the end; the match is the blank.
CUT = re.compile(r" (?<![\s▁] )(?!\Z)")
BYTE_PIECES = [f"<0x{b:02X}>" for b in range(256)]


class Tokenizers:
    """A byte-level tokenizer (A, for a blank and the text) and one of pieces (B, which puts
    the blank there itself), and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        definition, a = json.loads(byte_level), Tokenizer.from_str(byte_level)
        a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        letters = _byte_of_letter()
        entries = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
        # An entry with other letters, a special token, is not made from texts.
        a_bytes = [
            bytes([letters[c] for c in t]) if all(c in letters for c in t) else t.encode()
            for t in (entries.get(i, "") for i in range(max(entries) + 1))
        ]
        vocabulary = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = _cuts_at_blanks(definition, vocabulary)
        ranks = _ranks(definition)
        if self.cuts and ranks:
            import tiktoken

            faster = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode_a = lambda texts: [faster.encode_ordinary(t) for t in texts]
        else:
            self.encode_a = lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
        self.cut = CUT.split if self.cuts else lambda text: ["", text[1:]]
        single = {p: bytes([b]) for b, p in enumerate(BYTE_PIECES)}
        b_bytes = [
            single[p] if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(vocabulary)
        ]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_sizes, self.b_sizes = (pc.binary_length(x).to_numpy() for x in (self.a_bytes, self.b_bytes))
        # How ids are written: what follows them is a comma, or the end of a side or group.
        self.written = pa.array(
            [f"{i}{end}".encode() for n, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for end in ends
             for i in range(n)] + [str(i).encode() for i in range(len(b_bytes))],
            pa.large_binary(),
        )

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids of each text by A and by B, as lists. Each unlike part is coded once."""
        cut = [self.cut(" " + t)[1:] if t else [] for t in texts]
        ends = _starts(np.fromiter(map(len, cut), np.int64, len(cut)))
        parts = pa.array([p for c in cut for p in c], pa.large_string()).dictionary_encode()
        coded = self._coded(parts.dictionary)
        return tuple(_joined(side, parts.indices, ends) for side in coded)

    def _coded(self, parts: pa.Array, together: bool = True) -> tuple[pa.Array, pa.Array]:
        """Ids of each part by A and by B, as lists.

        Many parts are coded as one text, and told apart by the bytes of their tokens. A
        part that ends in white space would join the next one's blank, and is coded alone;
        so is a part with a character that B spells otherwise, and all are if B has more such.
        """
        words = parts.to_pylist()
        alone = np.array([not together or not self.cuts or _alone(w) for w in words], dtype=bool)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        many = int((~alone).sum())
        texts = [" ".join([words[i] for i in order[at : min(at + TOGETHER, many)]]) for at in range(0, many, TOGETHER)]
        texts += [words[i] for i in order[many:]]
        a = self.encode_a([" " + t for t in texts])
        b = self.b.encode(texts, out_type=int, num_threads=1)
        for text, *coded in zip(texts[: -(-many // TOGETHER)], a, b):
            if any(sizes[ids].sum() != len(text.encode()) + 1 for ids, sizes in zip(coded, (self.a_sizes, self.b_sizes))):
                return self._coded(parts, together=False)
        lengths = pc.binary_length(parts).to_numpy()[order] + 1
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return tuple(
            _divided(ids, sizes, lengths, many).take(pa.array(back))
            for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes))
        )


def _alone(part: str) -> bool:
    return not part or part[-1].isspace() or "▁" in part


def _cuts_at_blanks(byte_level: dict, pieces: list[str]) -> bool:
    """Whether no token of either kind has a blank after another character: A looks for
    tokens within words, and no piece of B has the blank inside."""
    step = byte_level.get("pre_tokenizer") or {}
    return (
        byte_level.get("normalizer") is None
        and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        and not any("▁" in p.lstrip("▁") for p in pieces)
    )


def _ranks(byte_level: dict) -> dict[bytes, int] | None:
    """Ids by token, where they are also the order of merges; else None."""
    model, letters = byte_level["model"], _byte_of_letter()
    vocabulary, merges = model.get("vocab"), model.get("merges")
    if model.get("type") != "BPE" or model.get("dropout") or not vocabulary or not merges:
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    made = [vocabulary.get(left + right) for left, right in pairs]
    single = [vocabulary.get(c) for c in letters]
    if None in made or None in single or sorted(single) != list(range(256)) or made != list(range(256, 256 + len(made))):
        return None
    return {bytes([letters[c] for c in t]): i for t, i in vocabulary.items() if i < 256 + len(made)}


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: its own where that
    prints, else bytes in order from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def _divided(texts: list[list[int]], sizes: np.ndarray, lengths: np.ndarray, many: int) -> pa.Array:
    """A list of ids per part: the first ``many`` parts are cut from common texts by their
    ``lengths`` in bytes, the others have a text each."""
    common = -(-many // TOGETHER)
    ids = np.concatenate([np.zeros(0, np.int32), *[array("i", t) for t in texts]])
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    shared = int(counts[:common].sum())
    cuts = np.searchsorted(np.cumsum(sizes[ids[:shared]]), np.cumsum(lengths[:many]), side="right")
    ends = np.concatenate([[0], cuts, shared + np.cumsum(counts[common:])]).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))


def _joined(lists: pa.Array, indices: pa.Array, ends: np.ndarray) -> pa.Array:
    """The lists at ``indices``, those between two ``ends`` as one."""
    taken = lists.take(indices)
    at = _starts(pc.list_value_length(taken).to_numpy())
    return pa.LargeListArray.from_arrays(pa.array(at[ends]), pc.list_flatten(taken))


def _bytes_of(tokens: pa.Array) -> memoryview:
    """The bytes of all ``tokens`` (large_binary) in a row."""
    if not len(tokens) or tokens.buffers()[2] is None:
        return memoryview(b"")
    offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    return memoryview(tokens.buffers()[2]).cast("B")[int(offsets[0]) : int(offsets[-1])]


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class _Side:
    """One tokenizer's tokens of a stretch: ids, the document of each, and where they end."""

    def __init__(self, lists: pa.Array, token_bytes: pa.Array, docs: int):
        self.ids = pc.list_flatten(lists)
        self.doc = pc.list_parent_indices(lists).to_numpy()
        self.counts = np.bincount(self.doc, minlength=docs)
        self.tokens = token_bytes.take(self.ids)
        lengths = pc.binary_length(self.tokens).to_numpy()
        self.doc_bytes = np.bincount(self.doc, weights=lengths, minlength=docs).astype(np.int64)
        # A running sum that starts anew at each document.
        running = np.cumsum(lengths)
        self.ends = running - _starts(self.doc_bytes)[self.doc]

    def table(self, number: str) -> pa.Table:
        """Document-end keys, both in one number, and the tokens' numbers in the stretch."""
        key = (self.doc.astype(np.int64) << END_BITS) + self.ends
        return pa.table({"key": key, number: np.arange(len(key))})


def _spelled(a: _Side, b: _Side, texts: list[str]) -> np.ndarray:
    """Which texts the joined bytes of both sides spell out, a blank before them."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    right = (a.doc_bytes == sizes) & (b.doc_bytes == sizes) & (sizes > 0)
    for side in (a, b):
        spelled, starts = _bytes_of(side.tokens), _starts(side.doc_bytes)
        for i in np.flatnonzero(right):
            right[i] = spelled[starts[i] : starts[i + 1]] == raw[i]
    return right


class Aligned:
    """Groups and links of a stretch of texts."""

    def __init__(self, texts: list[str], tokenizers: Tokenizers):
        self.docs, self.tokenizers = len(texts), tokenizers
        lists = tokenizers.encode(texts)
        a, b = self._sides(lists)
        right = _spelled(a, b, texts)
        if not right.all():
            # Texts that are not spelled out have no tokens.
            none = pa.array(~right)
            empty = pa.scalar([], lists[0].type)
            a, b = self._sides([pc.if_else(none, empty, side) for side in lists])
        self.a, self.b = a, b
        places = a.table("a").join(
            b.table("b"), "key", join_type="full outer", use_threads=False
        ).sort_by("key")
        both = pc.and_(pc.is_valid(places["a"]), pc.is_valid(places["b"]))
        common = places.filter(both)
        self.last_a, self.last_b = (common[c].to_numpy() for c in ("a", "b"))
        self.groups = np.bincount(common["key"].to_numpy() >> END_BITS, minlength=self.docs)
        self.links = np.bincount(places["key"].to_numpy() >> END_BITS, minlength=self.docs)
        # The token over the bytes before a place is the next one to end.
        of_a, of_b = (pc.fill_null_backward(places[c]).combine_chunks() for c in ("a", "b"))
        pair = pc.add(
            pc.multiply(a.ids.take(of_a).cast(pa.int64()), len(tokenizers.b_bytes)), b.ids.take(of_b).cast(pa.int64())
        )
        coded = pair.dictionary_encode()
        self.link_pairs = coded.indices.to_numpy()
        counted = pa.table({"pair": coded.indices}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
        self.pairs = coded.dictionary.take(counted["pair"].combine_chunks())
        self.pair_counts = counted["pair_count"].to_numpy()
        # Pairs come in the order of their counts' rows.
        place = np.empty(len(self.pairs), dtype=np.int32)
        place[counted["pair"].to_numpy()] = np.arange(len(self.pairs), dtype=np.int32)
        self.link_pairs = place[self.link_pairs]

    def _sides(self, lists) -> tuple[_Side, _Side]:
        return tuple(
            _Side(side, token_bytes, self.docs)
            for side, token_bytes in zip(lists, (self.tokenizers.a_bytes, self.tokenizers.b_bytes))
        )

    def digests(self) -> list[str]:
        """The hash of each document's groups as written; '' without tokens."""
        a, b, n_a, n_b = self.a, self.b, len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
        a_group = np.searchsorted(self.last_a, np.arange(len(a.ends)))
        b_group = np.searchsorted(self.last_b, np.arange(len(b.ends)))
        # A group's A ids stand before its B ids, and both after those of the groups before.
        codes = np.empty(len(a.ends) + len(b.ends), dtype=np.int32)
        before = np.concatenate([[-1], self.last_b])
        a_last = np.zeros(len(a.ends), dtype=bool)
        a_last[self.last_a] = True
        codes[np.arange(len(a.ends)) + before[a_group] + 1] = a.ids.to_numpy() + n_a * a_last
        b_last = np.zeros(len(b.ends), dtype=np.int32)
        b_last[self.last_b] = 1
        b_last[_starts(b.counts)[1:][b.counts > 0] - 1] = 2
        codes[np.arange(len(b.ends)) + self.last_a[b_group] + 1] = 2 * n_a + b.ids.to_numpy() + n_b * b_last
        written = self.tokenizers.written.take(pa.array(codes))
        data = _bytes_of(written)
        ends = _starts(pc.binary_length(written).to_numpy())[_starts(a.counts + b.counts)]
        return [
            hashlib.sha256(data[ends[i] : ends[i + 1]]).hexdigest() if a.counts[i] else "" for i in range(self.docs)
        ]


# What a worker built from the definitions, by the name the driver gave them.
_BUILT: dict[str, Tokenizers] = {}


def _stretches(batches, text: str):
    """Tables of about STRETCH_BYTES of text, and at least a row."""
    waiting, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > STRETCH_BYTES:
                waiting.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size, start = [], 0, i
            size += int(n)
        waiting.append(batch.slice(start))
    if any(w.num_rows for w in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks()


def align(df: DataFrame, byte_level: str, pieces: bytes, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """A row per row of ``df``: its ``columns`` (all but the text, if not named) and n_a, n_b
    (tokens), n_groups, n_links, n_best (links whose count is the highest that their B id has
    anywhere), count_sum (counts of the pairs of all links) and groups_sha256.

    ``byte_level`` is the definition of A, ``pieces`` the model of B; both have a fixed size
    and go to every executor. A text that is null, empty or not spelled out by its tokens
    has none: zeros and ''. Rows that are alike are documents of their own. A column that
    is called like a new one is replaced; all others are kept, whatever their names.
    """
    fresh = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    columns = [c for c in (df.columns if columns is None else columns) if c not in fresh and (columns or c != text)]
    session = df.sparkSession
    shared, name = session.sparkContext.broadcast((byte_level, pieces)), uuid.uuid4().hex

    def tokenizers() -> Tokenizers:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Tokenizers(*shared.value)
        return _BUILT[name]

    carried = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("_"))
    rows = df.select(carried.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()

    def first(batches):
        numbered = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_stretches(batches, "text")):
            found = Aligned([t or "" for t in table["text"].to_pylist()], tokenizers())
            starts = _starts(found.links)
            links = [
                pa.compress(found.link_pairs[s:e].tobytes(), "zstd", asbytes=True) for s, e in zip(starts, starts[1:])
            ]
            n_b = len(found.tokenizers.b_bytes)
            ids = found.pairs.to_numpy()
            pairs = pa.StructArray.from_arrays(
                [pa.array(ids // n_b), pa.array(ids % n_b), pa.array(found.pair_counts)], names=["a", "b", "n"]
            )
            # The first row of a stretch carries its pairs.
            sizes = [0] + [len(pairs)] * found.docs
            out = pa.table({
                "row": table["row"], "stretch": pa.array(np.full(found.docs, numbered + number)),
                "n_a": found.a.counts, "n_b": found.b.counts, "n_groups": found.groups, "n_links": found.links,
                "groups_sha256": found.digests(), "links": pa.array(links, pa.binary()),
                "pairs": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs),
            })
            yield from out.combine_chunks().to_batches()
        give_back_memory()

    coded = saved(rows.mapInArrow(first, (
        f"row {row_type}, stretch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "links binary, pairs array<struct<a: long, b: long, n: long>>"
    )))
    # Pairs of a stretch are told apart by their place in its list.
    in_stretch = coded.select("stretch", F.posexplode("pairs").alias("place", "pair")).select(
        "stretch", "place", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.col("pair.n").alias("n")
    )
    counts = in_stretch.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # A B id has at most as many rows here as A has ids.
    best = F.col("count") == F.max("count").over(Window.partitionBy("b"))
    facts = in_stretch.drop("n").join(counts.withColumn("best", best), ["a", "b"]).select(
        F.col("stretch").alias("of_stretch"), "place", "count", "best"
    )

    def second(docs: pa.Table, known: pa.Table) -> pa.Table:
        count, best_ = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, bool)
        count[known["place"].to_numpy()] = known["count"].to_numpy()
        best_[known["place"].to_numpy()] = known["best"].to_numpy()
        n_best, sums = [], []
        for data, n in zip(docs["links"].to_pylist(), docs["n_links"].to_pylist()):
            links = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True) if n else b"", np.int32)
            n_best.append(int(best_[links].sum()))
            sums.append(int(count[links].sum()))
        kept = docs.drop_columns(["links", "stretch"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    aligned = coded.drop("pairs").groupBy("stretch").cogroup(facts.groupBy("of_stretch")).applyInArrow(second, (
        f"row {row_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, "
        "count_sum long"
    ))
    return aligned.select(*[F.col("row")[c].alias(c) for c in columns], *fresh)
