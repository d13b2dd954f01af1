"""Alignment against a walk over both token sequences."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import Row
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from eventscope.llm import alignment, queries

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    None, "", " ", "a", " a", "a ", "  a  b  ", "\n a\n \tb ", "▁ a ▁b▁ c", "<|endoftext|> <s> </s> <0x41> <unk>",
    "é中 x  y\xa0 z\x1c w", "don't 's  'll", "١٢ 12 ½", "﻿ a", "a\x00b c",
    "the quick brown fox, the lazy dog.", "the quick brown fox, the lazy dog.", "x" * 3000, "word " * 4000,
    "\U0001f600 unbelievably, über naïve слово",
]


@pytest.fixture(scope="module")
def definitions():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        byte_level = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return byte_level, file.read()


def walked(texts, byte_level, pieces):
    a, b = Tokenizer.from_str(byte_level), SentencePieceProcessor(model_proto=pieces)
    a.encode_special_tokens = True
    entries, letters = {i: t for t, i in a.get_vocab().items()}, alignment._byte_of_letter()

    def of_a(i):
        return bytes(letters[c] for c in entries[i])

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        raw = (" " + (text or "")).encode()
        if any(b"".join(map(f, x)) != raw for f, x in zip((of_a, of_b), ids)):
            found.append(((0, 0), [], []))
            continue
        ends = []
        for f, side in zip((of_a, of_b), ids):
            at, where = 0, {}
            for n, i in enumerate(side):
                at += len(f(i))
                where[at] = n
            ends.append(where)
        i = j = 0
        links, groups, start = [], [], (0, 0)
        for end in sorted({*ends[0], *ends[1]}):
            links.append((ids[0][i], ids[1][j]))
            i, j = i + (end in ends[0]), j + (end in ends[1])
            if end in ends[0] and end in ends[1]:
                sides = [ids[0][start[0] : i], ids[1][start[1] : j]]
                groups.append("|".join(",".join(map(str, s)) for s in sides))
                start = (i, j)
        found.append(((len(ids[0]), len(ids[1])), links, groups))
    counts = Counter(link for _, links, _ in found for link in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (*sizes, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for sizes, links, groups in found
    ]


def test_aligned_as_walked(spark, definitions, monkeypatch):
    expected = walked(TEXTS, *definitions)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(rows, *definitions).collect()}
    assert [found[i] for i in range(len(TEXTS))] == expected


def test_short_stretches_and_whole_texts(definitions, monkeypatch):
    tokenizers = alignment.Tokenizers(*definitions)
    texts = [t or "" for t in TEXTS]
    whole = alignment.Aligned(texts, tokenizers)
    assert [x for t in texts for x in alignment.Aligned([t], tokenizers).digests()] == whole.digests()
    tokenizers.cuts = False
    tokenizers.cut = lambda text: ["", text[1:]]
    assert alignment.Aligned(texts, tokenizers).digests() == whole.digests()


def test_columns_of_the_caller(spark, definitions):
    schema = "doc_id long, row string, stretch long, pairs int, a long, n_a string, place int, text string, doc string"
    rows = [(None, "r", 5, 6, 7, "x", 8, "a b", "d"), (None, "r", 5, 6, 7, "x", 8, "a b", "d"), (3, None, None, None, None, None, None, None, None)]
    out = alignment.align(spark.createDataFrame(rows, schema), *definitions)
    kept = [c for c in schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") if c not in ("text", "n_a")]
    assert out.columns == kept + list(COLUMNS)
    found = sorted(out.collect(), key=lambda r: r.n_a)
    assert found[0].n_a == 0 and found[0].doc_id == 3 and found[0].groups_sha256 == ""
    assert found[1] == found[2] and found[1][: len(kept)] == (None, "r", 5, 6, 7, 8, "d")
    # Each of the pairs occurs twice.
    assert found[1].n_links == 2 and found[1].n_best == 2 and found[1].count_sum == 4


def test_empty_table_and_query(spark, write_tables, definitions):
    none = write_tables(documents=([], "doc_id long, text string"))
    assert queries.op13_alignment(spark, none).collect() == []
    some = write_tables(documents=([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    found = queries.op13_alignment(spark, some).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in (Row(r.doc_id, *(r[c] for c in COLUMNS)) for r in found)] == walked(TEXTS, *definitions)
