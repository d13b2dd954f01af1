import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from eventscope.llm import bpe
from eventscope.llm.queries import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


TEXTS = [
    "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaa", "Hello, world!  \n\n x\t\ty 12345 it's we'll",
    "Ünïcødé ß 日本語 🙂🙂‍👩 <|endoftext|>", "x" * 5000, " " * 3000 + "z", "ab" * 3000,
    base64.b64encode(bytes(range(256)) * 40).decode(), "\x00\x1c\x85   a",
]


def test_encoder_equals_library(ranks, library):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in TEXTS:
        got = list(memoryview(encoder.encode(text)).cast("i"))
        assert got == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abet hin'sor\n 1é", max_size=200)))
def test_encoder_property(text):
    ranks = _cached()
    encoder = bpe.Encoder(ranks[0], public_tokenizers.PATTERN)
    assert list(memoryview(encoder.encode(text)).cast("i")) == ranks[1].encode_ordinary(text)


_CACHE = []


def _cached():
    if not _CACHE:
        ranks = bpe.read_ranks(PATH)
        _CACHE.extend([ranks, tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _CACHE


def test_lower_rank_can_come_up_while_a_bucket_is_worked_off():
    # "bc" (rank 259) makes "abc" (rank 256) possible at once.
    ranks = {bytes([b]): b + 1 for b in range(256)} | {b"abc": 0, b"bc": 300, b"cbc": 299}
    encoder = bpe.Encoder(ranks, r"(?s).+")
    tokens = {r: t for t, r in ranks.items()}

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for piece in (b"abcbc", b"bcbcabc", b"cbcbcabcabc", b"abcabcbcbc"):
        assert [tokens[i] for i in encoder.merge(piece)] == slow(piece)


def test_round_trip_and_query(spark, ranks, library, write_tables):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (50, None)]
    folder = write_tables(documents=(rows, "doc_id long, text string, ids string, decoded int"))
    got = sorted(map(tuple, op1_bpe(spark, folder).collect()), key=repr)

    def expected(doc_id, text):
        ids = library.encode_ordinary(text or "")
        text_of_ids = " ".join(map(str, ids)).encode()
        return (
            doc_id, len(ids), hashlib.sha256(text_of_ids).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )

    assert got == sorted((expected(*r) for r in rows), key=repr)
    empty = write_tables(documents=([], "doc_id long, text string"))
    assert op1_bpe(spark, empty).count() == 0
