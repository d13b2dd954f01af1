"""The trie of conversations against one made of Python tuples."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from eventscope.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, family=queries.FAMILY, most=queries.SHARED_TURNS):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = (*turns.get(c - c % family, [])[:h], *own[h:])
    nodes = {}
    for c, steps in built.items():
        for d in range(len(steps) + 1):
            nodes.setdefault(steps[:d], []).append(c)
    children = {n: set() for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]].add(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved[n] = (len(nodes[n]) - 1) * words + sum(saved[k] for k in children[n])
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def collected(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).fillna(-1, ["parent_conv_id"]).collect())


def conversations(seed, convs, longest, words=("a", "b c", "", "d  e\tf")):
    draw = random.Random(seed)
    return [
        (c, t, draw.choice(("user", "bot", None)), draw.choice((*words, None)))
        for c in draw.sample(range(3 * convs), convs) for t in range(draw.randint(1, longest))
    ]


def test_as_of_tuples(spark, write_tables, many_parts):
    rows = conversations(1, 60, 6)
    # Null turns come first; rows without a conversation belong to none; equal rows are two turns.
    rows += [(7, None, "user", "first"), (None, 0, "user", "lost"), (40, 2, "user", "x"), (40, 2, "user", "x")]
    assert collected(queries.op12_prefix_trie(spark, write_tables(conversations=(rows, SCHEMA)))) == expected(rows)


def test_bands_of_bands(spark, many_parts):
    rows = conversations(2, 25, 5, ("a",))
    # A long one, its twin, and one that leaves them half-way.
    rows += [(c, t, "u", str(t if c < 102 or t < 20 else -t)) for c in (100, 101, 102) for t in range(41)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for height in (2, 3, 16):
        steps = prefix_trie.numbered_turns(turns)
        found = prefix_trie.trie(*prefix_trie.with_shared_start(steps, 20, 4), height=height)
        assert collected(found) == expected(rows), height


def test_clashing_names_and_turnless(spark):
    # It takes turns of another one, which is not there, and has but one of its own.
    assert zlib.crc32(b"22") % 4 > 1
    rows = [(22, 0, "u", "only")]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "step", "_place", "key", "words")})
    steps = prefix_trie.numbered_turns(turns)
    found = prefix_trie.trie(*prefix_trie.with_shared_start(steps, 20, 4))
    assert collected(found) == expected(rows) and len(expected(rows)) == 1


def test_no_conversation(spark, write_tables):
    for rows in ([], [(None, 1, "u", "x")]):
        assert queries.op12_prefix_trie(spark, write_tables(conversations=(rows, SCHEMA))).collect() == []


def test_ids_are_hashed_in_numeric_order(spark):
    rows = [(c, 0, "u", "same") for c in (9, 10, 100, 5000, 12345, 9_000_000_000)]
    steps = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    convs = steps.select("conv_id")
    last = prefix_trie.trie(convs, steps).where("depth = 1").first()
    assert last.ends_sha256 == hashlib.sha256(b"9,10,100,5000,12345,9000000000").hexdigest()
