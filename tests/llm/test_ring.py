import random
import zlib
from collections import Counter, defaultdict

import pytest

from eventscope.llm import ring
from eventscope.llm.queries import op2_sharding


def check_slots(rows, shards, n):
    slots = defaultdict(list)
    for shard, slot in rows:
        slots[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == n
    return counts


@pytest.mark.parametrize("n", [1, 5, 16, 17, 1000])
def test_balance(spark, n):
    df = spark.range(n).withColumnRenamed("id", "key").repartition(5)
    got = [(r.shard, r.slot) for r in ring.assign(df, "key", 16).collect()]
    counts = check_slots(got, 16, n)
    assert max(counts) - min(counts) <= 1


def walk(keys, shards, virtual, spare):
    """Keys in ring order, one at a time, each to the first shard clockwise that has room."""
    import math

    import xxhash

    def of_long(x, seed=42):
        return xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed=seed)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    hashes = [(signed(of_long(i // shards, of_long(i % shards))), i % shards) for i in range(shards * virtual)]
    nodes = sorted((h % ring.CELLS, h, shard) for h, shard in hashes)
    ends = [n[0] for n in nodes]
    room = [math.ceil(len(keys) * (1 + spare) / shards)] * shards
    if not spare:
        room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]

    def start(cell):
        return next((a for a, e in enumerate(ends) if e >= cell), None)

    cells = {k: signed(of_long(k)) % ring.CELLS for k in set(keys)}
    order = sorted(keys, key=lambda k: (start(cells[k]) is not None, cells[k]))
    out = defaultdict(Counter)
    for k in order:
        a = start(cells[k]) or 0
        while not room[nodes[a % len(nodes)][2]]:
            a += 1
        shard = nodes[a % len(nodes)][2]
        room[shard] -= 1
        out[cells[k]][shard] += 1
    return out, cells


@pytest.mark.parametrize("spare", [0.0, 0.1, 1.0])
def test_equals_the_walk_key_by_key(spark, spare):
    rng = random.Random(3)
    keys = [rng.randrange(10**9) for _ in range(700)] + [77] * 150
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(4)
    expected, cells = walk(keys, 5, 8, spare)
    got = defaultdict(Counter)
    rows = ring.assign(df, "key", 5, virtual=8, spare=spare).collect()
    for r in rows:
        got[cells[r.key]][r.shard] += 1
    assert got == expected
    check_slots([(r.shard, r.slot) for r in rows], 5, len(keys))


def test_one_more_shard_moves_few_keys(spark):
    df = spark.range(4000).withColumnRenamed("id", "key")
    old = {r.key: r.shard for r in ring.assign(df, "key", 16, spare=0.25).collect()}
    new = {r.key: r.shard for r in ring.assign(df, "key", 17, spare=0.25).collect()}
    assert sum(old[k] != new[k] for k in old) / len(old) < 0.3


def test_query(spark, write_tables):
    rows = [(i, "text é" * (i % 7)) for i in range(300)] + [(None, "x"), (400, None), (3, "again"), (3, "again")]
    rows += [(7, "hot")] * 200
    folder = write_tables(documents=(rows, "doc_id long, text string, shard string, law int, cell long"))
    got = op2_sharding(spark, folder).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    counts = check_slots([(r.shard, r.slot) for r in got], 16, len(rows))
    assert max(counts) - min(counts) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert op2_sharding(spark, write_tables(documents=([], "doc_id long, text string"))).count() == 0
