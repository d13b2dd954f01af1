import random
import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from eventscope.llm import simhash
from eventscope.llm.components import component_names
from eventscope.llm.queries import op8_simhash


def slow_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100)
@given(st.text("aB é\t\n\x0b\x85\xa0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == slow_fingerprint(text)


def test_long_text():
    text = " ".join(str(i % 977) for i in range(40_000))
    assert simhash.fingerprint(text, 4) == slow_fingerprint(text)


def components(values, distance):
    """Smallest index reachable, for each value."""
    values = np.array(values, dtype=np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def clustered(rng, n):
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            out.append(base)
            for _ in range(rng.randrange(4)):
                base ^= 1 << rng.randrange(64)
    return out


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    values = clustered(rng, 150) + [0, 0, 2**64 - 1]
    centre = rng.getrandbits(64)
    for _ in range(700):  # one dense cluster
        x = centre
        for b in rng.sample(range(64), rng.randrange(4)):
            x ^= 1 << b
        values.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fingerprint long").repartition(7)
    got = {r.fingerprint: r.component_id for r in simhash.near_groups(df, 4).collect()}
    expected = components(values, 4)
    assert [got[v] for v in signed] == expected.tolist()


def test_spanning_is_no_pair_list():
    rng = np.random.default_rng(0)
    values = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 64, dtype=np.uint64)))
    assert len(simhash.spanning(values, 4)) == len(values) - 1


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(path + star + [(5000, 5000)], "a long, b long")
    named = component_names(df).collect()
    assert len({r.name for r in named if r.node <= 200}) == 1
    assert len({r.name for r in named if r.node >= 1000}) == 1
    assert len(named) == 401 and len({r.name for r in named}) == 2


def test_query(spark, write_tables):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 60, 400]))]
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(text)
            if copy and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(copy).title() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(5000, None), (None, "alone here"), (None, None), rows[3], (6000, "\t \n")]
    folder = write_tables(documents=(rows, "doc_id long, text string, fingerprint int, component_id int"))
    got = Counter(map(tuple, op8_simhash(spark, folder).collect()))
    values = [slow_fingerprint(t) for _, t in rows]
    label = components(values, 4)
    expected = Counter()
    for (doc_id, _), value, l in zip(rows, values, label):
        ids = [r[0] for r, x in zip(rows, label) if x == l and r[0] is not None]
        expected[doc_id, f"{value:016x}", min(ids, default=None)] += 1
    assert got == expected
    assert op8_simhash(spark, write_tables(documents=([], "doc_id long, text string"))).count() == 0
