import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from eventscope.llm import order_minhash as omh
from eventscope.llm.queries import op4_order_minhash


def of_long(x, seed=42):
    return xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed=seed)


def slow(text):
    """The signature, by the definition; hashes as Spark makes them."""
    words = re.findall(omh.WORDS, text, re.ASCII)
    if not words:
        return [None] * omh.BINS
    mask = (1 << 34) - 1
    seen, numbered = {}, []
    for place in range(max(1, len(words) - omh.K + 1)):
        h = 42
        for w in words[place : place + omh.K]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        kmer = h & mask
        number = seen[kmer] = seen.get(kmer, -1) + 1
        # The number is an int to Spark, hashed by its four bytes.
        both = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), seed=of_long(kmer)) & mask
        numbered.append((both, place))
    out = []
    for b in range(omh.BINS):
        least = sorted(x for x in numbered if x[0] >> 29 == b)[: omh.PICKED]
        if not least:
            out.append(None)
            continue
        h = 42
        for both, _ in sorted(least, key=lambda x: x[1]):
            h = of_long(both, h)
        out.append(h & 0xFFFFFFFF)
    return out


def texts_of(rng, n):
    words = ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 3, 6, 40]))) for _ in range(80)]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30, 300]))) for _ in range(n)]
    return out + ["", " \n", "a", "a b", "x" * 500, "é ß 日本 " * 20, "same line\n" * 100]


def test_signature_equals_the_definition(spark):
    texts = texts_of(random.Random(1), 30)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.s for r in df.select(omh.signature(F.col("text")).alias("s")).collect()]
    assert got == [slow(t) for t in texts]


def test_order_matters(spark):
    rng = random.Random(2)
    words = [str(rng.randrange(10**6)) for _ in range(600)]
    halves = words[300:] + words[:300]
    df = spark.createDataFrame([(" ".join(words), " ".join(halves), " ".join(words[:570] + words[:30]))], "a string, b string, c string")
    a, b, c = (omh.signature(F.col(x)) for x in "abc")
    row = df.select(omh.likeness(a, b).alias("swapped"), omh.likeness(a, c).alias("edited"), omh.likeness(a, a).alias("same")).first()
    assert row.same == 1 and row.swapped < row.edited and row.edited > 0.7


def test_order_matters_in_short_texts(spark):
    """Quarters in reverse share most sets of three words; their signatures are far less alike."""
    draw = random.Random(4)
    rows = []
    for n in (20, 30, 40, 60):
        for _ in range(20):
            words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(n)]
            quarters = [words[i * n // 4 : (i + 1) * n // 4] for i in range(4)]
            rows.append((n, " ".join(words), " ".join(w for q in reversed(quarters) for w in q)))
    texts = spark.createDataFrame(rows, "n int, a string, b string")
    alike = omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b")))
    found = {r.n: r.alike for r in texts.groupBy("n").agg(F.avg(alike).alias("alike")).collect()}
    for n, likeness in found.items():
        # Six of n - 2 runs of three words cross one of three seams, on either side.
        shared = (n - 2 - 6) / (n - 2 + 6)
        assert likeness < 0.8 * shared, (n, likeness, shared)


def test_long_text_takes_linear_time(spark):
    df = spark.createDataFrame([("the same words " * 200_000,), ("x" * 3_000_000,)], "text string")
    assert df.select(omh.signature(F.col("text")).alias("s")).where(F.size("s") == omh.BINS).count() == 2


def expected(rows):
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    place = {r: k for k, r in enumerate(order)}
    out = []
    for i, t in rows:
        t = t or ""
        following = order[(place[i, t] + 1) % len(order)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        a, b, c = slow(t), slow(edited), slow(following)

        def alike(x, y):
            filled = [(p, q) for p, q in zip(x, y) if p is not None or q is not None]
            return sum(p == q for p, q in filled) / len(filled) if filled else 1.0

        text = "".join("--------" if x is None else f"{x:08x}" for x in a)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text, alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


@pytest.mark.usefixtures("many_parts")
def test_query(spark, write_tables):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) * 7 + 1, t) for t in texts_of(rng, 60)]
    rows += [(None, "no id at all"), (0, None), rows[4], rows[4]]
    folder = write_tables(documents=(rows, "doc_id long, text string, digest string, id int, next_id long"))
    got = op4_order_minhash(spark, folder).collect()
    assert sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got), key=repr
    ) == expected(rows)
    one = write_tables(documents=([(5, "only one text here")], "doc_id long, text string"))
    row = op4_order_minhash(spark, one).first()
    assert row.near_next == 1.0 and row.n_chars == 18
    assert op4_order_minhash(spark, write_tables(documents=([], "doc_id long, text string"))).count() == 0
