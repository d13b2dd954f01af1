import hashlib
import random
from collections import defaultdict

from hypothesis import given, strategies as st

from eventscope.llm import exact
from eventscope.llm.queries import op7_exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@given(st.lists(st.text("ab", max_size=40).map(lambda t: t.encode() * 3)))
def test_groups_in_memory(texts):
    expected = defaultdict(set)
    for i, text in enumerate(texts):
        expected[text].add(i)
    found = [] if not texts else [set(g) for g in exact.equal_groups(texts)]
    assert sorted(map(sorted, found)) == sorted(map(sorted, expected.values()))


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        group = groups[lower(text)]
        keep = max((i for i in group if i is not None), default=None)
        out.append((doc_id, keep, len(group), hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, folder, rows):
    got = op7_exact_dedup(spark, folder).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
            assert r.doc_id == r.keep_id
    assert all(len(v) == 1 for v in kept.values())
    assert len(kept) == len({lower(t) for _, t in rows})


def test_query(spark, write_tables):
    rng = random.Random(5)
    stem = "The same long beginning of very many documents. " * 30
    texts = [stem + str(rng.randrange(400)) for _ in range(900)]
    texts += ["copy of a hot document " * 20] * 700 + ["Copy of a HOT document " * 20] * 30
    texts += ["", None, "", "ÄÖ", "äö", "A", "a", "A" * 8, "a" * 8, "a" * 9, "a" * 72, "a" * 73, "x" * 100_000]
    texts += ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(30))) for _ in range(800)]
    rows = [(i if i % 97 else None, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[1000], (2_000_000, "copy of a hot document " * 20)] + [(2_000_000, "copy of a hot document " * 20)]
    rng.shuffle(rows)
    folder = write_tables(documents=(rows, "doc_id long, text string, kept string, group_size int"))
    check(spark, folder, rows)


def test_large_buckets_are_split_and_closed(spark):
    rows = [(i, "copy " * 50) for i in range(300)] + [(1000 + i, "copy " * 10 + str(i % 200)) for i in range(300)]
    df = spark.createDataFrame([(i, t.encode()) for i, t in rows], "_id long, _data binary")
    steps = exact._large_buckets(df, 8)
    assert [s.count() for s in steps] == [1, 1, 1] or len(steps) >= 2
    closed = [r for s in steps for r in s.collect() if r._ended]
    assert [(r._n, r._keep) for r in closed] == [(300, 299)]


def test_empty(spark, write_tables):
    assert op7_exact_dedup(spark, write_tables(documents=([], "doc_id long, text string"))).count() == 0


def test_sql(spark, write_tables):
    import duckdb

    from eventscope.llm.queries import ORACLE

    rows = [(1, "Aé"), (2, "aé"), (3, None), (4, ""), (5, "B")]
    folder = write_tables(documents=(rows, "doc_id long, text string"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = db.execute(ORACLE["op7_exact_dedup"])
    names = [d[0] for d in result.description]
    got = op7_exact_dedup(spark, folder).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
