import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from eventscope.llm import secrets
from eventscope.llm.queries import op6_secrets

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def slow(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def expected(rows):
    """Rows are (id, text, lang, source)."""
    owners, places, all_found = defaultdict(set), defaultdict(set), []
    for doc_id, text, _, source in rows:
        found = slow(text or "")
        all_found.append(found)
        for *_, value in found:
            owners[value].add(source)
            places[value].add((source, doc_id))

    def live(v):
        return (
            len(owners[v]) <= 1 and len(places[v]) <= 3 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
            and len(set(v)) >= 8 and not re.search(secrets.EXAMPLE, v)
        )

    def text_of(spans):
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)

    out = []
    for (doc_id, *_), found in zip(rows, all_found):
        base = [f[:3] for f in found]
        extra = {(b - len(v), 3, b) for _, _, b, v in found if live(v)}
        n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        out.append((doc_id, *n, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(sorted([*base, *extra]))))
    return sorted(out, key=repr)


def rows_of(spark, folder):
    got = op6_secrets(spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return sorted(map(tuple, got.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, base string, start int, hash string"


def test_query(spark, write_tables):
    rng = random.Random(8)

    def key(n, letters="0123456789abcdef"):
        return "".join(rng.choice(letters) for _ in range(n))

    copied, own = key(40), key(40)
    rows = [(i, f"é🙂 token = \"{copied}\" text {key(5)}", "en", f"s{i % 9}") for i in range(400)]
    rows += [(1000 + i, f"password={own} and {own}", "en", "s1") for i in range(2)]
    rows += [
        (2000, "secret=token: abcdefgh1Z", "en", "a"), (2001, "API_KEY:'A1b2C3d4E5' apikey = x", "en", "a"),
        (2002, "AKIA" + key(16, "ABCDEFG123") + " AKIAAKIA12 AKIAAKIA" + key(20, "XYZ9"), "en", "b"),
        (2003, "deadbeef" * 3 + "g" + "ab12" * 5, "en", "b"), (2004, "token=EXAMPLE1234567890abcdef", "en", "b"),
        (2005, None, None, None), (None, "passwd: hunter2hunter2x9Q", None, None), (2006, "", "en", None),
        (2007, "x" * 50_000 + " ".join(f"token={key(12)}" for _ in range(700)) + "é" * 50_000, "en", "c"),
        (2008, "secret = '  password=: token==== api_key=", "en", "c"),
    ]
    rows.append(rows[0])
    folder = write_tables(documents=(rows, SCHEMA))
    assert rows_of(spark, folder) == expected(rows)
    assert op6_secrets(spark, write_tables(documents=([], SCHEMA))).count() == 0


def test_copies_and_further_documents_leave_a_value_live(spark, write_tables):
    rng = random.Random(10)
    copied, many, shared, several = ("".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(4))
    rows = [(i, f"password={copied}", "en", f"s{i}") for i in range(6)]  # one text, six owners
    rows += [(100 + i, f"token={many} of {i}", "en", "s1") for i in range(9)]
    # s2 has both texts, s3 a copy of one.
    rows += [(200, f"secret={shared} a", "en", "s2"), (201, f"secret={shared} a", "en", "s3"), (202, f"secret={shared} b", "en", "s2")]
    # No owner has all.
    rows += [(300 + i, f"secret={several} by {i}", "en", f"s{i}") for i in range(4)]
    got = {r.doc_id: (r.n_live, r.n_example) for r in op6_secrets(spark, write_tables(documents=(rows, SCHEMA))).collect()}
    assert got == {i: (0, 1) if i >= 300 else (1, 0) for i, *_ in rows}


PIECES = ["token", "SECRET", "api_key", "=", ":", " ", '"', "'", "abc", "9f", "AKIA", "AKIA1", "ABCDEFGH", "é", "🙂", ".", "deadbeefdeadbeefdeadbeef"]


def test_many_random_texts(spark, write_tables):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(40))), "en", f"s{rng.randrange(3)}") for i in range(3000)]
    assert rows_of(spark, write_tables(documents=(rows, SCHEMA))) == expected(rows)


def test_masked(spark):
    df = spark.createDataFrame([("a SECRET b KEYKEY c",), ("none",)], "text string")
    spans = F.when(F.col("text") == "none", F.expr("array()").cast("array<struct<start:int,kind:int,past:int>>")).otherwise(
        F.expr("array(named_struct('start',0,'kind',0,'past',8), named_struct('start',2,'kind',3,'past',8), "
               "named_struct('start',11,'kind',3,'past',17), named_struct('start',14,'kind',3,'past',17))")
    )
    got = [r[0] for r in df.select(secrets.masked(F.col("text"), spans, "[x]")).collect()]
    assert got == ["a [x] b [x] c", "none"]
