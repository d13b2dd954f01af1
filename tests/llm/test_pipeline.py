import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline as pipeline
from eventscope.llm import queries, secrets
from test_secrets import slow as slow_secrets
from test_simhash import components, slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, kept int, fingerprint string"
LABELS = "doc_id long, quality int, toxic int"


def make(rng):
    plain = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(400)]

    def text(n):
        return [rng.choice(plain) for _ in range(n)]

    rows, labels = [], []
    for i in range(400):
        words = text(rng.choice([30, 80, 200]))
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["horridly", "vileness"])
        if i % 9 == 1:
            words.insert(3, f"token={rng.getrandbits(80):020x}")
        if i % 9 == 2:
            words.insert(3, "token=0123fedc4567ba98aa11")
        rows.append((i, " ".join(words)))
        if i % 3 != 2:
            labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[5 * i + 1][1].upper()) for i in range(30)]
    for i in range(30):
        words = rows[7 * i + 2][1].split()
        words[-1] = "changed"
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000, None), (3001, ""), (None, "no id"), rows[8], (3002, "word " * 4000)]
    rows = [(i, t, "en", f"s{k % 5}", len(t or ""), f"t{k}", k, "x") for k, (i, t) in enumerate(rows)]
    return rows, labels


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark, write_tables):
    rows, labels = make(random.Random(6))
    folder = write_tables(documents=(rows, SCHEMA), labels=(labels, LABELS))
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def run(stage, before):
        df = spark.createDataFrame(before, docs.schema).repartition(3)
        return [tuple(r) for r in dict(pipeline.STAGES)[stage](spark, df, folder).collect()]

    # Toxic ones go, and no other.
    clean = run("toxicity", rows)
    assert Counter(clean) == Counter(
        r for r in rows if "horridly" not in lower(r[1]) and "vileness" not in lower(r[1])
    )

    # Of equal texts one row with the largest id stays.
    single = run("exact_dedup", clean)
    largest = defaultdict(list)
    for r in clean:
        largest[lower(r[1])].append(r)
    assert len(single) == len(largest) and len(set(single)) == len(single)
    for r in single:
        assert r in largest[lower(r[1])] and r[0] == max((x[0] for x in largest[lower(r[1])] if x[0] is not None), default=None)

    # Of linked ones the smallest id stays.
    apart = run("near_dedup", single)
    label = components([slow_fingerprint(r[1]) for r in single], 4)
    groups = defaultdict(list)
    for r, g in zip(single, label):
        groups[g].append(r)
    expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert Counter(apart) == Counter(expected) and len(apart) < len(single)

    # Live values are masked, copied ones and all other text stay.
    masked = {r[0]: r for r in run("secrets", apart)}
    assert len(masked) == len(apart)
    owners = defaultdict(set)
    for r in apart:
        for *_, value in slow_secrets(r[1] or ""):
            owners[value].add((r[3], r[0]))
    changed = 0
    for r in apart:
        text = r[1]
        for _, _, _, value in slow_secrets(text or ""):
            if len({o for o, _ in owners[value]}) == 1 and len(set(value)) >= secrets.DIFFERENT and any(c.isalpha() for c in value) and any(c.isdigit() for c in value):
                text, changed = text.replace(value, pipeline.MASK), changed + 1
        assert masked[r[0]][1] == text and masked[r[0]][4] == (len(text) if text != r[1] else r[4])
    assert changed > 5

    # All tokens of all documents are packed.
    pieces = [r.asDict() for r in dict(pipeline.STAGES)["packing"](spark, spark.createDataFrame(list(masked.values()), docs.schema), folder).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for i, r in masked.items()}
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == Counter(tokens)

    # run() is the stages one after the other.
    whole = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == Counter(
        (p["doc_id"], p["piece"], p["length"], p["ids_crc32"]) for p in pieces
    )


def test_empty(spark, write_tables):
    folder = write_tables(documents=([], SCHEMA), labels=([], LABELS))
    assert pipeline.run(spark, folder).count() == 0


def test_columns_with_any_name(spark, tmp_path):
    """Each stage hands on what the caller had, whatever it is called."""
    names = ["_id", "_digest", "_spans", "spans", "row", "masked", "component", "kept", "keep_id", "_data", "_place", "fingerprint", "n_live"]
    key = "token = q7Rz1Kp9Vw4Lm2XtB8"
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)] + [f"here is {key} of ours"]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    stages = dict(pipeline.STAGES)
    for stage in ("exact_dedup", "near_dedup", "secrets"):
        out = stages[stage](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = {r.doc_id: tuple(r) for r in out.collect()}
        assert set(found) == set(range(7))
        assert all(found[i][5:] == rows[i][5:] for i in found), stage
    assert key.split()[-1] not in found[6][1]


def test_tables_between_stages_go(spark, write_tables, tmp_path):
    from pathlib import Path

    folder = write_tables(documents=([(1, "a b c", "en", "s", 5)], SCHEMA), labels=([], LABELS))
    before = set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("pipeline-*"))
    assert pipeline.run(spark, folder).count() == 1
    made, = set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("pipeline-*")) - before
    assert [p.name for p in made.iterdir()] == [pipeline.STAGES[-2][0]]


def test_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in driver.queries() and [n for n, _ in pipeline.STAGES][0] == "toxicity"
    assert set(queries.ORACLE) <= set(queries.QUERIES)
