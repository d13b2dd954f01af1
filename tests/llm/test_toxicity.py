import random

import numpy as np

from eventscope.llm import toxicity
from eventscope.llm.queries import op3_toxicity

SF_DIR = "/root/testdata/sf0.01"
SCHEMAS = "doc_id long, text string, toxic string, grade string", "doc_id long, quality int, toxic int"


def test_features():
    found = toxicity.features(toxicity.words_of("Bad bads badly BAD é1x_y"))
    assert found["bad$"] == 2 and found["badl*"] == 1 and found["badly*"] == 1 and found["bads*"] == 1
    assert found["x$"] == 1 and toxicity.words_of(None) == []


def test_ordinal_fit_orders_thresholds_and_finds_the_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    grades = np.searchsorted([0.0, 0.8, 1.5], x + 0.1 * rng.normal(size=2000))
    weights, thresholds = toxicity.fit_ordinal(np.arange(2000), np.zeros(2000, int), x, grades, 1)
    assert weights[0] > 1 and thresholds[0] < thresholds[1] < thresholds[2]


def test_severity_rises_with_the_share_of_marked_words(spark, write_tables):
    rng = random.Random(7)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["awfulish", "horridly", "vileness"]
    rows, labels = [], []
    for i in range(400):
        many = [0, 1, 4, 12][i % 4]
        words = [rng.choice(plain) for _ in range(60)] + [rng.choice(bad) for _ in range(many)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(many > 0)))
    rows += [(None, None), (900, ""), (901, "horridly " * 30), (902, "wordaa " * 3000), rows[1]]
    labels += [(2, 1, None), (None, 1, 1), (3, 0, 0)]
    folder = write_tables(documents=(rows, SCHEMAS[0]), labels=(labels, SCHEMAS[1]))
    got = op3_toxicity(spark, folder).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in range(400):
        assert by_id[i].toxic == bool(i % 4)
    mean = [np.mean([by_id[i].severity for i in range(k, 400, 4)]) for k in range(4)]
    assert mean[0] < 0.3 < mean[1] < mean[2] < mean[3]
    assert not by_id[None].toxic and not by_id[900].toxic and by_id[901].toxic and not by_id[902].toxic
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)


def test_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    model = toxicity.learn(docs, labels.where(~held), F.xxhash64("doc_id"))
    rows = toxicity.grade(docs.join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id"), model).collect()
    assert sum(r.toxic == bool(r.label) for r in rows) / len(rows) >= 0.9  # 300 labels to learn from


def test_held_out_recall_and_false_rejections(spark):
    """By a hash of the id, on more labels; each kind of error by itself."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(docs, labels.where(~held), F.xxhash64("doc_id"))
    rows = toxicity.grade(docs.join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id"), model)
    found = {(r.label, r.toxic): r["count"] for r in rows.groupBy("label", "toxic").count().collect()}
    caught, missed = found.get((1, True), 0), found.get((1, False), 0)
    print(found)
    assert caught / (caught + missed) >= 0.85 and caught + missed > 50
    assert found.get((0, True), 0) / (found.get((0, True), 0) + found[(0, False)]) <= 0.01


def test_repeated_rows_and_ids_count_once(spark, write_tables):
    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *["horridly"] * (i % 2)])) for i in range(200)]
    # Some ids have a second text.
    rows += [(i, " ".join([*rng.choices(words, k=40), *["horridly"] * (i % 2)])) for i in range(20)]
    labels = [(i, 1, i % 2) for i in range(200)]
    once = op3_toxicity(spark, write_tables(documents=(rows, SCHEMAS[0]), labels=(labels, SCHEMAS[1]))).collect()
    twice = op3_toxicity(spark, write_tables(documents=(rows * 2, SCHEMAS[0]), labels=(labels, SCHEMAS[1]))).collect()
    assert all(r.toxic == bool(r.doc_id % 2) for r in twice)
    assert sorted(map(repr, twice)) == sorted([*map(repr, once)] * 2)


def test_nothing_to_learn(spark, write_tables):
    one_class = write_tables(documents=([(1, "a b c")], SCHEMAS[0]), labels=([(1, 1, 0)], SCHEMAS[1]))
    row = op3_toxicity(spark, one_class).first()
    assert (row.severity, row.grade, row.toxic) == (0.0, 0, False)
    none = write_tables(documents=([], SCHEMAS[0]), labels=([], SCHEMAS[1]))
    assert op3_toxicity(spark, none).count() == 0
