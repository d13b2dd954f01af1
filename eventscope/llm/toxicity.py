"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = logistic(w . x - t_k) with one weight vector for all grades and rising
thresholds t_1 < t_2 < t_3; the expected severity is the sum of the three. Features are
words and their first four and five letters, so that inflected words share weight.

Labels only say toxic or not. Grade 0 is not toxic; toxic texts get grades 1 to 3 by
thirds of the number of their words that hold a feature.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from eventscope.llm.frames import add_columns, saved

GRADES = 3
# About so many labelled rows of each class are learned from, drawn by a hash of the id.
LEARNED_DOCUMENTS = 10_000
# Features kept: those of at least so many texts that are more frequent in toxic ones than
# chance allows, by the signed root of the likelihood ratio; the best so many of them.
FEATURES, LEAST_TEXTS, LEAST_ROOT = 2048, 5, 4.5
STEPS, RATE, RIDGE = 1000, 0.1, 2e-5

_WORDS = re.compile(r"[^\W\d_]+")
# Words of a shingle, for finding copies among the labelled texts.
SHINGLE = 5


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def features(words: list[str]) -> Counter:
    """Counts of whole words (ending in ``$``) and beginnings (ending in ``*``)."""
    found = Counter(w + "$" for w in words)
    for n in (4, 5):
        found.update(w[:n] + "*" for w in words if len(w) >= n)
    return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * GRADES)

    def __post_init__(self):
        self.whole = {f[:-1]: w for f, w in self.weights.items() if f[-1] == "$"}
        starts = {f[:-1]: w for f, w in self.weights.items() if f[-1] == "*"}
        self.four = {f: w for f, w in starts.items() if len(f) == 4}
        self.five = {f: w for f, w in starts.items() if len(f) == 5}

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= k) for k from 1."""
        words = words_of(text)
        score = 0.0
        for table, parts in (
            (self.whole, words),
            (self.four, [w[:4] for w in words]),
            (self.five, [w[:5] for w in words]),
        ):
            counts = Counter([p for p in parts if p in table])
            # Sorted, so that the sum is the same for the same words in any order.
            score += sum(table[p] * math.log1p(counts[p]) for p in sorted(counts))
        return [1 / (1 + math.exp(min(700.0, t - score))) if t < math.inf else 0.0 for t in self.thresholds]


def _copy_key(words: list[str]) -> int:
    """The least shingle hash: the same for most near copies."""
    shingles = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return min(xxhash.xxh64_intdigest(s) for s in shingles) >> 1


def _feature_counts(batches):
    for batch in batches:
        toxic_in, clean_in = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic_in if toxic else clean_in).update(features(words_of(text)).keys())
        names = list(toxic_in.keys() | clean_in.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([toxic_in[f] for f in names], pa.int64()),
                pa.array([clean_in[f] for f in names], pa.int64()),
            ],
            names=["feature", "toxic_texts", "clean_texts"],
        )


def _rows(number: dict[str, int], marked: set[str]):
    """For each text: toxic or not, numbers and counts of its features, count of marked words."""

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = words_of(text)
                found = [(number[f], n) for f, n in sorted(features(words).items()) if f in number]
                hits = sum(w + "$" in marked or w[:4] + "*" in marked or w[:5] + "*" in marked for w in words)
                out.append((bool(toxic), [f for f, _ in found], [n for _, n in found], hits))
            kinds = [pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["toxic", "at", "n", "marked"]
            )

    return run


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int):
    """Weights and thresholds by Adam on the mean of the cumulative logistic losses.

    Entry i of the sparse matrix is ``values[i]`` at (``rows[i]``, ``columns[i]``).
    """
    n = len(grades)
    above = grades[:, None] >= np.arange(1, GRADES + 1)[None, :]
    # Thresholds as the first one and logarithms of the gaps.
    theta = np.concatenate([np.zeros(width), [2.0], np.zeros(GRADES - 1)])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        thresholds = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, values * w[columns], minlength=n)
        error = (1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -500, 500))) - above) / n
        by_threshold = -error.sum(axis=0)
        gradient = np.concatenate([
            np.bincount(columns, values * error.sum(axis=1)[rows], minlength=width) + RIDGE * w,
            [by_threshold.sum()],
            [by_threshold[k:].sum() * gaps[k - 1] for k in range(1, GRADES)],
        ])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[width + 1 :])
    return theta[:width], theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def learn(
    docs: DataFrame, labels: DataFrame, draw: Column, bound: int = LEARNED_DOCUMENTS,
    id: str = "doc_id", text: str = "text", toxic: str = "toxic",
) -> Model:
    """A model of a bounded sample of the labelled texts; near copies among them count once.

    Rows alike in id and text are one text. ``draw`` hashes the id (long). An id with several labels is toxic if any says so; null
    labels are none. Without toxic or without clean texts nothing is toxic. Runs four jobs;
    the driver gets the chosen features and the sample's counts of them, both bounded.
    """
    given = labels.where(F.col(toxic).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(
        (F.max(F.col(toxic).cast("int")) > 0).alias("toxic")
    )
    sizes = {row["toxic"]: row["count"] for row in given.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()
    share = F.when(F.col("toxic"), min(1.0, bound / sizes[True])).otherwise(min(1.0, bound / sizes[False]))
    # About twice ``bound`` short rows.
    drawn = F.broadcast(given.where(F.pmod(draw, F.lit(1_000_000)) < share * 1_000_000))
    texts = docs.select(F.col(id), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    keyed = add_columns(
        texts.join(drawn, id),
        lambda batch: [[_copy_key(words_of(t)) for t in batch.column("text").to_pylist()]],
        [T.StructField("copy", T.LongType())],
    )
    first = F.min(F.struct(id, "digest")).alias("first")
    chosen = saved(keyed.groupBy("copy").agg(first, F.max("toxic").alias("toxic")).select("first.*", "toxic"))
    # One row for each of the chosen, however often it is in the documents.
    sample = texts.join(F.broadcast(chosen), [id, "digest"]).dropDuplicates([id, "digest"]).select("text", "toxic")

    sizes = {row["toxic"]: row["count"] for row in chosen.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()
    p, n = F.col("toxic_texts"), F.col("clean_texts")
    everyone = sizes[True] + sizes[False]

    def surplus(found, row, column):
        """A cell of the table against what independence gives it."""
        return F.when(found > 0, found * F.log(found * everyone / (row * column))).otherwise(0.0)

    toxic, clean, having = F.lit(sizes[True]), F.lit(sizes[False]), p + n
    ratio = 2 * (
        surplus(p, toxic, having) + surplus(toxic - p, toxic, everyone - having)
        + surplus(n, clean, having) + surplus(clean - n, clean, everyone - having)
    )
    more = p / toxic > n / clean
    best = (
        sample.mapInArrow(_feature_counts, "feature string, toxic_texts long, clean_texts long")
        .groupBy("feature").agg(F.sum("toxic_texts").alias("toxic_texts"), F.sum("clean_texts").alias("clean_texts"))
        .where(p + n >= LEAST_TEXTS)
        .where(more)
        .select("feature", F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("root"))
        .where(F.col("root") >= LEAST_ROOT)
        .orderBy(F.desc("root"), "feature").limit(FEATURES)
        .collect()
    )
    if not best:
        return Model()
    names = [row["feature"] for row in best]
    number = {f: i for i, f in enumerate(names)}
    marked = set(names)
    rows = sample.mapInArrow(_rows(number, marked), "toxic boolean, at array<int>, n array<int>, marked long").toPandas()
    # In an order that is always the same, so that sums are too.
    order = [(t, m, tuple(a), tuple(n)) for t, m, a, n in zip(rows["toxic"], rows["marked"], rows["at"], rows["n"])]
    rows = rows.iloc[sorted(range(len(order)), key=order.__getitem__)]
    cuts = np.quantile(rows.loc[rows["toxic"], "marked"].to_numpy(), [1 / 3, 2 / 3])
    grades = np.where(rows["toxic"], 1 + np.searchsorted(cuts, rows["marked"].to_numpy(), side="left"), 0)
    sizes_of = rows["at"].map(len).to_numpy()
    weights, thresholds = fit_ordinal(
        np.repeat(np.arange(len(rows)), sizes_of),
        np.concatenate([*rows["at"], np.zeros(0)]).astype(np.int64),
        np.log1p(np.concatenate([*rows["n"], np.zeros(0)]).astype(np.float64)),
        grades, len(names),
    )
    return Model(dict(zip(names, map(float, weights))), [float(t) for t in thresholds])


def grade(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``p_toxic``, ``severity`` (0 to 3, expected), ``grade`` (the likeliest) and
    ``toxic`` (p_toxic over one half).

    A null text counts as empty. Columns of ``df`` with these names are replaced. The model
    has a bounded size and is sent to every executor.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        rows = [shared.value.at_least(t) for t in batch.column(text).to_pylist()]
        likeliest = []
        for p in rows:
            steps = [1.0, *p, 0.0]
            likeliest.append(max(range(GRADES + 1), key=lambda k: steps[k] - steps[k + 1]))
        return [[p[0] for p in rows], [sum(p) for p in rows], likeliest, [p[0] > 0.5 for p in rows]]

    return add_columns(df, make, [
        T.StructField("p_toxic", T.DoubleType()), T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType()),
    ])
