"""Language identification by Bloom filters of character n-grams, bit-sliced by language.

A slot of the filter holds a bit mask with a bit for every language, so one look-up per
hash and one bitwise and tell all languages that have an n-gram. A text's n-grams are
counted by language; a language's count is corrected for the false positives that its
share of filled slots leads one to expect, and the largest count decides.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from eventscope.llm.frames import add_columns

UNKNOWN = "und"
# About so many documents of each language are learned from, drawn by a hash of the id;
# all of them if there are fewer.
LEARNED_DOCUMENTS = 5_000
# Languages that are learned at most, those with the most documents.
LEARNED_LANGUAGES = 256
# An n-gram belongs to a language if it makes up this share of its n-grams, and this part
# of the share it has in the language where it is most common. The first bounds the table
# that the driver gets: 1 / SHARE n-grams a language at most.
SHARE, PART = 1e-5, 0.1
SLOTS, HASHES = 1 << 20, 2
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Letters handled at once.
STRETCH = 1 << 20

_NO_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(text: str):
    """Arrays of the text's 3-grams, each as one number: lower case, anything but letters
    as one blank, a blank at both ends."""
    clean = f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "
    for at in range(0, len(clean) - 2, STRETCH):
        codes = np.frombuffer(clean[at : at + STRETCH + 2].encode("utf-32-le"), dtype="<u4").astype(np.int64)
        yield (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    bits = SLOTS.bit_length() - 1
    return [((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64) for odd in ODD[:HASHES]]


@dataclass
class Model:
    languages: list[str]
    # One row of slots for every 64 languages.
    masks: np.ndarray
    false_positives: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts, total = np.zeros(len(self.languages)), 0
        for keys in grams(text):
            total += len(keys)
            slots = _slots(keys)
            for row, masks in enumerate(self.masks):
                found = masks[slots[0]]
                for more in slots[1:]:
                    found = found & masks[more]
                for bit in range(min(64, len(self.languages) - 64 * row)):
                    counts[64 * row + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        likely = (counts - total * self.false_positives) / (1 - self.false_positives)
        best = int(likely.argmax())
        return self.languages[best], float(min(1.0, max(0.0, likely[best] / max(total, 1))))


def _counted(column_text: str, column_language: str):
    def run(batches):
        for batch in batches:
            texts, languages = batch.column(column_text).to_pylist(), batch.column(column_language).to_pylist()
            by_language: dict[str, list] = {}
            for text, language in zip(texts, languages):
                if text is not None and has_letter(text):
                    by_language.setdefault(language, []).extend(grams(text))
            for language, arrays in by_language.items():
                keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(keys)), pa.array(keys), pa.array(counts.astype(np.int64))],
                    names=["language", "gram", "n"],
                )

    return run


def learn(
    df: DataFrame, draw: Column, text: str = "text", language: str = "lang", bound: int = LEARNED_DOCUMENTS,
    most: int = LEARNED_LANGUAGES,
) -> Model:
    """A model of the rows with a language. ``draw`` is a hash (long) that picks the sample.

    Learns the ``most`` languages with the most rows, ties by name, from about ``bound`` rows
    of each; rows of others are not learned from, and nothing is predicted to be of them. So
    a column full of odd values costs no more than a clean one. Runs two jobs. Languages are
    ordered by rows, so a tie goes to the more common one.
    """
    known = df.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(language).alias("language"), draw.alias("draw")
    )
    sizes = known.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), "language").limit(most).collect()
    languages = [row.language for row in largest]
    if not languages:
        return Model([], np.zeros((1, SLOTS), dtype=np.uint64), np.zeros(0))
    shares_of = df.sparkSession.createDataFrame(
        [(row.language, min(1.0, bound / row.n)) for row in largest], "language string, part double"
    )
    drawn = known.join(F.broadcast(shares_of), "language")
    sample = drawn.where(F.pmod("draw", F.lit(1_000_000)) < F.col("part") * 1_000_000).select("text", "language")
    counts = (
        sample.mapInArrow(_counted("text", "language"), "language string, gram long, n long")
        .groupBy("language", "gram").agg(F.sum("n").alias("n"))
    )
    totals = F.broadcast(counts.groupBy("language").agg(F.sum("n").alias("total")))
    shares = counts.join(totals, "language").withColumn("share", F.col("n") / F.col("total"))
    # By n-gram: the languages with a share of it, one row a language.
    kept = (
        shares.where(F.col("share") >= SHARE)
        .groupBy("gram")
        .agg(F.max("share").alias("most"), F.collect_list(F.struct("language", "share")).alias("of"))
        .select("gram", "most", F.inline("of"))
        .where(F.col("share") >= F.col("most") * PART)
        .select("gram", "language")
        .toPandas()
    )
    number = {name: i for i, name in enumerate(languages)}
    places = kept["language"].map(number).to_numpy(dtype=np.int64)
    keys = kept["gram"].to_numpy(dtype=np.int64)
    masks = np.zeros(((len(languages) + 63) // 64, SLOTS), dtype=np.uint64)
    for slots in _slots(keys):
        np.bitwise_or.at(masks, (places // 64, slots), np.uint64(1) << (places % 64).astype(np.uint64))
    filled = [np.count_nonzero(masks[i // 64] & np.uint64(1 << (i % 64))) / SLOTS for i in range(len(languages))]
    return Model(languages, masks, np.array(filled) ** HASHES)


def identify(
    df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``df`` with the predicted language and the corrected share of n-grams that it has.

    Null and texts without a letter are ``und`` with score 0, as is everything for a model
    that learned nothing. The model has a fixed size and is sent to every executor.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
        return [[f[0] for f in found], [f[1] for f in found]]

    return add_columns(df, make, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
