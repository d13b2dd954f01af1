"""A corpus made ready for training, stage by stage: toxic documents go, copies go, near
copies go, live credentials are masked, and what is left is packed into sequences.

Rows that are alike in id and text are one document. Other columns of the input stay as
they are, whatever their names.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventscope.llm import exact, packing, queries, secrets, simhash
from eventscope.llm.frames import saved, small_batches
from eventscope.session import use_checkpoint_folder

MASK = "[credential]"


def _chosen(docs: DataFrame, taken: tuple[str, ...], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``choose(docs)`` with the columns of ``docs`` only; those with names that the operator
    takes for its own step aside meanwhile."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c in taken}
    out = choose(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def _keys() -> tuple[Column, Column]:
    """The id, never null, and a digest of the text: together they name a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.xxhash64(text).alias("_digest")


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs``, each as one column ``row``, with what was found for them."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(*_keys(), row).join(found, ["_id", "_digest"], how)


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    return [changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are more likely toxic than not."""
    small_batches(spark)
    taken = ("p_toxic", "severity", "grade", "toxic")
    return _chosen(docs, taken, lambda d: queries.graded(spark, sf_dir, d).where(~F.col("toxic")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    small_batches(spark)
    taken = ("keep_id", "group_size", "kept", "_id", "_data", "_place")
    return _chosen(docs, taken, lambda d: exact.exact_groups(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id; a null id is
    larger than all others."""
    small_batches(spark)
    id_, digest = _keys()
    texts = docs.select(id_, digest, "doc_id", "text")
    rows = saved(simhash.fingerprints(texts, queries.SIMHASH_WORDS).drop("text"))
    groups = simhash.near_groups(rows, queries.SIMHASH_BITS)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_id", "_digest")).alias("first")
    stays = rows.join(groups, "fingerprint").groupBy("component").agg(first).select("first._id", "first._digest")
    kept = _joined(docs, stays, "left_semi").dropDuplicates(["_id", "_digest"])
    return kept.select(*_columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With live credentials masked, and ``n_chars`` counted anew where that was done."""
    id_, digest = _keys()
    texts = docs.select(id_, digest, "doc_id", "source", "text")
    live = (
        secrets.scan(texts, owner="source").where("n_live > 0")
        .select("_id", "_digest", "spans").dropDuplicates(["_id", "_digest"])
    )
    text, clean = F.col("row.text"), F.col("spans").isNull()
    masked = F.when(clean, text).otherwise(secrets.masked(text, F.col("spans"), MASK))
    out = _joined(docs, live, "left").withColumn("masked", masked)
    n_chars = F.when(clean, F.col("row.n_chars")).otherwise(F.length("masked"))
    return out.select(*_columns(
        docs, text=F.col("masked"), n_chars=n_chars.cast(docs.schema["n_chars"].dataType)
    ))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    small_batches(spark)
    return queries.packed(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Learned grades and fingerprints have no SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to the shared checkpoint folder and read again by the next. A
    table goes when the one after it is complete; the last belongs to the caller, whose
    result still reads it."""
    use_checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
