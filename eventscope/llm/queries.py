"""The operators of this package on the driver's tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope.llm import (
    alignment, blocks, bpe, exact, language, order_minhash, packing, prefix_trie, repeats, ring, secrets, simhash, toxicity,
)
from eventscope.llm.frames import saved, small_batches, table

# Tokens of a training sequence.
SEQUENCE = 2048
SHARDS = 16
# Words of a shingle and bits that linked fingerprints may differ in.
SIMHASH_WORDS, SIMHASH_BITS = 4, 4
# Conversations that share a first one, and the turns, less one, they take from it at most.
FAMILY, SHARED_TURNS = 20, 4


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = documents(spark, sf_dir, "doc_id", "text")
    coded = bpe.decode(bpe.encode(texts, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return ring.assign(rows, "doc_id", SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def graded(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """``docs`` graded by a model of the labelled ones."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.xxhash64("doc_id"))
    return toxicity.grade(docs, model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir, documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = order_minhash.edited_texts(documents(spark, sf_dir, "doc_id", "text"))
    rows = saved(texts.select(
        "id", "digest", "next_id", "next_digest",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        order_minhash.signature(F.col("text")).alias("of_text"),
        order_minhash.signature(F.col("edited")).alias("of_edited"),
    ))
    # Rows with one id and digest have one text.
    nexts = rows.groupBy(F.col("id").alias("to_id"), F.col("digest").alias("to_digest")).agg(
        F.max("of_text").alias("of_next")
    )
    same = F.col("next_id").eqNullSafe(F.col("to_id")) & (F.col("next_digest") == F.col("to_digest"))
    return rows.join(nexts, same).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        order_minhash.as_text(F.col("of_text")).alias("fingerprint"),
        order_minhash.as_text(F.col("of_edited")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("of_text"), F.col("of_edited")).alias("near_edited"),
        order_minhash.likeness(F.col("of_text"), F.col("of_next")).alias("near_next"),
    )


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` in pieces of sequences."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    return packing.pack(packing.pieces(texts, definition, SEQUENCE), SEQUENCE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir, "doc_id", "text"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of a document is its source."""
    texts = documents(spark, sf_dir, "doc_id", "text", "source")
    found = secrets.scan(texts, owner="source")

    def count(kind: int):
        spans = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(spans).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return found.select(
        "doc_id", *map(count, range(3)),
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir, "doc_id", "text")
    return exact.exact_groups(texts, columns=["doc_id"], digest="text_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir, "doc_id", "text")
    rows = saved(simhash.fingerprints(texts, SIMHASH_WORDS).drop("text"))
    groups = simhash.near_groups(rows, SIMHASH_BITS)
    return rows.join(groups, "fingerprint").select(
        "doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir, "doc_id", "text", "lang")
    # A row without an id is neither learned from nor told apart from the others held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = language.learn(texts.where(~held_out), F.xxhash64("doc_id"))
    rows = texts.select("doc_id", held_out.alias("held_out"), "text")
    return language.identify(rows, model).drop("text")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return blocks.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_shared_start(steps, FAMILY, SHARED_TURNS))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        byte_level = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        pieces = file.read()
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"), byte_level, pieces)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_order_minhash": op4_order_minhash,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_repeats": op10_repeats,
    "op11_main_text": op11_main_text,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}
# Lower case for A-Z only, as DuckDB's lower() also turns other letters.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY norm)
    """,
}


def prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run
