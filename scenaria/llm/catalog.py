"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fingerprints,
    jaccard,
    langid,
    licences,
    mixing,
    packing,
    periodic,
    phrases,
    repeats,
    scoring,
    sharding,
    vectors,
    warc,
)
from .common import Scratch, fold, read
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards through 4096 virtual slots, by key; maps for 16 and 17 shards are stored."""
    recs = sharding.records(read(spark, sf_dir, "documents"))
    scratch = Scratch(spark, "op1")
    sizes = scratch.save(sharding.slot_sizes(recs), "slot-sizes")
    store = sharding.MapStore(spark, f"{scratch.root}/map")
    now = store.write(sharding.first_map(spark, 16), 1)
    grown = store.write(sharding.grow_map(now, 16), 2)
    both = now.join(F.broadcast(grown.withColumnRenamed("shard", "grown_shard")), "virtual_slot")
    return sharding.assign(recs, sizes, both).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources, least repeated once, most repeated twice at most: one row per use of a document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, Scratch(spark, "op2")).select(
        "doc_id",
        "source",
        F.col("_tokens").alias("n_tokens"),
        "epoch",
        F.col("_block").alias("block"),
        "alpha",
        F.round("weight", 9).alias("weight"),
        F.round("mix_position", 9).alias("mix_position"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts by PPM trees learned from two thirds of the documents."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = langid.train(langid.trainable(docs, F.col("held_out")))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all texts under 200-byte strings that also start elsewhere."""
    docs = read(spark, sf_dir, "documents")
    spans = repeats.repeated_spans(docs, Scratch(spark, "op4"))
    return repeats.remove(docs, spans).drop("kept")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all texts."""
    return licences.scan(read(spark, sf_dir, "documents"))


def op6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-frequency and attention-model scores of all texts."""
    return scoring.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2, Scratch(spark, "op6"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows of 2048."""
    scratch = Scratch(spark, "op7")
    return packing.pack(scratch.save(packing.cut(read(spark, sf_dir, "documents")), "pieces"), scratch)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all texts and of their edited texts."""
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors, cosine 0.95 or more."""
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"), Scratch(spark, "op9"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    docs = read(spark, sf_dir, "documents")
    return jaccard.join(docs, Scratch(spark, "op10")).select("doc_id", "n_shingles", "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of two or three words of each language."""
    return phrases.mine(read(spark, sf_dir, "documents"), Scratch(spark, "op11"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all texts, every tenth of which has a planted one."""
    return periodic.summarise(read(spark, sf_dir, "documents"), planted=True).drop("n_words")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back from them."""
    scratch = Scratch(spark, "op13")
    path = f"{scratch.root}/archives"
    warc.write(warc.records(read(spark, sf_dir, "pages"), scratch), path)
    found = warc.read(spark, path, scratch)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "intact",
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_language": op3_language,
    "op4_repeats": op4_repeats,
    "op5_licences": op5_licences,
    "op6_scores": op6_scores,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_vectors": op9_vectors,
    "op10_jaccard": op10_jaccard,
    "op11_phrases": op11_phrases,
    "op12_runs": op12_runs,
    "op13_warc": op13_warc,
}
