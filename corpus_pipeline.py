"""Corpus pipeline: language ID, near-duplicate removal, repeated-string removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs holding the columns of ``documents`` (others are left
out), and returns a DataFrame; ``run`` writes each one as Parquet in the shared folder and reads it again as
the next one's docs. All stages but the last return the columns of ``documents``.

Defined results: as in the operators; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.llm import jaccard, langid, mixing, packing, repeats
from scenaria.llm.common import Scratch, fold, prepare, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language's share of the likelihood below which a text is taken for none of the learned languages.
LEAST_SCORE = 0.5
#: So many times the bits a byte that a language's own texts take at most: a longer text is taken for none of them.
MOST_RATE = 1.75
#: Near duplicates: 5-word shingles, 0.8 (op10 has its own 3 words and 0.9).
NEAR = jaccard.Similarity(5, 80)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones too), texts whose best language has a score under LEAST_SCORE, and texts
    of langid.RATED_BYTES bytes or more that take MOST_RATE times the bits a byte of that language's own texts.

    Missing language labels are filled in with the prediction. Without any label, all texts go. A language with
    too few labelled texts to tell its rate loses none by it.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    labelled = langid.trainable(docs, fold(F.col("doc_id"), 3) == 1)
    found = langid.predict(docs, langid.train(labelled), COLUMNS)
    usual = F.lit(None).cast("double")
    for lang, rate in sorted(langid.usual_rates(labelled).items()):
        usual = F.when(F.col("lang_pred") == lang, F.lit(rate)).otherwise(usual)
    strange = (F.octet_length("text") >= langid.RATED_BYTES) & (F.col("bits_per_byte") > MOST_RATE * usual)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & ~F.coalesce(strange, F.lit(False)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles."""
    prepare(spark)
    return jaccard.keep_one(docs.select(*COLUMNS), Scratch(spark, "near-duplicates"), NEAR).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes under 200-byte strings that also start elsewhere.

    A character that loses some of its bytes goes as a whole; n_chars is counted anew; all rows stay.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    spans = repeats.repeated_spans(docs, Scratch(spark, "repeated-strings"))
    others = tuple(c for c in COLUMNS if c != "n_chars")
    kind = docs.schema["n_chars"].dataType
    left = repeats.remove(docs, spans, tuple(c for c in COLUMNS if c not in ("text", "n_chars")))
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast(kind)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per epoch that its source is used in; no source is used less than once."""
    prepare(spark)
    return mixing.mix(docs.select(*COLUMNS), Scratch(spark, "mixture")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 2048, one row per piece."""
    prepare(spark)
    scratch = Scratch(spark, "windows")
    return packing.pack(scratch.save(packing.cut(docs.select(*COLUMNS)), "pieces"), scratch)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("windows", windows),
]

#: Byte context trees, exact joins and tokenization are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; the result of the last one."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
